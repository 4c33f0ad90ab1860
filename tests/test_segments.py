import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from segmentry.operators import ranking, segmentation
from segmentry.operators.segmentation import SweepOptions, best_k, cluster_profile, cluster_shares, segment, share_rule
from segmentry.plans import catalog_segments
from segmentry.spec import REGULATOR_RULE, ShareRule


def blobs(spark, rows=400):
    """Four well separated groups of equal size, plus a constant and a gap."""
    g = F.col("id") % 4
    noise = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0)
    x = F.when(g < 2, 0.0).otherwise(20.0) + noise(1)
    return spark.range(rows).select(
        F.col("id").alias("key"),
        x.alias("x"),
        (F.when(g % 2 == 0, 0.0).otherwise(20.0) + noise(2)).alias("y"),
        F.lit(3.0).alias("flat"),
        F.when(F.col("id") != 5, x).alias("gap"),
        g.alias("truth"),
    )


FEATURES = ["x", "y", "flat", "gap"]


def test_scaled_features_have_mean_zero_and_deviation_one(spark):
    _, scaled = segmentation.standardize(blobs(spark), ["x", "y", "flat"])
    z = vector_to_array("features")
    values = np.array([r[0] for r in scaled.select(z).collect()])
    assert np.allclose(values.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(values.std(axis=0, ddof=1), [1, 1, 0], atol=1e-9)


def test_missing_features_are_an_error_in_the_scaler_not_a_dropped_row(spark):
    with pytest.raises(Exception, match="(?i)null"):
        segmentation.standardize(blobs(spark), FEATURES)[1].count()


@pytest.fixture(scope="module")
def result(spark):
    return segment(blobs(spark), FEATURES, "key", SweepOptions(ks=tuple(range(2, 7))))


def test_segment_finds_the_groups_and_keeps_every_row(result):
    assert result.best_k == 4 and result.silhouette > 0.9
    rows = result.predictions.select("key", "prediction").collect()
    assert sorted(r["key"] for r in rows) == list(range(400))
    label = {}
    for r in rows:
        assert label.setdefault(r["key"] % 4, r["prediction"]) == r["prediction"]
    assert len(set(label.values())) == 4


def test_sweep_lists_rejected_numbers_too(result):
    sweep = {r["k"]: r for r in result.sweep.collect()}
    assert list(sweep) == [2, 3, 4, 5, 6]
    assert not sweep[2]["accepted"] and sweep[2]["max_share"] == 0.5
    assert sweep[4]["accepted"] and sweep[4]["min_share"] == sweep[4]["max_share"] == 0.25


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_the_same_segments_from_any_layout(spark, result, parts):
    again = segment(blobs(spark).repartition(parts), FEATURES, "key", SweepOptions(ks=(4, 5), parallelism=1))
    assert again.best_k == 4
    for mine, theirs in zip(again.model.clusterCenters(), result.model.clusterCenters()):
        assert np.allclose(mine, theirs, atol=1e-9)


def test_silhouette_equals_brute_force(spark):
    df = blobs(spark, 80).withColumn("prediction", (F.col("key") % 3).cast("int"))
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    rows = df.select("x", "y", "prediction").collect()
    points = np.array([[r["x"], r["y"]] for r in rows])
    groups = np.array([r["prediction"] for r in rows])
    distance = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    scores = []
    for i in range(len(points)):
        own = (groups == groups[i]) & (np.arange(len(points)) != i)
        a = distance[i, own].mean()
        b = min(distance[i, groups == g].mean() for g in set(groups) if g != groups[i])
        scores.append((b - a) / max(a, b))
    assert segmentation.silhouette(df) == pytest.approx(np.mean(scores))


def test_no_accepted_number_names_the_rule(spark):
    options = SweepOptions(ks=(2, 3), rule=ShareRule(0.9, 1.0))
    with pytest.raises(ValueError, match="min_share=0.9"):
        segment(blobs(spark), FEATURES, "key", options)


def test_first_of_equal_scores_wins():
    entries = [{"k": k, "silhouette": s, "accepted": a} for k, s, a in [(2, 0.9, False), (3, 0.7, True), (4, 0.7, True)]]
    assert best_k(entries)["k"] == 3


def test_rules():
    assert ShareRule().accepts(0.01, 0.45) and not ShareRule().accepts(0.009, 0.4)
    assert REGULATOR_RULE.accepts(0.05, 0.30, 0.51)
    assert not REGULATOR_RULE.accepts(0.05, 0.30, 0.5) and not REGULATOR_RULE.accepts(0.05, 0.31, 0.9)
    with pytest.raises(ValueError, match="silhouette"):
        REGULATOR_RULE.accepts(0.1, 0.2)
    with pytest.raises(ValueError):
        ShareRule(0.5, 0.4)


def test_shares_sum_to_one_and_the_rule_reads_them(spark, result):
    shares = cluster_shares(result.predictions)
    rows = shares.collect()
    assert math.isclose(sum(r["share"] for r in rows), 1.0) and sum(r["count"] for r in rows) == 400
    assert share_rule(shares, ShareRule()).first()["accepted"]
    assert not share_rule(shares, ShareRule(0.26, 1.0)).first()["accepted"]
    assert share_rule(shares, REGULATOR_RULE, 0.6).first()["accepted"]
    assert not share_rule(shares, REGULATOR_RULE, 0.5).first()["accepted"]
    with pytest.raises(ValueError, match="silhouette"):
        share_rule(shares, REGULATOR_RULE)


def test_predictions_keep_every_column(result):
    assert {"key", "x", "y", "flat", "gap", "truth", "prediction"} <= set(result.predictions.columns)
    assert result.predictions.filter("truth <> key % 4").count() == 0


def test_five_thousand_labels(spark):
    df = spark.range(10_000).select((F.col("id") % 5_000).cast("string").alias("c"))
    model, out = ranking.string_index(df, ["c"])
    assert len(model.labelsArray[0]) == 5_000 and out.agg(F.max("c_idx")).first()[0] == 4_999


def test_profile_is_the_rounded_median(spark, result):
    profile = cluster_profile(result.predictions, ["x", "gap"])
    wanted = result.predictions.groupBy("prediction").agg(
        F.round(F.median("x"), 2).alias("median_x"), F.round(F.median("gap"), 2).alias("median_gap")
    )
    assert profile.columns == wanted.columns
    assert {tuple(r) for r in profile.collect()} == {tuple(r) for r in wanted.collect()}


def test_index_by_frequency_with_an_extra_one_for_null(spark):
    df = spark.createDataFrame([("b",), ("b",), ("c",), ("a",), (None,)], "c string")
    model, out = ranking.string_index(df, ["c"])
    assert [(r["c"], r["c_idx"]) for r in out.collect()] == [("b", 0.0), ("b", 0.0), ("c", 2.0), ("a", 1.0), (None, 3.0)]
    unseen = model.transform(spark.createDataFrame([("zz",)], "c string")).first()
    assert unseen["c_idx"] == 3.0


def test_numbers_are_indexed_by_their_text(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, 1.0)], "i int, d double")
    rows = ranking.string_index(df, ["i", "d"])[1].collect()
    assert [(r["i_idx"], r["d_idx"]) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_too_many_labels_to_index(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("c"), F.lit("k").alias("d"))
    with pytest.raises(ValueError, match="too many labels"):
        ranking.string_index(df, ["d", "c"], max_labels=29)


def test_ranking_names_the_feature_that_decides(spark):
    """The names follow the assembled order: constants get nothing, the label's twin all."""
    df = spark.range(200).select(
        "id", F.lit(1.0).alias("n1"), F.lit("k").alias("a"), (F.col("id") % 2).cast("int").alias("b"),
        (F.col("id") % 2).cast("int").alias("cluster"),
    )
    ranked = ranking.rank_features(df, "cluster", ["n1"], ["a", "b"], "id", trees=20).table
    assert ranked.first()["feature"] == "b" and ranked.first()["importance"] == pytest.approx(1.0)
    numeric = ranking.rank_features(df.withColumn("n2", F.col("cluster") * 2.5), "cluster", ["n1", "n2"], [], "id", trees=20)
    assert numeric.table.first()["feature"] == "n2" and numeric.model.getNumTrees == 20


def test_ranking_does_not_depend_on_the_layout(spark):
    df = blobs(spark).fillna(0.0).withColumn("cluster", F.col("truth").cast("int"))
    tables = [
        ranking.rank_features(df.repartition(n), "cluster", FEATURES, [], "key", trees=10).table.collect() for n in (1, 5)
    ]
    assert [(r["feature"], round(r["importance"], 9)) for r in tables[0]] == [
        (r["feature"], round(r["importance"], 9)) for r in tables[1]
    ]


def test_refit_uses_the_top_features_only(spark):
    df = blobs(spark)
    rows = [("y", 0.5, 2), ("x", 0.6, 1), ("gap", 0.1, 3)]
    table = spark.createDataFrame(rows, "feature string, importance double, rank int")
    best, refit = ranking.refit_top_k(df, table, 2, ["x", "y", "gap"], [], "key", SweepOptions(ks=(3, 4)))
    assert best == ["x", "y"] and refit.best_k == 4
    assert ranking.top_k_features(table, 2, ["x"], ["y", "gap"]) == (["x"], ["y"])


def test_the_layout_grows_with_the_table(spark, small, monkeypatch):
    """What one task reads stays bounded: small tables keep the given number of partitions, larger ones get more."""
    assert segmentation.fixed_layout(blobs(spark), "key").rdd.getNumPartitions() == segmentation.PARTITIONS
    monkeypatch.setattr(segmentation, "PARTITION_ROWS", 30)
    laid = segmentation.fixed_layout(blobs(spark), "key")
    assert laid.rdd.getNumPartitions() == 14
    assert sorted(r["key"] for r in laid.select("key").collect()) == list(range(400))
    monkeypatch.setattr(segmentation, "PARTITION_ROWS", 300)
    vectors = catalog_segments.line_points(spark, small)[1]
    assert vectors.rdd.getNumPartitions() == -(-vectors.count() // 300) > segmentation.PARTITIONS


def test_block_solver_gives_the_same_centres(spark, monkeypatch):
    """Packed vectors are iterated over, not decoded rows, and the centres are those of the row solver."""
    _, scaled = segmentation.standardize(blobs(spark), ["x", "y"])
    vectors = scaled.select("features").cache()
    seen = []
    fit = segmentation.KMeans.fit
    monkeypatch.setattr(segmentation.KMeans, "fit", lambda self, df: seen.append(self.getSolver()) or fit(self, df))
    centres = segmentation.fit_kmeans(vectors, 4).clusterCenters()
    assert seen == ["block"]
    plain = fit(segmentation.KMeans(k=4, seed=42, solver="row"), vectors).clusterCenters()
    assert np.allclose(centres, plain, atol=1e-9)
    vectors.unpersist()


def test_more_segments_than_points_or_starting_centres(spark, monkeypatch):
    """Fewer starting centres than segments: the model holds these, as the row solver gives them."""
    few = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(90).selectExpr("cast(id % 3 as double) as x"))
    few = few.select("features")
    assert segmentation.distinct_points(few, 2) == 2 and segmentation.distinct_points(few, 9) == 3
    assert sorted(c[0] for c in segmentation.fit_kmeans(few, 5).clusterCenters()) == [0.0, 1.0, 2.0]
    # Two outliers of different size draw all weight in both steps of the start.
    x = "case id when 7 then 1e40 when 8 then 1e20 else id / 100 end"
    far = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(90).selectExpr(f"cast({x} as double) as x"))
    far = far.select("features")
    centres = sorted(c[0] for c in segmentation.fit_kmeans(far, 6).clusterCenters())
    plain = segmentation.KMeans(k=6, seed=42, solver="row").fit(far).clusterCenters()
    assert len(centres) < 6 and centres == sorted(c[0] for c in plain)
    seen = []
    fit = segmentation.KMeans.fit
    monkeypatch.setattr(segmentation.KMeans, "fit", lambda self, df: seen.append((self.getK(), self.getSolver())) or fit(self, df))
    sweep = segmentation.k_sweep(few, SweepOptions(ks=(2, 3, 4, 5)))
    assert [e["segments"] for e in sweep] == [2, 3, 3, 3] and sweep[3]["silhouette"] == pytest.approx(1.0)
    assert sorted(seen) == [(2, "block"), (3, "block"), (4, "row"), (5, "row")]


def test_refit_tries_more_segments_than_its_points(spark):
    df = spark.range(300).selectExpr("id as key", "cast(id % 3 = 0 as int) as a", "cast(id % 3 = 1 as int) as b", "id / 7.0 as noise")
    table = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("noise", 0.1, 3)], "feature string, importance double, rank int")
    best, refit = ranking.refit_top_k(df, table, 2, ["noise"], ["a", "b"], "key", SweepOptions(ks=(2, 3, 4), rule=ShareRule(0.3, 0.4)))
    assert best == ["a", "b"] and refit.best_k == 3 and refit.silhouette == pytest.approx(1.0)


def test_segment_tries_more_segments_than_its_points(spark):
    df = spark.range(300).selectExpr("id as key", "cast(id % 3 as double) as x")
    again = segment(df, ["x"], "key", SweepOptions(ks=(2, 3, 4, 6), rule=ShareRule(0.3, 0.4)))
    assert again.best_k == 3 and again.silhouette == pytest.approx(1.0)
    groups = again.predictions.groupBy("x").agg(F.countDistinct("prediction").alias("n"), F.count("*").alias("rows")).collect()
    assert sorted((r["x"], r["n"], r["rows"]) for r in groups) == [(0.0, 1, 100), (1.0, 1, 100), (2.0, 1, 100)]


def test_fewer_fits_at_once_over_large_tables(spark, monkeypatch):
    _, scaled = segmentation.standardize(blobs(spark), ["x", "y"])
    assert segmentation.fits_at_once(scaled, 8) == 8
    monkeypatch.setattr(segmentation, "HELD", 400 * 12 * 3)
    assert segmentation.fits_at_once(scaled, 8) == 3
    monkeypatch.setattr(segmentation, "HELD", 1)
    assert segmentation.fits_at_once(scaled, 8) == 1 and segmentation.fits_at_once(scaled.limit(0), 8) == 8
    sweep = segmentation.k_sweep(scaled, SweepOptions(ks=(3, 4)))
    assert best_k(sweep)["k"] == 4
