from collections import Counter
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segmentry.operators import locations, profiling
from segmentry.operators.joins import attach, attach_group_stats, group_stats
from segmentry.operators import quantiles
from segmentry.operators.quantiles import group_medians
from segmentry.sources.staging import stage


def test_missing_counts_null_and_marker(spark):
    df = spark.createDataFrame([("None", 1.0), (None, None), ("xNonex", 2.0), ("a", 3.0)], "s string, n double")
    rows = {r["column"]: (r["missing"], r["total"]) for r in profiling.missing_counts(df).collect()}
    assert rows == {"s": (3, 4), "n": (1, 4)}


def test_summary_rounds_to_two_digits(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    row = profiling.numeric_summary(df, ["x"]).first()
    assert tuple(row) == ("x", 3, 2.33, 1.53, 1.0, 4.0)


def test_moments_of_a_constant_do_not_fail(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "c double, x double")
    rows = {r["column"]: r for r in profiling.numeric_moments(df, ["c", "x"]).collect()}
    assert rows["c"]["stddev"] == 0 and rows["c"]["skewness"] is None and rows["c"]["median"] == 3.0
    assert rows["x"]["median"] == 1.0
    approx = profiling.numeric_moments(df, ["x"], accuracy=100).first()
    assert approx["median"] == 1.0


def test_frequency_keeps_null_and_orders_by_count(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,), (None,)], "c string")
    rows = [tuple(r) for r in profiling.category_frequency(df, ["c"]).collect()]
    assert rows == [("c", None, 3, 50.0), ("c", "b", 2, 33.33), ("c", "a", 1, 16.67)]


def test_correlation_uses_complete_pairs_and_survives_constants(spark):
    data = [(1.0, 2.0, 3.0), (2.0, 4.1, 3.0), (3.0, None, 3.0), (4.0, 7.9, 3.0), (None, 1.0, 3.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    rows = {r["column"]: r for r in profiling.correlation_matrix(df, ["a", "b", "c"]).collect()}
    import pandas as pd

    wanted = pd.DataFrame(data, columns=["a", "b", "c"]).corr()
    assert rows["a"]["b"] == pytest.approx(wanted.loc["a", "b"])
    assert rows["b"]["a"] == rows["a"]["b"] and rows["a"]["a"] == pytest.approx(1.0)
    assert rows["a"]["c"] is None and rows["c"]["c"] is None


finite = st.floats(allow_nan=False, allow_infinity=False, width=64)


def medians(df, columns, lower=False):
    return {r["g"]: tuple(r[c] for c in columns) for r in group_medians(df, "g", columns, lower).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]), finite, st.integers(-3, 3)), min_size=1, max_size=40))
def test_medians_of_small_groups(spark, rows):
    df = spark.createDataFrame([(g, x, float(y)) for g, x, y in rows], "g string, x double, y double")
    for lower in (False, True):
        got = medians(df, ["x", "y"], lower)
        for g in {r[0] for r in rows}:
            for c in (0, 1):
                values = sorted(r[c + 1] for r in rows if r[0] == g)
                a, b = values[(len(values) - 1) // 2], values[len(values) // 2]
                assert got[g][c] == (a if lower or a == b else a / 2 + b / 2)


def test_brackets_close_in_whatever_the_values_are_like(spark, monkeypatch):
    """Log-uniform values over all doubles, heavy ties, nulls, a hot group: at most four scans, exact results."""
    scans = []
    plain = quantiles._in_bracket
    monkeypatch.setattr(quantiles, "_in_bracket", lambda *a: scans.append(1) or plain(*a))
    monkeypatch.setattr(quantiles, "COUNTED_VALUES", 100)
    big = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.when(F.col("id") % 11 != 0, F.pow(F.lit(10.0), (F.col("id") - 30_000) / 100)).alias("x"),
        (F.col("id") % 2).cast("double").alias("tie"),
        F.lit(None).cast("double").alias("empty"),
    )
    columns = ["x", "tie", "empty"]
    wanted = big.groupBy("g").agg(*[F.median(c).alias(c) for c in columns]).collect()
    assert medians(big, columns) == {r["g"]: tuple(r[c] for c in columns) for r in wanted}
    assert 2 <= len(scans) <= 4


def test_many_groups_of_which_one_is_large(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.lit(-1)).alias("g"), F.xxhash64("id").cast("double").alias("x")
    )
    got = group_medians(rows, "g", ["x"])
    wanted = rows.groupBy("g").agg(F.median("x").alias("x"))
    assert got.count() == 20_001 and got.exceptAll(wanted).count() == 0


def test_medians_at_the_ends_of_the_doubles(spark):
    inf, tiny = math.inf, 5e-324
    cases = {
        "inf": [-inf, 1.0, inf, inf, inf], "even": [1.0, inf, inf, -inf], "low": [-inf, -inf, 2.0],
        "tiny": [0.0, tiny, tiny], "zero": [0.0, -0.0, tiny, 2 * tiny], "mixed": [-1.7e308, 1.7e308, 3.0],
    }
    df = spark.createDataFrame([(g, x) for g, xs in cases.items() for x in xs], "g string, x double")
    found = {g: x for g, (x,) in medians(df, ["x"]).items()}
    assert found == {"inf": inf, "even": inf, "tiny": tiny, "mixed": 3.0, "low": -inf, "zero": 0.0}


def transactions(spark):
    """A third of the rows at one place, some at none."""
    return spark.range(3_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
            F.concat(F.lit("m"), F.col("id") % 40)
        ).alias("place"),
        (F.col("id") % 100).cast("double").alias("amount"),
    )


def test_location_window_equals_the_whole_partition_window(spark):
    from pyspark.sql import Window

    df = stage(transactions(spark).repartition(6), "places")
    w = Window.partitionBy("place")
    wanted = df.withColumns({"a": F.avg("amount").over(w), "n": F.count("amount").over(w)}).collect()
    got = locations.location_window(df, "place", "amount")
    assert got.columns == ["id", "place", "amount", "avg_transaction_by_location", "transaction_frequency"]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in wanted}


def test_hot_rows_are_spread_over_tasks(spark):
    """Without a broadcast, adaptive execution splits the key that holds a third of the rows."""
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for name, value in settings_.items():
        spark.conf.set(name, value)
    try:
        df = stage(transactions(spark).repartition(12), "places")
        stats = group_stats(df, "place", [F.avg("amount").alias("a")])
        joined = attach_group_stats(df, stats, "place").withColumn("task", F.spark_partition_id())
        rows = [r for r in joined.collect() if r["place"] == "hot"]
        sizes = Counter(r["task"] for r in rows)
        assert len(rows) == 1_000 and len(sizes) > 2 and max(sizes.values()) < 600
    finally:
        for name in settings_:
            spark.conf.unset(name)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_matches_a_plain_join(spark, how):
    facts = stage(transactions(spark), "facts")
    names = [(f"m{i}", i) for i in range(0, 40, 2)] + [("hot", 99), (None, -1)]
    dimension = stage(spark.createDataFrame(names, "place string, code int"), "dimension")
    wanted = facts.join(dimension, "place", how).select("id", "place", "code").collect()
    got = attach(facts, dimension, "place", how).select("id", "place", "code").collect()
    assert len(got) == len(wanted) and set(got) == set(wanted)
    safe = attach(facts, dimension, "place", how, null_safe=True).filter("place is null").select("code").distinct()
    assert [r[0] for r in safe.collect()] == [-1]


def test_risk_patterns_sample_after_using_all_rows(spark):
    from segmentry.plans.bank import BANK

    df = transactions(spark).select(
        "id", F.col("place").alias("mun_res"), F.col("amount").alias("trn_monto"),
        F.when(F.col("id") % 2 == 0, "alto").when(F.col("id") % 5 == 0, "medio").alias("nivel_riesgo_ciiu"),
    )
    out = locations.risk_patterns(df, BANK, 0.1, ["id"])
    assert out.columns == ["mun_res", "avg_transaction_by_location", "transaction_frequency", "risk_score"]
    sampled = locations.hash_sample(df, 0.1, ["id"])
    assert out.count() == sampled.count()
    hot = out.filter(F.col("mun_res") == "hot").select("transaction_frequency").distinct().collect()
    assert [r[0] for r in hot] == [1_000]
    assert {r[0] for r in out.select("risk_score").distinct().collect()} == {1, 2, 3}


def test_sample_does_not_depend_on_the_layout(spark):
    keys = [
        {r["id"] for r in locations.hash_sample(transactions(spark).repartition(n), 0.1, ["id"]).collect()}
        for n in (1, 4, 9)
    ]
    assert keys[0] == keys[1] == keys[2] and 200 < len(keys[0]) < 400
    assert locations.hash_sample(transactions(spark), 1.0).count() == 3_000
    assert locations.hash_sample(transactions(spark), 0.0).count() == 0


@pytest.mark.parametrize("size", [1, 50, 2_999, 10_000])
def test_profile_sample_equals_sorting_everything(spark, size):
    df = transactions(spark)
    got = [r["id"] for r in locations.profile_sample(df, size, ["id"]).collect()]
    wanted = [r["id"] for r in df.orderBy(F.md5(F.col("id").cast("string")), "id").limit(size).collect()]
    assert got == wanted and len(got) == min(size, 3_000)


def test_profile_sample_with_few_distinct_keys(spark):
    """Equal keys share a digest: the bound is widened until enough rows pass."""
    df = spark.range(1_000).select((F.col("id") % 3).alias("k"), "id")
    assert locations.profile_sample(df, 700, ["k"]).count() == 700


def test_observed_sections_equal_the_scanned_ones_in_one_job(spark, tmp_path):
    from segmentry.plans.retail import RETAIL
    from tests.test_scoring import jobs_of

    names = list(RETAIL.columns)
    rows = [[str(i % 5), None if i % 7 == 0 else "s", "x4-NOT SPECIFIED" if i == 3 else "n", float(i) if i % 4 else None, "f", None, 1.5 * i] for i in range(200)]
    kinds = ["double" if c in RETAIL.numeric else "string" for c in names]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(names, kinds))).repartition(3)
    watched, sections = profiling.observed_quality(df, RETAIL)
    path = str(tmp_path / "typed")
    plain = jobs_of(spark, lambda: df.write.parquet(str(tmp_path / "plain")))
    assert jobs_of(spark, lambda: watched.write.parquet(path)) == plain
    found, stored = sections(), spark.read.parquet(path)
    wanted = profiling.report_sections(stored, RETAIL)
    for name, table in found.items():
        right = wanted[name]()
        assert table.columns == right.columns
        mine, theirs = ({r["column"]: r for r in t.collect()} for t in (table, right))
        assert set(mine) == set(theirs)
        for c in mine:
            assert list(mine[c])[1:] == pytest.approx(list(theirs[c])[1:], nan_ok=True), (name, c)
