"""Scores of many segmentations at once, against brute force and one by one."""

import uuid

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from segmentry.operators import segmentation
from segmentry.operators.scoring import sweep_scores
from segmentry.operators.segmentation import SweepOptions
from segmentry.spec import ShareRule


def points(spark, rows, parts=3):
    noise = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    df = spark.range(0, rows, 1, parts).select("id", noise(1).alias("x"), (noise(2) + F.col("id") % 3).alias("y"), F.lit(2.0).alias("z"))
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df)


def brute(rows, segments):
    x = np.array([r["features"].toArray() for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    g, at, values = np.array(segments), np.arange(len(x)), []
    for i in at:
        own = (g == g[i]) & (at != i)
        if not own.any():
            values.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, g == s].mean() for s in set(g) - {g[i]})
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(values)


def test_scores_equal_brute_force_with_single_rows_and_gaps_in_the_numbers(spark):
    df = points(spark, 90).withColumns(
        {"a": F.col("id") % 3, "b": (F.col("id") % 5) * 7 - 9, "c": F.when(F.col("id") == 4, 100).otherwise(F.col("id") % 2), "d": F.lit(1)}
    )
    scores = {s["k"]: s for s in sweep_scores(df, {3: "a", 5: "b", 2: "c", 1: "d"})}
    rows = df.collect()
    for k, name in ((3, "a"), (5, "b"), (2, "c")):
        assert scores[k]["silhouette"] == pytest.approx(brute(rows, [r[name] for r in rows]), abs=1e-12)
    assert scores[2]["segments"] == 3 and scores[2]["min_share"] == 1 / 90
    assert scores[1] == {"k": 1, "segments": 1, "silhouette": None, "min_share": 1.0, "max_share": 1.0}


def test_equal_points_and_no_points(spark):
    flat = VectorAssembler(inputCols=["p", "q"], outputCol="features")
    df = flat.transform(spark.range(20).select((F.col("id") % 2).alias("s"), F.lit(0.7).alias("p"), F.lit(1.3).alias("q")))
    assert sweep_scores(df, {2: "s"})[0]["silhouette"] == pytest.approx(0.0, abs=1e-9)
    assert sweep_scores(df.limit(0), {2: "s"}) == []


def test_the_sweep_agrees_with_the_evaluator_model_by_model(spark):
    vectors = points(spark, 300).select("features").cache()
    sweep = segmentation.k_sweep(vectors, SweepOptions(ks=(2, 3, 6), rule=ShareRule(0.2, 0.5)))
    for entry in sweep:
        predicted = entry["model"].transform(vectors)
        assert "prediction" in predicted.columns
        assert entry["silhouette"] == pytest.approx(segmentation.silhouette(predicted), abs=1e-9)
        shares = [r["share"] for r in segmentation.cluster_shares(predicted).collect()]
        assert (entry["min_share"], entry["max_share"]) == (min(shares), max(shares))
        assert entry["accepted"] == (min(shares) >= 0.2 and max(shares) <= 0.5)
    vectors.unpersist()


def jobs_of(spark, run) -> int:
    context = spark.sparkContext
    group = f"counted-{uuid.uuid4()}"
    context.setJobGroup(group, "counted")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_the_number_of_jobs_does_not_grow_with_the_number_of_segmentations(spark):
    df = points(spark, 200).withColumns({f"s{k}": F.col("id") % k for k in range(2, 21)}).cache()
    df.count()
    few = jobs_of(spark, lambda: sweep_scores(df, {2: "s2"}))
    many = jobs_of(spark, lambda: sweep_scores(df, {k: f"s{k}" for k in range(2, 21)}))
    df.unpersist()
    assert 0 < many == few <= 6
