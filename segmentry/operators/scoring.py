"""Scores of many segmentations of the same rows, from two scans for all of them.

The mean silhouette with squared Euclidean distances has a closed form: the mean distance of a row to a
segment follows from the segment's size, sum and sum of squares. So one scan adds these up for every
segment of every segmentation, and a second one takes each row's nearest segments.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column

# Distances held at once while a batch is scored: rows times segments of one segmentation.
DISTANCES = 1_000_000
# A distance below this part of the squares it is the difference of is rounding: the row lies in the middle.
ROUNDING = 1e-13


def segment_sums(df: DataFrame, assignments: Mapping[int, str], width: int, features: str = "features") -> DataFrame:
    """``k, segment, n, psi, sums``: size, sum of squares and sum vector of every segment of every segmentation.

    ``assignments`` names the column that holds the segments of each ``k``, never NULL. Each row is listed once per ``k``
    and combined before the shuffle, which moves one row per task and segment.
    """
    x = vector_to_array(features)
    listed = F.array(*[F.struct(F.lit(k).alias("k"), as_column(c).cast("int").alias("segment")) for k, c in assignments.items()])
    squares = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    rows = df.select(x.alias("x"), listed.alias("listed")).select("x", squares.alias("psi"), F.inline("listed"))
    grouped = rows.groupBy("k", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("psi").alias("psi"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]
    )
    return grouped.select("k", "segment", "n", "psi", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


class Segments:
    """Sizes, means and spreads of one segmentation's segments, and the silhouettes of rows against them."""

    def __init__(self, rows: Sequence):
        rows = sorted(rows, key=lambda r: r["segment"])
        self.ids = np.array([r["segment"] for r in rows])
        self.sizes = np.array([r["n"] for r in rows], float)
        self.means = np.array([r["sums"] for r in rows], float).reshape(len(rows), -1) / self.sizes[:, None]
        self.squares = np.array([r["psi"] for r in rows], float) / self.sizes

    def silhouettes(self, points: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Per row (nearest other - own) / larger of both; 0 for the only row of a segment."""
        own = np.searchsorted(self.ids, segments)
        at = np.arange(len(points))
        scale = (points * points).sum(axis=1)[:, None] + self.squares
        distances = scale - 2 * points @ self.means.T
        distances[distances < ROUNDING * scale] = 0.0
        size = self.sizes[own]
        inside = distances[at, own] * size / np.maximum(size - 1, 1)
        distances[at, own] = np.inf
        outside = distances.min(axis=1)
        larger = np.maximum(inside, outside)
        values = np.divide(outside - inside, larger, out=np.zeros(len(points)), where=larger > 0)
        return np.where(size > 1, values, 0.0)


def sweep_scores(df: DataFrame, assignments: Mapping[int, str], features: str = "features") -> list[dict]:
    """``k, segments, silhouette, min_share, max_share`` of every segmentation, in two scans for all.

    The silhouette of a single segment is None. The driver gets one row per segment, the second scan ships
    them to the tasks, and each row's silhouettes, one per ``k``, are averaged before the shuffle. An empty table has no scores.
    """
    first = df.select(features).first()
    if first is None:
        return []
    found = segment_sums(df, assignments, len(first[0]), features).collect()  # one row per segment
    by_k = {k: [r for r in found if r["k"] == k] for k in assignments}
    scored = {k: Segments(rows) for k, rows in by_k.items() if len(rows) > 1}
    order = list(scored)
    values: dict[int, float] = {}
    if order:

        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for points, listed in batches:
                matrix = np.stack(points.to_numpy())
                chosen = np.stack(listed.to_numpy())
                result = np.empty((len(matrix), len(order)))
                for i, k in enumerate(order):
                    step = max(1, DISTANCES // len(scored[k].ids))
                    for at in range(0, len(matrix), step):
                        part = slice(at, at + step)
                        result[part, i] = scored[k].silhouettes(matrix[part], chosen[part, i])
                yield pd.Series(list(result))

        udf = F.pandas_udf(score, T.ArrayType(T.DoubleType()))
        listed = F.array(*[as_column(assignments[k]).cast("int") for k in order])
        rows = df.select(udf(vector_to_array(features), listed).alias("s"))
        means = rows.agg(*[F.avg(F.col("s")[i]) for i in range(len(order))]).first()
        values = dict(zip(order, means))
    scores = []
    for k, rows in by_k.items():
        sizes = [r["n"] for r in rows]
        total = sum(sizes)
        scores.append(
            {
                "k": k,
                "segments": len(sizes),
                "silhouette": values.get(k),
                "min_share": min(sizes) / total,
                "max_share": max(sizes) / total,
            }
        )
    return scores
