"""Which features explain the segments: a forest ranking and the refit on its top."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..sources.tables import RANKING_SCHEMA
from .cleaning import label_counts
from .segmentation import PARTITIONS, Segmentation, SweepOptions, fixed_layout, segment


@dataclass(frozen=True)
class Ranking:
    model: RandomForestClassificationModel
    table: DataFrame


def string_index(
    df: DataFrame, columns: Sequence[str], max_labels: int | None = None
) -> tuple[StringIndexerModel, DataFrame]:
    """Adds ``column_idx``: 0 for the most frequent label, ties by label.

    NULL and labels not seen in the fit get one extra index. The fitted labels
    live on the driver and in every tree split; with ``max_labels``, a column with
    more labels is an error, found before more of them are collected.
    """
    counts = label_counts(df, columns).filter(F.col("value").isNotNull())
    found = (counts if max_labels is None else counts.limit(len(columns) * max_labels + 1)).collect()
    labels = {c: [(-r["rows"], r["value"]) for r in found if r["column"] == c] for c in columns}
    wide = sorted(c for c, pairs in labels.items() if max_labels is not None and len(pairs) > max_labels)
    if wide:
        raise ValueError(f"too many labels to index (limit {max_labels}): {wide}")
    model = StringIndexerModel.from_arrays_of_labels(
        [[label for _, label in sorted(labels[c])] for c in columns],
        inputCols=list(columns),
        outputCols=[f"{c}_idx" for c in columns],
        handleInvalid="keep",
    )
    return model, model.transform(df)


def rank_features(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    key: str | None = None,
    trees: int = 100,
    seed: int = 42,
    partitions: int = PARTITIONS,
) -> Ranking:
    """Importance of every feature for the label, by a random forest.

    Categorical features enter as indices, numeric ones as they are. The names
    follow the order in which the vector was assembled.
    """
    table = df.select(*[as_column(c) for c in dict.fromkeys([*([key] if key else []), label, *numeric, *categorical])])
    table = fixed_layout(table, key or label, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        indexed, bins = table, 32
        if categorical:
            indexer, indexed = string_index(table, categorical)
            bins = max(bins, *[len(labels) + 1 for labels in indexer.labelsArray])
        inputs = [*numeric, *[f"{c}_idx" for c in categorical]]
        vectors = VectorAssembler(inputCols=inputs, outputCol="__inputs", handleInvalid="error").transform(indexed)
        forest = RandomForestClassifier(
            featuresCol="__inputs", labelCol=label, numTrees=trees, seed=seed, maxBins=bins
        )
        model = forest.fit(vectors.select("__inputs", as_column(label)))
    finally:
        table.unpersist()
    importances = model.featureImportances.toArray()
    ordered = sorted(zip([*numeric, *categorical], importances), key=lambda pair: -pair[1])
    rows = [(name, float(value), rank) for rank, (name, value) in enumerate(ordered, start=1)]
    return Ranking(model, df.sparkSession.createDataFrame(rows, RANKING_SCHEMA))


def top_k_features(
    ranking: DataFrame, k: int, numeric: Sequence[str], categorical: Sequence[str]
) -> tuple[list[str], list[str]]:
    """The ``k`` most important features, split by role."""
    best = [r["feature"] for r in ranking.orderBy("rank").limit(k).collect()]
    return [f for f in best if f in set(numeric)], [f for f in best if f in set(categorical)]


def refit_top_k(
    df: DataFrame,
    ranking: DataFrame,
    k: int,
    numeric: Sequence[str],
    categorical: Sequence[str],
    key: str,
    options: SweepOptions = SweepOptions(),
) -> tuple[list[str], Segmentation]:
    """Segment again on the ``k`` most important features only."""
    best_numeric, best_categorical = top_k_features(ranking, k, numeric, categorical)
    features = [*best_numeric, *best_categorical]
    return features, segment(df, features, key, options)
