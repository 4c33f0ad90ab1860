"""Vocabularies of any size: labels numbered in a stored table, joined by value, as sparse vectors.

``Vocabulary`` and ``string_index`` make a column or a tree split of every label and keep the labels on the driver. Here
a label is a row, so a column may have as many of them as the table has rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..sources.staging import stage
from .cleaning import label_counts
from .joins import attach


def label_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored ``(column, value, rows, idx)`` of every non-NULL label: 0 for the most frequent one of a column, ties by label.

    The labels are sorted by range over all tasks. A label's number is its place in its part plus the number of
    the column's labels in the parts before; only those totals, one row per part and column, meet in one task.
    """
    counts = label_counts(df, columns).filter(F.col("value").isNotNull())
    order = ["column", F.desc("rows"), "value"]
    laid = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stage(laid.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "labels")
    totals = parts.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("start"))
    before = F.sum("n").over(Window.partitionBy("column").orderBy("part")) - F.col("n")
    starts = totals.select("column", "part", "start", before.alias("before"))
    # A part holds a column's labels one after the other.
    numbered = parts.join(F.broadcast(starts), ["column", "part"])
    idx = F.col("before") + F.col("seq") - F.col("start")
    return stage(numbered.select("column", "value", "rows", idx.cast("double").alias("idx")), "vocabulary")


def index_labels(df: DataFrame, columns: Sequence[str], vocabulary: DataFrame) -> DataFrame:
    """Adds ``column_idx``, the label's number; NULL and labels the vocabulary lacks get the next number after the last."""
    sizes = {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in columns:  # one row per column above
        labels = vocabulary.filter(F.col("column") == c).select(F.col("value").alias("__label"), F.col("idx").alias(f"{c}_idx"))
        df = attach(df.withColumn("__label", as_column(c).cast("string")), labels, "__label").drop("__label")
        df = df.withColumn(f"{c}_idx", F.coalesce(as_column(f"{c}_idx"), F.lit(float(sizes.get(c, 0)))))
    return df


def sparse_dummies(df: DataFrame, columns: Sequence[str], vocabulary: DataFrame) -> tuple[OneHotEncoderModel, DataFrame]:
    """Adds ``column_vec``, a sparse 0/1 vector with one place per label and a last one for NULL and unknown labels.

    The encoder learns only the vectors' lengths.
    """
    indexed = index_labels(df, columns, vocabulary)
    lengths = vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    # The longest index of every column, so that a table without unknown labels gives vectors of the same length.
    longest = {r["column"]: float(r["n"]) for r in lengths.collect()}
    ends = df.sparkSession.createDataFrame(
        [[longest.get(c, 0.0) for c in columns]], ", ".join(f"`{c}_idx` double" for c in columns)
    )
    encoder = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in columns], outputCols=[f"{c}_vec" for c in columns], dropLast=False, handleInvalid="error"
    )
    model = encoder.fit(ends)
    return model, model.transform(indexed)
