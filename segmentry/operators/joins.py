"""Left joins on an entity or group key.

The right side is always a stored table, so Spark knows its real size: it picks the
broadcast itself, below ``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution
splits the partitions of hot and NULL keys otherwise. The left rows of one key then
spread over several tasks, each with a copy of the key's one right row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..sources.staging import stage


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join ``right``, a stored table with one row per key; with ``null_safe`` the NULL keys match each other."""
    values = [as_column(c) for c in right.columns if c != key]
    match = right.select(as_column(key).alias("__key"), *values)
    column = as_column(key)
    same = column.eqNullSafe(F.col("__key")) if null_safe else column == F.col("__key")
    return left.join(match, same, how).drop("__key")


def group_stats(df: DataFrame, key: str, aggregates: Sequence[Column]) -> DataFrame:
    """Stored aggregates per key group (NULL is a group too).

    The groups are aggregated partially before the shuffle, so a key that holds
    most of the rows costs one row per input partition.
    """
    return stage(df.groupBy(as_column(key)).agg(*aggregates), "group-stats")


def attach_group_stats(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Every row with the aggregates of its key group.

    With ``group_stats`` this equals a whole-partition window, but a window
    moves all rows of a key into one task.
    """
    return attach(df, stats, key, "left", null_safe=True)
