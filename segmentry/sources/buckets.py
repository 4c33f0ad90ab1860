"""Tables kept in buckets of the entity key, so that joins and aggregates on it move no rows.

A table is shuffled once, when it is stored. Every later join with another table of the same buckets, and every
aggregate by the key, reads its bucket where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column, quoted
from .staging import fresh_path


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as the table ``name`` in ``buckets`` files sorted by ``key`` and return it.

    The files lie at ``path``, by default in the shared folder. Rows are dealt to the buckets
    before they are written, so each bucket is one file whatever the number of tasks. A key that holds many rows fills one
    bucket: meant for tables with few rows per key, as entities, their totals and features are.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    dealt = df.repartition(buckets, as_column(key))
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return spark.table(quoted(name))


def join_bucketed(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join two tables of the same buckets, ``right`` with one row per key; NULL keys match nothing.

    The hint keeps the join bucket by bucket even where ``right`` is small enough to be copied to all tasks: both
    sides are sorted already, and nothing is moved at all.
    """
    values = [as_column(c) for c in right.columns if c != key]
    match = right.select(as_column(key).alias("__key"), *values).hint("merge")
    return left.join(match, as_column(key) == F.col("__key"), how).drop("__key")
