"""Contiguous shards of near-equal size, from prefix sums of per-partition totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..sources.staging import stage


def balanced_shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, carry: Sequence[str] = ()
) -> DataFrame:
    """Every row with its shard under the law ``bytes``: contiguous in key order, sizes near equal.

    Rows are range-partitioned by (key, checksum, size, input position), so a key
    that holds many rows is spread. Each partition's byte and row totals are
    prefix-summed (one row per partition), running sums inside a partition add
    to its start, and a row goes to the shard whose equal share of all bytes
    holds the row's middle: a shard differs from the target by less than its
    first and last row.

    Result: ``doc_id``, ``size`` (UTF-8 bytes plus 1; a NULL text counts as
    empty), ``text_crc32`` (0 for NULL), ``law``, ``shard``, ``slot`` (gapless
    from 0 inside the shard, in key order), ``grown_shard`` (NULL under this law)
    and ``row``, a struct of the ``carry`` columns, if any. NULL keys come first;
    rows with equal key, checksum and size are interchangeable. One shard can
    stay empty if a single text is larger than a share. An empty table gives
    no rows. Equal texts are not kept together.
    """
    content = F.coalesce(as_column(text), F.lit(""))
    extra = [F.struct(*[as_column(c) for c in carry]).alias("row")] if carry else []
    rows = df.select(
        as_column(key).alias("doc_id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("position"),
        *extra,
    )
    order = ["doc_id", "text_crc32", "size", "position"]
    ranged = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-rows")

    upto = Window.orderBy("part")  # one row per partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = totals.select(
        "part",
        (F.sum("bytes").over(upto) - F.col("bytes")).alias("bytes_before"),
        (F.sum("rows").over(upto) - F.col("rows")).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(starts, "part").select(
        *[c for c in ranged.columns if c not in ("part", "position")],
        (F.col("rows_before") + F.count(F.lit(1)).over(inside)).alias("nth"),
        F.expr("2 * bytes_before").alias("twice_before"),
        F.sum("size").over(inside).alias("running"),
        "total",
    )
    middle = "(twice_before + 2 * running - size)"
    placed = placed.withColumn("shard", F.expr(f"cast({middle} * {int(shards)} div (2 * total) as int)"))
    placed = stage(placed.drop("twice_before", "running", "total"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first_nth"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first_nth")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if carry else []),
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 16) -> None:
    """Write whole rows as one Parquet folder per shard, in slot order inside each file."""
    placed = balanced_shards(df, key, text, shards, carry=df.columns)
    spread = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
