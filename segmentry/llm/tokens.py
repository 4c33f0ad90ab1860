"""Flat token files without an index: written in blocks, counted by a scan for separators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column
from ..sources.staging import fresh_path, stage
from .batches import slices
from .bpe import BATCH_BYTES, broadcast_vocabulary, encoder

BLOCK_TOKENS = 1 << 19


def token_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def write_flat(
    docs: DataFrame,
    tokenizer: str,
    separator: str,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Token files of all texts: one file per partition, each text's tokens and then the separator's id.

    A file is stored as its blocks, ``file``, ``block``, ``data``; blocks are cut at a fixed size wherever that falls.
    ``keys``, the keys of the texts that end in a block, is a manifest apart from the data. The separator's
    string inside a text is ordinary text. A NULL text has no tokens, only its separator.
    """
    vocabulary, name = broadcast_vocabulary(docs.sparkSession, tokenizer), tokenizer
    source = docs.select(as_column(key).alias("key"), as_column(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("file", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("data", T.BinaryType()),
            T.StructField("keys", T.ArrayType(source.schema["key"].dataType)),
        ]
    )
    kind = token_type(len(vocabulary.value.token_bytes))
    end_id = vocabulary.value.specials[separator]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, False, name)
        file, block = TaskContext.get().partitionId(), 0
        waiting, keys, held = [], [], 0

        def flush(tokens: np.ndarray, ended: list) -> pa.RecordBatch:
            columns = [
                pa.array([file], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([tokens.tobytes()], pa.binary()),
                pa.array([ended], pa.list_(key_type)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in slices(batch, 1, BATCH_BYTES):
                ids, begins = encode.encode_batch(part.column(1))
                stream = np.insert(ids, begins[1:], end_id).astype(kind)
                ends = begins[1:] + np.arange(part.num_rows) + held  # counted from the start of the open block
                waiting.append(stream)
                keys += zip(ends.tolist(), part.column(0).to_pylist())
                held += len(stream)
                if held < block_tokens:
                    continue
                tokens, at = np.concatenate(waiting), 0
                while held - at >= block_tokens:
                    done = bisect_left(keys, at + block_tokens, key=itemgetter(0))
                    yield flush(tokens[at : at + block_tokens], [k for _, k in keys[:done]])
                    del keys[:done]
                    block += 1
                    at += block_tokens
                waiting, held = [tokens[at:]], held - at
                keys = [(end - at, k) for end, k in keys]
        if held:
            yield flush(np.concatenate(waiting), [k for _, k in keys])

    path = path or fresh_path(docs.sparkSession, "tokens")
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def read_flat(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw token files (up to 2 GB each, Spark's bound for a binary file) for ``count_tokens``."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    starts = F.sequence(F.lit(0), ((F.col("length") - 1) / block_bytes).cast("int"))
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(starts).alias("block"))
    data = F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes))
    return blocks.select("file", "block", data.alias("data"))


def count_tokens(blocks: DataFrame, separator_id: int, kind: np.dtype) -> DataFrame:
    """One row per document of flat token files: ``file``, ``block``, ``nth``, ``start``, ``n_tokens``, ``complete``.

    ``blocks`` holds ``file``, ``block`` and ``data``, whole tokens of the type ``kind``. Each block is searched by
    itself; sums of block sizes give its place in the file and the last separator before it gives the
    start of the document that runs into it, over any number of blocks. ``n_tokens`` leaves the separator out.
    The document is the ``nth`` to end in ``block``. Tokens after a file's last separator are one more row,
    not ``complete``, whose ``nth`` is NULL. A file without tokens gives no row.
    """
    width = kind.itemsize
    schema = T.StructType(
        [
            blocks.schema["file"],
            blocks.schema["block"],
            T.StructField("size", T.LongType()),
            T.StructField("ends", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for value in batch.column(2):
                data = value.as_buffer()
                if data.size % width:
                    raise ValueError("a block does not hold whole tokens")
                tokens = np.frombuffer(data, kind)
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == separator_id).astype(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ends, pa.list_(pa.int32()))], names=schema.fieldNames()
            )

    scanned = stage(blocks.select("file", "block", "data").mapInArrow(run, schema), "token-scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    narrow = scanned.select("file", "block", "size", F.try_element_at("ends", F.lit(-1)).alias("last"))
    offsets = narrow.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    offsets = offsets.withColumn("open", F.max(F.col("offset") + F.col("last") + 1).over(upto))
    offsets = offsets.select(
        "file",
        "block",
        "offset",
        F.coalesce(F.max("open").over(before), F.lit(0)).alias("begun"),
        F.coalesce("open", F.lit(0)).alias("left_open"),
        (F.col("offset") + F.col("size")).alias("upto"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    )
    ended = scanned.join(offsets, ["file", "block"]).select(
        "file", "block", "offset", "begun", "ends", F.posexplode("ends").alias("nth", "end")
    )
    start = F.when(F.col("nth") == 0, F.col("begun")).otherwise(
        F.col("offset") + F.try_element_at("ends", F.greatest("nth", F.lit(1))) + 1
    )
    complete = ended.select("file", "block", "nth", start.alias("start"), (F.col("offset") + F.col("end")).alias("stop"))
    tail = offsets.filter(F.col("final") & (F.col("left_open") < F.col("upto"))).select(
        "file", "block", F.lit(None).cast("int").alias("nth"), F.col("left_open").alias("start"), F.col("upto").alias("stop")
    )
    return complete.union(tail).select(
        "file",
        "block",
        "nth",
        "start",
        (F.col("stop") - F.col("start")).alias("n_tokens"),
        F.col("nth").isNotNull().alias("complete"),
    )


def document_token_counts(docs: DataFrame, tokenizer: str, separator: str = "<|endoftext|>", **options) -> DataFrame:
    """``doc_id``, ``file``, ``start`` and ``n_tokens`` of every text, from token files written and scanned again."""
    blocks = write_flat(docs, tokenizer, separator, **options)
    vocabulary = broadcast_vocabulary(docs.sparkSession, tokenizer).value
    kind = token_type(len(vocabulary.token_bytes))
    counted = count_tokens(blocks.drop("keys"), vocabulary.specials[separator], kind)
    manifest = blocks.select("file", "block", F.posexplode("keys").alias("nth", "doc_id"))
    return manifest.join(counted, ["file", "block", "nth"]).select("doc_id", "file", "start", "n_tokens")
