"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage: a lost executor re-reads Parquet instead of
re-running everything above it, and its row count is known from the footers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Folder for the tables staged on the way to another one, while that one is computed.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which all executors share, or else one below the warehouse.

    On a cluster, a warehouse in a local folder (the default where nobody set it) is an error: each executor
    would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staging"
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master) and re.match(r"file:|/|[^:]*$", folder):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master}, found {folder})")
    return folder.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/segmentry/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{_SCRATCH.get() or _session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> None:
    """Write a table whose shuffle files go with the end of the write; otherwise they stay until the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP, "false")
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def stage_next(df: DataFrame, name: str, before: str | None) -> tuple[DataFrame, str]:
    """``stage(df, name)`` and its path; the staged table at ``before``, from which ``df`` was made, is then deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _write(df, path)
    if before:
        _delete(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def stage_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stage(build(), name)``; the tables that ``build`` stages on the way are deleted once the result is written."""
    path = fresh_path(spark, name)
    scratch = fresh_path(spark, f"{name}-scratch")
    before = _SCRATCH.set(scratch)
    try:
        df = build()
        _write(df, path)
    finally:
        _SCRATCH.reset(before)
        _delete(spark, scratch)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_meanwhile(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stage(df, name)``; the table is deleted when the block ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    try:
        _write(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application, once no table built on them is needed."""
    _delete(spark, _session_folder(spark))
