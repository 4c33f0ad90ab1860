"""Results that are replaced whole or not at all.

``mode("overwrite")`` deletes the old table before the new one is written, and a run that breaks off leaves neither. Here
every version has a folder of its own, and a pointer is moved once the new one is complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import exists

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that the pointer at ``path`` names; None if nothing was published."""
    if not exists(spark, f"{path}/{POINTER}"):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Write the pointer beside the old one and put it in its place by one rename."""
    written, files = _hadoop(spark, f"{path}/.{version}")
    out = files.create(written, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(written), context.makeQualified(_hadoop(spark, f"{path}/{POINTER}")[0]), options)


def publish(df: DataFrame, path: str, keep: int = 1) -> DataFrame:
    """Store ``df`` as the new version of the table at ``path`` and return it.

    Readers see the version before until the pointer moves; it also stays readable for those that have begun. Of older versions the
    ``keep`` newest stay, and the others, also those of runs that broke off, go only after the pointer moved.
    One writer at a time is assumed.
    """
    spark = df.sparkSession
    before = current_version(spark, path)
    number = int(before.split("-")[0]) + 1 if before else 1
    version = f"{number:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/versions/{version}")
    _point_to(spark, path, version)
    folder, files = _hadoop(spark, f"{path}/versions")
    others = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName() != version)
    complete = [v for v in others if exists(spark, f"{path}/versions/{v}/_SUCCESS")]
    kept = set(complete[-keep:]) if keep else set()
    for name in others:
        if name not in kept:
            files.delete(_hadoop(spark, f"{path}/versions/{name}")[0], True)
    return read_published(spark, path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"nothing was published at {path}")
    return spark.read.parquet(f"{path}/versions/{version}")
