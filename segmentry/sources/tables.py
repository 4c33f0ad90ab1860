"""CSV and Parquet scans and sinks, compute-or-load, reports and rankings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage

RANKING_SCHEMA = T.StructType(
    [
        T.StructField("feature", T.StringType(), False),
        T.StructField("importance", T.DoubleType(), False),
        T.StructField("rank", T.IntegerType(), False),
    ]
)


def scan_csv(spark: SparkSession, path: str | list[str], expected: T.StructType | None = None) -> DataFrame:
    """All files of a CSV folder, or the listed ones, as one all-text table named by their header.

    With ``expected``, missing and unknown columns are rejected up front, the
    columns come back in the expected order with their comments, and every
    file's header is checked against the first one while it is read.
    """
    reader = spark.read.option("header", True)
    if expected is None:
        return reader.csv(path)
    found = reader.csv(path).columns
    absent = [c for c in expected.fieldNames() if c not in found]
    unknown = [c for c in found if c not in expected.fieldNames()]
    if absent or unknown:
        raise ValueError(f"{path}: missing columns {absent}, unknown columns {unknown}")
    in_file_order = T.StructType([expected[c] for c in found])
    table = reader.option("enforceSchema", False).schema(in_file_order).csv(path)
    return table.select(*expected.fieldNames())


CORRUPT = "_corrupt"


def scan_csv_checked(spark: SparkSession, path: str | list[str], expected: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows, and ``file, line`` of those that have too many or too few cells.

    ``scan_csv`` fills up or cuts such lines, which moves later cells into wrong columns unseen. Headers are
    checked as there. The files are parsed once, into the shared folder; a line is in exactly one of the two tables.
    """
    in_file_order = scan_csv(spark, path, expected)  # checks the header
    found = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([*[expected[c] for c in found], T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.option("header", True).option("enforceSchema", False)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)
    rows = stage(rows.select("*", F.col("_metadata.file_path").alias("file")), "parsed-csv")
    good = rows.filter(F.col(CORRUPT).isNull()).select(*in_file_order.columns)
    return good, rows.filter(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("line"))


def quarantine(bad: DataFrame, path: str) -> DataFrame:
    """Keep the malformed lines at ``path`` and return their number per file."""
    return write_parquet(bad, path).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Overwrite ``path`` and return the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path exists on its (possibly remote) file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def manifest(step: str, *inputs) -> str:
    """Digest of what a step's result depends on: its name, its arguments, the manifests of the steps before it."""
    return hashlib.sha256("\n".join([step, *map(repr, inputs)]).encode()).hexdigest()


def source_manifest(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of all files below ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return manifest(path, *sorted(map(tuple, files.collect())))


def is_complete(spark: SparkSession, path: str, wanted: str | None = None) -> bool:
    """Whether the table at ``path`` was written to its end and, given a manifest, for that manifest."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return False
    if wanted is None:
        return True
    return exists(spark, f"{path}.manifest/_SUCCESS") and spark.read.text(f"{path}.manifest").first()[0] == wanted


def store(df: DataFrame, path: str, written_for: str | None = None) -> None:
    """Overwrite the table at ``path``; its manifest follows once the table is complete."""
    if written_for is None:
        df.write.mode("overwrite").parquet(path)
        return
    spark = df.sparkSession
    line = spark.createDataFrame([(written_for,)], "manifest string").coalesce(1)
    spark.createDataFrame([("",)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    df.write.mode("overwrite").parquet(path)
    line.write.mode("overwrite").text(f"{path}.manifest")


def materialize(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], wanted: str | None = None
) -> DataFrame:
    """The table stored at ``path``; built and stored first if it is not complete or has another manifest.

    Only a finished write leaves ``_SUCCESS`` behind, so a half-written folder
    is built again and a real read error is not mistaken for a missing table.
    """
    if not is_complete(spark, path, wanted):
        store(build(), path, wanted)
    return spark.read.parquet(path)


def save_report(report: Mapping[str, DataFrame], path: str) -> None:
    """One Parquet folder per section of a profiling report."""
    for section, table in report.items():
        table.write.mode("overwrite").parquet(f"{path}/{section}")


def load_report(spark: SparkSession, path: str, sections) -> dict[str, DataFrame]:
    return {section: spark.read.parquet(f"{path}/{section}") for section in sections}


def save_ranking(ranking: DataFrame, path: str) -> DataFrame:
    return write_parquet(ranking.select(*RANKING_SCHEMA.fieldNames()), path)


def load_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANKING_SCHEMA).parquet(path)
