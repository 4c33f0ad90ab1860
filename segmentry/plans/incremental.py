"""Half-yearly re-runs that read new files only.

A ledger lists the files already taken in. A batch of new files is parsed once and leaves two small tables behind: a
roll-up per entity version and event labels, and quantile sketches. Both can be merged, so the entity table and the
medians over all batches need no file of an earlier one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_columns
from ..operators.entities import collapsed_rollup, entities_of, label_rollup, merged_rollup, rollup_labels
from ..operators.sketches import merge_sketches, quantile_sketches, sketch_quantiles
from ..sources.staging import stage
from ..sources.tables import exists, manifest, scan_csv
from ..spec import DatasetSpec

LEDGER = "path string, length long, modified timestamp, batch string, spec string"


@dataclass(frozen=True)
class History:
    """What was taken in so far, in the folder ``state``, for one data set."""

    spark: SparkSession
    state: str
    spec: DatasetSpec

    def ledger(self) -> DataFrame:
        """One row per file taken in."""
        path = f"{self.state}/ledger"
        known = exists(self.spark, f"{path}/_SUCCESS")
        return self.spark.read.schema(LEDGER).parquet(path) if known else self.spark.createDataFrame([], LEDGER)

    def new_files(self, source: str) -> list[tuple]:
        """``path, length, modified`` of the files below ``source`` that are not in the ledger; none is opened.

        A file that changed since it was taken in is an error: its old rows cannot be taken out of the sums.
        """
        found = self.spark.read.format("binaryFile").load(source)
        listed = found.select("path", "length", F.col("modificationTime").alias("modified"))
        ledger = self.ledger().select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), "spec")
        joined = listed.join(ledger, "path", "left")
        same = (F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified"))
        rows = joined.filter(F.col("spec").isNull() | ~same | (F.col("spec") != manifest("spec", self.spec))).collect()
        changed = sorted(r["path"] for r in rows if r["spec"] is not None)
        if changed:
            raise ValueError(f"files changed, or were taken in for another data set: {changed}")
        return sorted((r["path"], r["length"], r["modified"]) for r in rows)

    def take_in(self, source: str) -> int:
        """Add the new files below ``source`` and return their number.

        The batch's tables are named after its files and complete before the ledger names them: a run that breaks
        off leaves the ledger as it was, and the next one writes the same batch again.
        """
        files = self.new_files(source)
        if not files:
            return 0
        batch = manifest("batch", *files)
        typed = clean_columns(scan_csv(self.spark, [path for path, _, _ in files], self.spec.raw_schema()), self.spec)
        typed = stage(typed, "typed-batch")
        tables = {"rollup": label_rollup(typed, self.spec), "sketches": quantile_sketches(typed, list(self.spec.numeric))}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.state}/{name}/{batch}")
        digest = manifest("spec", self.spec)
        rows = self.spark.createDataFrame([(*file, batch, digest) for file in files], LEDGER)
        rows.coalesce(1).write.mode("append").parquet(f"{self.state}/ledger")
        return len(files)

    def _parts(self, name: str) -> DataFrame:
        batches = [r["batch"] for r in self.ledger().select("batch").distinct().collect()]  # one row per run
        if not batches:
            raise ValueError(f"nothing was taken in yet: {self.state}")
        return self.spark.read.parquet(*[f"{self.state}/{name}/{b}" for b in sorted(batches)])

    def entities(self) -> DataFrame:
        """The entity table of all batches, with the labels that are rare over all of them collapsed."""
        rollup = stage(merged_rollup(self._parts("rollup"), self.spec), "merged-rollup")
        return entities_of(collapsed_rollup(rollup, rollup_labels(rollup, self.spec), self.spec), self.spec)

    def quantiles(self, ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
        """``(column, rows, rank, value)`` of the numeric columns over all batches, from their sketches."""
        return sketch_quantiles(merge_sketches(self._parts("sketches")), ranks).drop("group")
