"""Cleaning of all-text tables and the rare-label collapse.

Each step is one ``select`` over all columns, so Catalyst sees a flat
projection instead of a chain that grows with the number of columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import as_column, normal_text, quoted, sentinel_null, to_number, zero_filled
from ..spec import DatasetSpec


def replaced(df: DataFrame, changes: Mapping) -> DataFrame:
    """``df`` with the given columns replaced, in one projection."""
    return df.select(*[changes[c].alias(c) if c in changes else as_column(c) for c in df.columns])


def sentinel_to_null(df: DataFrame, sentinels: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    columns = df.columns if columns is None else columns
    return replaced(df, {c: sentinel_null(c, sentinels) for c in columns})


def numeric_cast(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = ()) -> DataFrame:
    return replaced(df, {c: to_number(c, sentinels) for c in columns})


def text_normalize(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = ()) -> DataFrame:
    return replaced(df, {c: normal_text(c, sentinels) for c in columns})


def clean_columns(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Missing markers to NULL, numbers to double, text trimmed and lower-cased."""
    return df.select(
        *[
            (to_number(c, spec.sentinels) if c in set(spec.numeric) else normal_text(c, spec.sentinels)).alias(
                c, metadata={"comment": text}
            )
            for c, text in spec.columns.items()
        ]
    )


def label_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(column, value, rows)`` of every label of every given column, in one scan.

    Labels are counted per input partition before the shuffle, so a label that
    holds most of the rows costs one row per partition. NULL is listed too. With ``weight``, a row of ``df``
    stands for as many rows as that column says.
    """
    kept = [] if weight is None else [as_column(weight).alias("__weight")]
    cells = df.select(*kept, *[as_column(c).cast("string").alias(c) for c in columns]).unpivot(
        ["__weight"] if kept else [], [quoted(c) for c in columns], "column", "value"
    )
    return cells.groupBy("column", "value").agg((F.sum("__weight") if kept else F.count(F.lit(1))).alias("rows"))


def label_shares(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(column, value, rows, share)``; the NULL label counts in the total.

    The totals have one row per column of the table and are safe to broadcast.
    """
    counts = label_counts(df, columns, weight)
    totals = counts.groupBy("column").agg(F.sum("rows").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "rows", (F.col("rows") / F.col("total")).alias("share")
    )


# Labels that a frequent-items summary tracks per wanted one: its counts are then off by far less than the share asked for.
TRACKED = 100


def frequent_candidates(df: DataFrame, columns: Sequence[str], min_share: float) -> tuple[dict[str, list[str]], int]:
    """Per column all labels that may have the share, at most ``2 / min_share``, and the number of rows; one scan.

    At most ``1 / min_share`` labels can have the share. The summary's counts are off by less than a twentieth of it, so
    none of them is behind the first ``2 / min_share`` by estimate. Each task passes on one summary per column.
    """
    if not 0.0 < min_share <= 1.0:
        raise ValueError(f"min_share must be in (0, 1]: {min_share}")
    wanted = math.ceil(2 / min_share)
    top = [
        F.call_function("approx_top_k", as_column(c).cast("string"), F.lit(wanted), F.lit(wanted * TRACKED)).alias(f"t{i}")
        for i, c in enumerate(columns)
    ]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *top).first()
    candidates = {c: [e["item"] for e in found[f"t{i}"] or [] if e["item"] is not None] for i, c in enumerate(columns)}
    return candidates, found["rows"]


def candidate_counts(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(column, value, rows)`` of the candidates only; nothing else is shuffled."""
    listed = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.when(text.isin(*labels), text).alias("value"))
            for c, labels in candidates.items()
            if labels
            for text in [as_column(c).cast("string")]
        ]
    )
    if not any(candidates.values()):
        return df.sparkSession.createDataFrame([], "column string, value string, rows long")
    cells = df.select(F.inline(listed)).filter(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class RareLabels:
    """The labels of each column that are frequent enough to be kept.

    At a minimum share ``t`` no column keeps more than ``1/t`` labels, so the
    fitted state stays small however many rare labels the data has.
    """

    kept: Mapping[str, Sequence[str]]
    other: str = "Other"

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str], min_share: float = 0.05, other: str = "Other", weight: str | None = None
    ) -> RareLabels:
        if not 0.0 < min_share <= 1.0:
            raise ValueError(f"min_share must be in (0, 1]: {min_share}")
        if not columns:
            return cls({}, other)
        frequent = (
            label_shares(df, columns, weight)
            .filter(F.col("value").isNotNull() & (F.col("share") >= F.lit(float(min_share))))
            .select("column", "value")
            .collect()
        )
        kept = {c: [] for c in columns}
        for row in frequent:
            kept[row["column"]].append(row["value"])
        return cls({c: tuple(sorted(v)) for c, v in kept.items()}, other)

    @classmethod
    def fit_bounded(cls, df: DataFrame, columns: Sequence[str], min_share: float = 0.05, other: str = "Other") -> RareLabels:
        """The same labels as ``fit`` in two scans whose state does not grow with the number of labels.

        The first scan keeps a frequent-items summary per task and column, which is sure to hold every label of the
        share asked for; the second one counts these candidates exactly. ``fit`` shuffles every distinct label of every
        column instead: the better way for few labels, and the worse one for columns that are nearly keys.
        """
        if not columns:
            return cls({}, other)
        candidates, rows = frequent_candidates(df, columns, min_share)
        counts = candidate_counts(df, candidates).collect()  # at most 2 / min_share rows per column
        kept = {c: [] for c in columns}
        for row in counts:
            if row["rows"] / rows >= min_share:
                kept[row["column"]].append(row["value"])
        return cls({c: tuple(sorted(v)) for c, v in kept.items()}, other)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``(column, value)``; a column that keeps no label has one NULL row."""
        rows = [(c, v) for c, labels in self.kept.items() for v in (labels or [None])]
        return spark.createDataFrame(rows, "column string, value string")

    @classmethod
    def from_table(cls, table: DataFrame, other: str = "Other") -> RareLabels:
        kept: dict[str, list[str]] = {}
        for row in table.collect():
            kept.setdefault(row["column"], []).extend([] if row["value"] is None else [row["value"]])
        return cls({c: tuple(sorted(v)) for c, v in kept.items()}, other)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace every label that is not kept; NULL stays NULL."""
        return replaced(df, {c: self._collapse(c, labels) for c, labels in self.kept.items()})

    def _collapse(self, column: str, labels: Sequence[str]):
        col = as_column(column)
        rare = ~col.cast("string").isin(*labels) if labels else col.isNotNull()
        return F.when(rare, F.lit(self.other)).otherwise(col.cast("string"))


def rare_label_collapse(
    df: DataFrame, columns: Sequence[str], min_share: float = 0.05, other: str = "Other"
) -> DataFrame:
    return RareLabels.fit(df, columns, min_share, other).transform(df)


def fit_labels(cleaned: DataFrame, spec: DatasetSpec) -> RareLabels:
    return RareLabels.fit(cleaned, spec.collapsed, spec.rare_share, spec.other_label)


def preprocess(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Clean all columns, then collapse the rare labels of the categorical ones.

    The label shares take one pass over ``df``. When ``df`` is a CSV scan, store
    ``clean_columns`` as Parquet first and fit the labels on that, as the whole
    flow does: the text is then parsed once.
    """
    cleaned = clean_columns(df, spec)
    return fit_labels(cleaned, spec).transform(cleaned)


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0.0 for NULL, NaN and unparsable cells of numeric columns."""
    return replaced(df, {c: zero_filled(c) for c in columns})


def normalize_names(names: Sequence[str]) -> list[str]:
    """Lower-case identifiers without blanks and punctuation; fails on collisions."""
    cleaned = [re.sub(r"[.,]", "", re.sub(r"[ /-]", "_", n.lower())).replace("&", "and") for n in names]
    clashes = {c: [n for n, m in zip(names, cleaned) if m == c] for c in cleaned if cleaned.count(c) > 1}
    if clashes:
        raise ValueError(f"column names collide after normalisation: {clashes}")
    return cleaned


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_names(df.columns))


def missing_columns(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, list[str]]:
    """Required columns that the table lacks, by role; empty lists mean all is well."""
    present = set(df.columns)
    return {
        "numeric": sorted(set(numeric) - present),
        "categorical": sorted(set(categorical) - present),
    }


def require_columns(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> None:
    lacking = missing_columns(df, numeric, categorical)
    if any(lacking.values()):
        raise ValueError(f"required columns are missing: {lacking}")
