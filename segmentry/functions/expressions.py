"""Null-safe, ANSI-safe column expressions.

Every function takes a column name (or Column) and returns a Column, so a
whole cleaning or feature step collapses into a single ``select``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Backtick a column name, so that names holding dots or blanks resolve."""
    return "`" + name.replace("`", "``") + "`"


def as_column(column: str | Column) -> Column:
    return column if isinstance(column, Column) else F.col(quoted(column))


def sentinel_null(column: str | Column, sentinels: Sequence[str]) -> Column:
    """NULL where the trimmed text is one of the missing markers."""
    col = as_column(column)
    if not sentinels:
        return col
    return F.when(~F.trim(col.cast("string")).isin(*sentinels), col)


def normal_text(column: str | Column, sentinels: Sequence[str] = ()) -> Column:
    """Trimmed, lower-cased text; missing markers are matched before lower-casing."""
    text = F.trim(as_column(column).cast("string"))
    return F.lower(F.when(~text.isin(*sentinels), text) if sentinels else text)


def to_number(column: str | Column, sentinels: Sequence[str] = ()) -> Column:
    """Double, or NULL for text that is no number (NaN counts as missing too)."""
    number = sentinel_null(column, sentinels).try_cast("double")
    return F.nullif(number, F.lit(float("nan")))


def zero_filled(column: str | Column) -> Column:
    """Double with missing, unparsable and NaN values replaced by 0.0."""
    return F.coalesce(to_number(column), F.lit(0.0))


def missing(column: str | Column, sentinel: str = "None") -> Column:
    """True where a cell is NULL or its text contains the missing marker."""
    col = as_column(column)
    return col.isNull() | col.cast("string").contains(sentinel)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient that is NULL (not an error) for a zero denominator."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def ordinal(column: str | Column, scores: Mapping[str, int], default: int = 1) -> Column:
    """Integer score per label; unknown and NULL labels get the default."""
    return F.coalesce(_lookup(scores)[as_column(column)], F.lit(default))


def grouped(column: str | Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """Name of the group that lists the label, else the default."""
    by_label = {label: name for name, labels in groups.items() for label in labels}
    return F.coalesce(_lookup(by_label)[as_column(column)], F.lit(default))


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def indicator(column: str | Column, label: str, null_label: str | None = "None") -> Column:
    """1 where the column holds the label, else 0 (never NULL).

    The label equal to ``null_label`` marks missing cells; with
    ``null_label=None`` it is compared like any other text.
    """
    col = as_column(column)
    if null_label is not None and label == null_label:
        return col.isNull().cast("int")
    return col.eqNullSafe(F.lit(label)).cast("int")


def indicator_median(ones: str | Column, rows: str | Column) -> Column:
    """Exact median of a 0/1 indicator from its sum and its row count.

    The median is 0, 0.5 or 1 depending on whether ones are the minority, half
    or the majority, so two partially aggregated sums replace a percentile
    buffer per group.
    """
    return (F.lit(1.0) + F.signum(F.lit(2.0) * as_column(ones) - as_column(rows))) / F.lit(2.0)


def key_hash(keys: Sequence[str]) -> Column:
    """Hex digest of the key values: a layout-independent pseudo-random order."""
    if len(keys) == 1:
        return F.md5(F.coalesce(as_column(keys[0]).cast("string"), F.lit("")))
    return F.md5(F.xxhash64(*[as_column(k) for k in keys]).cast("string"))


def hash_bound(fraction: float) -> str:
    """First eight hex digits below which a ``fraction`` of all digests lies.

    A bound of 1 or more sorts after every digest.
    """
    if not 0.0 <= fraction:
        raise ValueError(f"fraction must not be negative: {fraction}")
    if fraction >= 1.0:
        return "g"
    return f"{math.ceil(fraction * 2**32):08x}"
