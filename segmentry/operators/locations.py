"""Location averages, ordinal risk scores and reproducible samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column, hash_bound, key_hash, ordinal
from ..spec import DatasetSpec
from .joins import attach_group_stats, group_stats


def location_stats(df: DataFrame, location: str, amount: str) -> DataFrame:
    """Stored average and count of the amounts per location."""
    return group_stats(
        df,
        location,
        [
            F.avg(as_column(amount)).alias("avg_transaction_by_location"),
            F.count(as_column(amount)).alias("transaction_frequency"),
        ],
    )


def location_window(df: DataFrame, location: str, amount: str) -> DataFrame:
    """Every row with the average and the count of the amounts at its location."""
    return attach_group_stats(df, location_stats(df, location, amount), location)


def risk_score(df: DataFrame, column: str, scores: Mapping[str, int], default: int = 1) -> DataFrame:
    return df.withColumn("risk_score", ordinal(column, scores, default))


def hash_sample(df: DataFrame, fraction: float, keys: Sequence[str] | None = None) -> DataFrame:
    """A Bernoulli sample without replacement that does not depend on the layout.

    A row is drawn when the digest of its key (all columns by default) falls
    below the fraction. The filter needs no shuffle.
    """
    return df.filter(key_hash(keys or df.columns) < F.lit(hash_bound(fraction)))


def risk_patterns(
    df: DataFrame, spec: DatasetSpec, fraction: float = 0.1, keys: Sequence[str] | None = None
) -> DataFrame:
    """Sampled rows with their location's average and count and their risk score.

    The location figures come from all rows. The rows to list are sampled before
    the figures are joined to them, which gives the same table as sampling last.
    ``keys`` identify a transaction; by default the entity, the amount and the
    event labels do, so that equal transactions are drawn together.
    """
    listed = hash_sample(df, fraction, keys or spec.transaction_keys).select(as_column(spec.location), as_column(spec.risk_level))
    listed = risk_score(listed, spec.risk_level, spec.risk_scores, spec.risk_default)
    stats = location_stats(df, spec.location, spec.amount)
    return attach_group_stats(listed, stats, spec.location).select(
        as_column(spec.location), "avg_transaction_by_location", "transaction_frequency", "risk_score"
    )


def profile_sample(df: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """The ``size`` rows with the smallest key digests (all rows of a smaller table).

    Digests are uniform, so a bound slightly above the wanted share of the rows
    leaves little to sort. If too few rows pass, the bound is widened, so the
    result is always the same as that of sorting the whole table.
    """
    digests = df.withColumn("__digest", key_hash(keys))
    share = (size + 10 * math.sqrt(size) + 10) / max(df.count(), 1)
    while True:
        candidates = digests.filter(F.col("__digest") < F.lit(hash_bound(share)))
        if share >= 1.0 or candidates.count() >= size:
            break
        share *= 4
    return candidates.orderBy("__digest", *[as_column(k) for k in keys]).limit(size).drop("__digest")
