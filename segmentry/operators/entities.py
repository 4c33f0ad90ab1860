"""From transactions to entities: versions, behaviour, medians, joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column, indicator, indicator_median, ratio
from ..sources.staging import stage
from ..spec import METRICS, DatasetSpec
from .cleaning import RareLabels
from .joins import attach


def distinct_entities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per entity version. A key with changed attributes has several."""
    return df.select(*[as_column(c) for c in columns]).distinct()


def entity_conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, versions)`` of the keys that have more than one version."""
    versions = distinct_entities(df, columns).groupBy(as_column(key)).agg(F.count(F.lit(1)).alias("versions"))
    return versions.filter(F.col("versions") > 1)


def _is_cash(spec: DatasetSpec) -> Column:
    column, label = spec.cash
    return as_column(column) == F.lit(label)


def _with_ratio(behavior: DataFrame, *kept: Column) -> DataFrame:
    return behavior.select(
        *kept,
        *[F.col(m) for m in METRICS[:-1]],
        ratio("monthly_income", "monthly_expenses").alias(METRICS[-1]),
    )


def entity_behavior(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Behaviour metrics per entity key, straight from the transactions."""
    behavior = df.groupBy(as_column(spec.entity)).agg(
        F.avg(as_column(spec.amount)).alias("avg_transaction_amount"),
        F.count(as_column(spec.amount)).alias("transaction_count"),
        F.count_if(_is_cash(spec)).alias("cash_transactions"),
        F.max(as_column(spec.income)).alias("monthly_income"),
        F.max(as_column(spec.expenses)).alias("monthly_expenses"),
    )
    return _with_ratio(behavior, as_column(spec.entity))


def _event_indicators(spec: DatasetSpec) -> list[tuple[str, Column]]:
    return [
        (f"{c}_{label}_median", indicator(c, label, spec.null_label))
        for c, labels in spec.event_dummies.items()
        for label in labels
    ]


def entity_medians(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Exact median of every event indicator per entity key."""
    indicators = _event_indicators(spec)
    rows = F.count(F.lit(1))
    return df.groupBy(as_column(spec.entity)).agg(
        *[indicator_median(F.sum(flag), rows).alias(name) for name, flag in indicators]
    )


def entity_join(entities: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """All entities with their metrics (one row per key); NULL keys match nothing."""
    return attach(entities, stage(metrics, "metrics"), key)


def entity_rollup(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row per entity version with sums that can be added up further.

    A single scan of the transactions feeds the distinct entities, their
    behaviour and their indicator medians. Everything after it works on
    entities instead of transactions.
    """
    return df.groupBy(*[as_column(c) for c in spec.entity_columns]).agg(
        F.count(F.lit(1)).alias("__events"),
        F.sum(as_column(spec.amount)).alias("__amount"),
        F.count(as_column(spec.amount)).alias("__amounts"),
        F.count_if(_is_cash(spec)).alias("__cash"),
        F.max(as_column(spec.income)).alias("__income"),
        F.max(as_column(spec.expenses)).alias("__expenses"),
        *[F.sum(flag).alias(f"__{name}") for name, flag in _event_indicators(spec)],
    )


def rollup_totals(rollup: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Behaviour metrics and indicator medians per entity key, from the roll-up."""
    names = [name for name, _ in _event_indicators(spec)]
    totals = rollup.groupBy(as_column(spec.entity)).agg(
        F.try_divide(F.sum("__amount"), F.sum("__amounts")).alias("avg_transaction_amount"),
        F.sum("__amounts").alias("transaction_count"),
        F.sum("__cash").alias("cash_transactions"),
        F.max("__income").alias("monthly_income"),
        F.max("__expenses").alias("monthly_expenses"),
        *[indicator_median(F.sum(as_column(f"__{n}")), F.sum("__events")).alias(n) for n in names],
    )
    metrics = _with_ratio(totals, as_column(spec.entity), *[as_column(n) for n in names])
    return metrics.select(as_column(spec.entity), *[F.col(m) for m in METRICS], *[as_column(n) for n in names])


def entity_table(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Entity versions with the behaviour metrics and indicator medians of their key.

    Both the roll-up and its totals are stored in the shared folder: the
    transactions are read once, although the roll-up is used twice.
    """
    return entities_of(entity_rollup(df, spec), spec)


def entities_of(rollup: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The entity table of a roll-up."""
    rollup = stage(rollup, "entity-rollup")
    totals = stage(rollup_totals(rollup, spec), "entity-totals")
    versions = rollup.select(*[as_column(c) for c in spec.entity_columns])
    return attach(versions, totals, spec.entity)


def label_columns(spec: DatasetSpec) -> list[str]:
    """The columns besides an entity's own whose labels the entity table depends on."""
    return list(dict.fromkeys([*spec.event_dummies, *([] if spec.cash[0] in spec.entity_columns else [spec.cash[0]])]))


def label_rollup(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Sums per entity version and event labels, from typed transactions whose rare labels are not collapsed yet.

    Which labels are rare can change with every batch, so the labels stay keys; everything else adds up. Batches are
    put together by ``merged_rollup``, and ``collapsed_rollup`` gives the roll-up of the collapsed transactions.
    """
    return df.groupBy(*[as_column(c) for c in (*spec.entity_columns, *label_columns(spec))]).agg(
        F.count(F.lit(1)).alias("__events"),
        F.sum(as_column(spec.amount)).alias("__amount"),
        F.count(as_column(spec.amount)).alias("__amounts"),
        F.max(as_column(spec.income)).alias("__income"),
        F.max(as_column(spec.expenses)).alias("__expenses"),
    )


def merged_rollup(parts: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One ``label_rollup`` from those of several batches."""
    keys = [*spec.entity_columns, *label_columns(spec)]
    sums = [F.sum(c).alias(c) for c in ("__events", "__amount", "__amounts")]
    return parts.groupBy(*[as_column(c) for c in keys]).agg(*sums, *[F.max(c).alias(c) for c in ("__income", "__expenses")])


def collapsed_rollup(rollup: DataFrame, labels: RareLabels, spec: DatasetSpec) -> DataFrame:
    """The ``entity_rollup`` of the transactions behind a ``label_rollup``, their rare labels collapsed."""
    kept = RareLabels({c: v for c, v in labels.kept.items() if c in rollup.columns}, labels.other)
    events = F.col("__events")
    return kept.transform(rollup).groupBy(*[as_column(c) for c in spec.entity_columns]).agg(
        F.sum("__events").alias("__events"),
        F.sum("__amount").alias("__amount"),
        F.sum("__amounts").alias("__amounts"),
        F.sum(F.when(_is_cash(spec), events).otherwise(0)).alias("__cash"),
        F.max("__income").alias("__income"),
        F.max("__expenses").alias("__expenses"),
        *[F.sum(flag * events).alias(f"__{name}") for name, flag in _event_indicators(spec)],
    )


def rollup_labels(rollup: DataFrame, spec: DatasetSpec) -> RareLabels:
    """The frequent labels of the roll-up's columns: the same as from the transactions, since their numbers are kept."""
    columns = [c for c in spec.collapsed if c in rollup.columns]
    return RareLabels.fit(rollup, columns, spec.rare_share, spec.other_label, weight="__events")
