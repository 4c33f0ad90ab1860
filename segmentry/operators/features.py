"""Entity features: dummies, grouped labels, and the feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column, grouped, indicator
from ..spec import METRICS, DatasetSpec, LabelGroups
from .cleaning import fill_missing, label_counts, normalize_columns, normalize_names, require_columns
from .entities import entity_table


def _dummies(vocabulary: Mapping[str, Sequence[str]], null_label: str | None):
    return [
        indicator(c, label, null_label).alias(f"{c}_{label}") for c, labels in vocabulary.items() for label in labels
    ]


def fixed_dummies(
    df: DataFrame, vocabulary: Mapping[str, Sequence[str]], null_label: str | None = "None"
) -> DataFrame:
    """Adds a 0/1 column per label, named ``column_label``."""
    return df.select("*", *_dummies(vocabulary, null_label))


def label_grouping(df: DataFrame, groups: LabelGroups) -> DataFrame:
    return df.withColumn(groups.target, grouped(groups.source, groups.groups, groups.default))


@dataclass(frozen=True)
class Vocabulary:
    """The labels found in each column, kept so that other data gets the same dummies."""

    labels: Mapping[str, Sequence[str]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], max_labels: int | None = None) -> Vocabulary:
        """Distinct non-NULL labels. Every label becomes a column; with ``max_labels``, a column with more is an error."""
        counts = label_counts(df, columns).filter(F.col("value").isNotNull()).select("column", "value")
        found = (counts if max_labels is None else counts.limit(len(columns) * max_labels + 1)).collect()
        labels = {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}
        wide = sorted(c for c, values in labels.items() if max_labels is not None and len(values) > max_labels)
        if wide:
            raise ValueError(f"too many labels for dummies (limit {max_labels}): {wide}")
        return cls({c: tuple(values) for c, values in labels.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return fixed_dummies(df, self.labels, null_label=None)


def fitted_dummies(df: DataFrame, columns: Sequence[str], max_labels: int | None = None) -> DataFrame:
    return Vocabulary.fit(df, columns, max_labels).transform(df)


def build_features(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row per entity version: key, numbers, metrics, dummies, medians.

    Grouped labels get a dummy for each declared group, present or not, so the
    columns do not vary with the data.
    """
    entities = entity_table(df, spec)
    medians = [c for c in entities.columns if c not in {*spec.entity_columns, *METRICS}]
    for groups in spec.label_groups:
        entities = label_grouping(entities, groups)
    return entities.select(
        as_column(spec.entity),
        *[as_column(c) for c in spec.entity_numeric],
        *[F.col(m) for m in METRICS],
        *_dummies(spec.entity_dummies, spec.null_label),
        *_dummies({g.target: g.labels for g in spec.label_groups}, None),
        *[as_column(c) for c in medians],
    )


def feature_names(spec: DatasetSpec) -> tuple[list[str], list[str]]:
    """Normalised names of the numeric and of the dummy features of a data set."""
    numeric = normalize_names([*spec.entity_numeric, *METRICS])
    dummies = [f"{c}_{label}" for c, labels in spec.entity_dummies.items() for label in labels]
    dummies += [f"{g.target}_{label}" for g in spec.label_groups for label in g.labels]
    dummies += [f"{c}_{label}_median" for c, labels in spec.event_dummies.items() for label in labels]
    return numeric, normalize_names(dummies)


def model_features(features: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Feature table ready for a model: clean names, no missing numbers, all checked."""
    numeric, categorical = feature_names(spec)
    table = normalize_columns(features)
    require_columns(table, numeric, categorical)
    return fill_missing(table, [*numeric, *categorical])
