"""Describes a data set: which column plays which role, and the thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Names of the behaviour metrics.
METRICS = (
    "avg_transaction_amount",
    "transaction_count",
    "cash_transactions",
    "monthly_income",
    "monthly_expenses",
    "income_expense_ratio",
)


@dataclass(frozen=True)
class LabelGroups:
    """Groups the labels of ``source`` into a few named ones in ``target``."""

    source: str
    target: str
    groups: Mapping[str, Sequence[str]]
    default: str = "Others"

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys([*self.groups, self.default]))


@dataclass(frozen=True)
class ShareRule:
    """Accepts a segmentation by its smallest and largest segment share."""

    min_share: float = 0.01
    max_share: float = 0.45
    min_silhouette: float | None = None

    def __post_init__(self):
        if not 0.0 <= self.min_share <= self.max_share <= 1.0:
            raise ValueError(f"shares must satisfy 0 <= min <= max <= 1: {self}")

    def accepts(self, smallest, largest, silhouette=None):
        """Whether the shares, and the silhouette if the rule names one, pass; takes numbers or columns."""
        inside = (smallest >= self.min_share) & (largest <= self.max_share)
        if self.min_silhouette is None:
            return inside
        if silhouette is None:
            raise ValueError(f"the rule needs a silhouette: {self}")
        return inside & (silhouette > self.min_silhouette)


# The quality target recommended for regulated segmentations.
REGULATOR_RULE = ShareRule(min_share=0.05, max_share=0.30, min_silhouette=0.5)


@dataclass(frozen=True)
class DatasetSpec:
    """Roles of the columns of a transaction table.

    Each column has exactly one type: it is numeric (double) or text. Text
    columns outside ``keep_labels`` get their rare labels collapsed.
    """

    entity: str
    columns: Mapping[str, str]
    numeric: Sequence[str]
    entity_columns: Sequence[str]
    amount: str
    income: str
    expenses: str
    cash: tuple[str, str]
    location: str
    risk_level: str
    risk_scores: Mapping[str, int]
    dummies: Mapping[str, Sequence[str]] = field(default_factory=dict)
    label_groups: Sequence[LabelGroups] = ()
    keep_labels: Sequence[str] = ()
    profiled_categories: Sequence[str] = ()
    sentinels: Sequence[str] = ("None",)
    null_label: str | None = "None"
    other_label: str = "Other"
    rare_share: float = 0.05
    risk_default: int = 1

    def __post_init__(self):
        known = set(self.columns)
        named = {
            "entity": [self.entity],
            "numeric": self.numeric,
            "entity_columns": self.entity_columns,
            "amount": [self.amount],
            "income": [self.income],
            "expenses": [self.expenses],
            "cash": [self.cash[0]],
            "location": [self.location],
            "risk_level": [self.risk_level],
            "dummies": list(self.dummies),
            "label_groups": [g.source for g in self.label_groups],
            "keep_labels": self.keep_labels,
            "profiled_categories": self.profiled_categories,
        }
        for role, names in named.items():
            unknown = sorted(set(names) - known)
            if unknown:
                raise ValueError(f"{role} names unknown columns: {unknown}")
        if self.entity not in self.entity_columns:
            raise ValueError(f"entity_columns must contain the entity key {self.entity!r}")
        clash = sorted(set(self.numeric) & ({self.entity, *self.dummies, *self.profiled_categories}))
        if clash:
            raise ValueError(f"columns are numeric and categorical at once: {clash}")
        for name in (self.amount, self.income, self.expenses):
            if name not in self.numeric:
                raise ValueError(f"{name!r} must be numeric")

    @property
    def text(self) -> list[str]:
        return [c for c in self.columns if c not in set(self.numeric)]

    @property
    def collapsed(self) -> list[str]:
        """Text columns whose rare labels are replaced."""
        exempt = {self.entity, *self.keep_labels}
        return [c for c in self.text if c not in exempt]

    @property
    def entity_dummies(self) -> dict[str, Sequence[str]]:
        return {c: v for c, v in self.dummies.items() if c in set(self.entity_columns)}

    @property
    def event_dummies(self) -> dict[str, Sequence[str]]:
        return {c: v for c, v in self.dummies.items() if c not in set(self.entity_columns)}

    @property
    def transaction_keys(self) -> list[str]:
        """Columns that tell transactions apart as far as the data allows."""
        return [self.entity, self.amount, *self.event_dummies]

    @property
    def entity_numeric(self) -> list[str]:
        return [c for c in self.entity_columns if c in set(self.numeric)]

    def raw_schema(self) -> T.StructType:
        """All-text schema; each field's comment is the column description."""
        return T.StructType(
            [
                T.StructField(name, T.StringType(), True, {"comment": text})
                for name, text in self.columns.items()
            ]
        )

    def with_(self, **changes) -> DatasetSpec:
        return replace(self, **changes)
