"""Column expressions shared by the operators. All of them run in the JVM."""

from .expressions import (
    grouped,
    indicator,
    indicator_median,
    key_hash,
    hash_bound,
    missing,
    normal_text,
    ordinal,
    ratio,
    sentinel_null,
    to_number,
    zero_filled,
)

__all__ = [
    "grouped",
    "hash_bound",
    "indicator",
    "indicator_median",
    "key_hash",
    "missing",
    "normal_text",
    "ordinal",
    "ratio",
    "sentinel_null",
    "to_number",
    "zero_filled",
]
