"""Entity profiling and segmentation on Spark."""

from .spec import METRICS, REGULATOR_RULE, DatasetSpec, LabelGroups, ShareRule

__all__ = ["METRICS", "REGULATOR_RULE", "DatasetSpec", "LabelGroups", "ShareRule"]
