"""All registered queries; importing the modules registers them."""

from . import (  # noqa: F401
    catalog_cleaning,
    catalog_features,
    catalog_flow,
    catalog_history,
    catalog_profile,
    catalog_segments,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
