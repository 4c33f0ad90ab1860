"""Reading and writing tables, reports and models."""

from .staging import checkpoint_dir, drop_staged, stage
from .tables import (
    exists,
    load_ranking,
    load_report,
    materialize,
    save_ranking,
    save_report,
    scan_csv,
    scan_parquet,
    write_parquet,
)

__all__ = [
    "checkpoint_dir",
    "drop_staged",
    "exists",
    "load_ranking",
    "load_report",
    "materialize",
    "save_ranking",
    "save_report",
    "scan_csv",
    "scan_parquet",
    "stage",
    "write_parquet",
]
