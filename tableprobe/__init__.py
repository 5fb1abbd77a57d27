"""Exploring tables of any size with Spark: read, page, filter, sort, describe, export."""

from .errors import (
    ColumnNotFoundError,
    ExportError,
    FilterError,
    SheetLimitError,
    TableProbeError,
    TableReadError,
)
from .operators import Filter, column_stats, page, page_totals, profile, value_counts, with_row_index
from .plans import Explorer, export
from .session import build_session, configure, scratch_dir
from .sources import read_table, table_metadata

__all__ = [
    "ColumnNotFoundError",
    "Explorer",
    "ExportError",
    "Filter",
    "FilterError",
    "SheetLimitError",
    "TableProbeError",
    "TableReadError",
    "build_session",
    "column_stats",
    "configure",
    "export",
    "page",
    "page_totals",
    "profile",
    "read_table",
    "scratch_dir",
    "table_metadata",
    "value_counts",
    "with_row_index",
]
