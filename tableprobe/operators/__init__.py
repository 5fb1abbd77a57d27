"""Operators on tables: row numbers, filters, order, pages, statistics, value counts."""

from .filters import (
    CompiledFilters,
    Filter,
    apply_filters,
    compile_filters,
    filters_from_request,
    parse_filter_entry,
)
from .paging import DEFAULT_PAGE_ROWS, page, page_totals
from .row_index import ROW_INDEX, with_row_index
from .sorting import sort_table
from .stats import STATS_SCHEMA, column_stats, profile
from .value_counts import DEFAULT_VALUES, top_values, value_counts

__all__ = [
    "CompiledFilters",
    "DEFAULT_PAGE_ROWS",
    "DEFAULT_VALUES",
    "Filter",
    "ROW_INDEX",
    "STATS_SCHEMA",
    "apply_filters",
    "column_stats",
    "compile_filters",
    "filters_from_request",
    "page",
    "page_totals",
    "parse_filter_entry",
    "profile",
    "sort_table",
    "top_values",
    "value_counts",
    "with_row_index",
]
