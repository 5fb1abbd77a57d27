"""Whole jobs: exploring a table and exporting it."""

from .explore import Explorer
from .export import FORMATS, count_export, export, output_name, resolve_format, text_export_view, write_table

__all__ = [
    "Explorer",
    "FORMATS",
    "count_export",
    "export",
    "output_name",
    "resolve_format",
    "text_export_view",
    "write_table",
]
