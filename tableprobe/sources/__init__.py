"""Sources: Parquet, delimited text, SQLite databases, workbooks."""

from .classify import classify_files, source_type
from .delimited import read_csv, read_delimited, read_tsv
from .grid import grid_to_table, rows_to_table, table_to_grid
from .headers import case_unique_names, header_names
from .inference import MISSING, SHEET_ERRORS, infer_types, mark_missing, null_markers, type_text_columns
from .kinds import resolve_kinds
from .sqlite import list_sqlite_tables, read_sqlite
from .tables import column_metadata, list_tables, parquet_catalogue, read_parquet, read_table, table_metadata
from .workbook import list_sheets, read_cells, read_rows, read_workbook

__all__ = [
    "MISSING",
    "SHEET_ERRORS",
    "case_unique_names",
    "classify_files",
    "column_metadata",
    "grid_to_table",
    "header_names",
    "infer_types",
    "list_sheets",
    "list_sqlite_tables",
    "list_tables",
    "mark_missing",
    "null_markers",
    "parquet_catalogue",
    "read_cells",
    "read_csv",
    "read_delimited",
    "read_parquet",
    "read_sqlite",
    "read_rows",
    "read_table",
    "read_tsv",
    "read_workbook",
    "resolve_kinds",
    "rows_to_table",
    "source_type",
    "table_metadata",
    "table_to_grid",
    "type_text_columns",
]
