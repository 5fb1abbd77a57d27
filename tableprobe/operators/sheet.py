"""Making a table fit for a spreadsheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import SheetLimitError
from ..functions.text import hex_text, text_view
from ..functions.types import UINT64, column, is_nested
from ..functions.wire import EXACT_INTEGER
from ..sources.headers import case_unique_names

# The grid of one worksheet, header row included.
MAX_ROWS = 1_048_576
MAX_COLUMNS = 16_384


def check_sheet_limits(rows: int | None, columns: int) -> None:
    """Refuse a table that one worksheet cannot hold."""
    if columns > MAX_COLUMNS or (rows is not None and rows + 1 > MAX_ROWS):
        size = f"{columns} columns" if rows is None else f"{rows} rows x {columns} columns"
        raise SheetLimitError(
            f"{size} does not fit a worksheet (limit {MAX_ROWS - 1} rows x {MAX_COLUMNS} columns); export CSV or Parquet"
        )


def wide_integer_columns(df: DataFrame) -> list[str]:
    """Integer columns with a value past 2**53, which a spreadsheet would round. One scan."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType) or f.dataType == UINT64]
    if not wide:
        return []
    past = [
        F.coalesce(
            (F.max(column(n)).cast("decimal(20,0)") > EXACT_INTEGER)
            | (F.min(column(n)).cast("decimal(20,0)") < -EXACT_INTEGER),
            F.lit(False),
        ).alias(f"w{i}")
        for i, n in enumerate(wide)
    ]
    return [n for n, is_wide in zip(wide, df.agg(*past).first()) if is_wide]


def to_sheet_safe(df: DataFrame) -> DataFrame:
    """Names that differ by more than case, wide integers and binary as text."""
    check_sheet_limits(None, len(df.columns))
    as_text = set(wide_integer_columns(df))
    out = []
    for field, name in zip(df.schema.fields, case_unique_names(df.columns)):
        col = column(field.name)
        if field.name in as_text:
            col = col.cast("string")
        elif isinstance(field.dataType, T.BinaryType):
            col = hex_text(col)
        elif is_nested(field.dataType):
            col = text_view(col, field.dataType)
        out.append(col.alias(name))
    return df.select(*out)
