"""Writing the filtered and sorted table.

An export always covers the whole filtered table. It is a folder of part files written in
parallel; a sorted export is range-partitioned, so the order of its part files is the order of
the table. Nothing is held in memory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import ExportError
from ..functions.text import hex_text, text_view
from ..functions.types import column, is_floating, is_nested
from ..functions.wire import finite
from ..operators.filters import apply_filters
from ..operators.row_index import ROW_INDEX, has_row_numbers, with_row_index
from ..operators.sheet import MAX_ROWS, check_sheet_limits, to_sheet_safe
from ..operators.sorting import AUTO, sort_table

#: Format -> extension of its files. ``xlsx`` is written as spreadsheet-safe CSV slices.
FORMATS = {"parquet": ".parquet", "csv": ".csv", "tsv": ".tsv", "jsonl": ".jsonl", "xlsx": ".csv"}
#: What "original" means for each source type.
_ORIGINAL = {"parquet": "parquet", "csv": "csv", "tsv": "tsv", "excel": "xlsx"}

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_SPACED = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def resolve_format(fmt: str, source: str | None = None) -> str:
    """The format to write; ``original`` is the source's own, which a database does not have."""
    if fmt == "original":
        if source not in _ORIGINAL:
            raise ExportError(f"a source of type {source} cannot be written in its original format")
        return _ORIGINAL[source]
    if fmt not in FORMATS:
        raise ExportError(f"Invalid format: {fmt}")
    return fmt


def output_name(source_name: str, fmt: str, table: str | None = None, filtered: bool = False) -> str:
    """``<base>[_<table>][_filtered].<extension>``; a sort alone does not mark the name."""
    base, dot, extension = source_name.rpartition(".")
    parts = [base if dot and base else source_name]
    if table:
        parts.append(re.sub("[^a-z0-9]+", "_", table.lower()).strip("_") or "sheet")
    if filtered:
        parts.append("filtered")
    own = f".{extension}" if dot and base else ""
    return "_".join(parts) + (own if fmt == "original" else ".xlsx" if fmt == "xlsx" else FORMATS[fmt])


def text_export_view(df: DataFrame) -> DataFrame:
    """Columns as a text format can hold them: binary as hex, nested values as JSON text."""
    return df.select(*[_as_text(column(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _as_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return hex_text(col)
    if is_nested(dtype) or isinstance(dtype, T.TimeType):
        return text_view(col, dtype)
    if is_floating(dtype):
        # infinities in the spelling other readers know
        return F.when(col == float("inf"), "inf").when(col == float("-inf"), "-inf").otherwise(col.cast("string"))
    return col


def json_export_view(df: DataFrame) -> DataFrame:
    """Columns as JSON can hold them: binary as hex, non-finite numbers as null."""

    def shown(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.BinaryType):
            return hex_text(col)
        if isinstance(dtype, T.TimeType):
            return col.cast("string")
        return finite(col) if is_floating(dtype) else col

    return df.select(*[shown(column(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _write_delimited(df: DataFrame, path: str, delimiter: str, max_rows: int = 0) -> None:
    options = {
        "sep": delimiter,
        "header": True,
        "escape": '"',
        "timestampNTZFormat": _ISO,
        "timestampFormat": _ISO + "XXX",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "maxRecordsPerFile": max_rows,
    }
    if len(df.columns) == 1:
        # an empty line would be no row: a missing value of a single column is written as ""
        df = df.select(F.coalesce(column(df.columns[0]).cast("string"), F.lit("")).alias(df.columns[0]))
    else:
        options["emptyValue"] = ""
    df.write.mode("errorifexists").options(**options).csv(path)


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    """Write all rows of a frame in their order."""
    if fmt == "parquet":
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    elif fmt in ("csv", "tsv"):
        _write_delimited(text_export_view(df), path, "," if fmt == "csv" else "\t")
    elif fmt == "jsonl":
        options = {"ignoreNullFields": False, "timestampNTZFormat": _SPACED, "timestampFormat": _SPACED + "XXX"}
        json_export_view(df).write.mode("errorifexists").options(**options).json(path)
    elif fmt == "xlsx":
        # each part file fits one worksheet
        _write_delimited(text_export_view(to_sheet_safe(df)), path, ",", MAX_ROWS - 1)
    else:
        raise ExportError(f"Invalid format: {fmt}")


def export(
    df: DataFrame,
    path: str,
    fmt: str = "original",
    source: str | None = None,
    filters=(),
    sort_by: str | None = None,
    ascending: bool = True,
    case_insensitive: bool = False,
    use_regex: bool = False,
    text_numbers: str | None = AUTO,
    one_sheet: bool = False,
    keep_row_index: bool = False,
) -> str:
    """Write the filtered, sorted table to a new folder and return its path.

    Unsorted rows are written as they are scanned, without a shuffle. With `one_sheet` an
    ``xlsx`` export that needs more than one worksheet is refused.
    """
    fmt = resolve_format(fmt, source)
    rows = df
    if sort_by is not None and sort_by in df.columns:
        rows = with_row_index(df)
    rows = apply_filters(rows, filters, case_insensitive, use_regex)
    rows = sort_table(rows, sort_by, ascending, text_numbers)
    if not keep_row_index and has_row_numbers(rows):
        rows = rows.drop(ROW_INDEX)
    if fmt == "xlsx" and one_sheet:
        check_sheet_limits(rows.count(), len(rows.columns))
    write_table(rows, path, fmt)
    return path


def count_export(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """`rows` that an export holds, parsed back rather than counted by lines."""
    if fmt == "parquet":
        rows = spark.read.parquet(path)
    elif fmt == "jsonl":
        rows = spark.read.text(path).filter(F.trim("value") != "")
    else:
        sep = "\t" if fmt == "tsv" else ","
        rows = spark.read.options(header=True, sep=sep, multiLine=True, escape='"').csv(path)
    return rows.agg(F.count(F.lit(1)).alias("rows"))


__all__ = [
    "FORMATS",
    "count_export",
    "export",
    "json_export_view",
    "output_name",
    "resolve_format",
    "text_export_view",
    "write_table",
]
