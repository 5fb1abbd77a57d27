"""The order of a one-column sort: values, then NaN, then nulls, ties in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import numeric_view, text_number_kind
from ..functions.text import text_view
from ..functions.types import column, is_floating, is_string
from .row_index import ROW_INDEX

AUTO = "auto"


def sort_expression(df: DataFrame, name: str, text_numbers: str | None = AUTO) -> tuple[Column, bool]:
    """What a column is ordered by, and whether that can be NaN.

    A text column that holds only numbers is ordered by them; its text is not touched.
    `text_numbers` is ``int``, ``float`` or None where that is already known, which saves
    the pass over the column.
    """
    dtype = df.schema[name].dataType
    col = column(name)
    if is_string(dtype):
        kind = text_number_kind(df, name) if text_numbers == AUTO else text_numbers
        return (numeric_view(col, dtype, kind), kind == "float") if kind else (col, False)
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return text_view(col, dtype), False
    return col, is_floating(dtype)


def sort_keys(key: Column, can_be_nan: bool, ascending: bool) -> list[Column]:
    """Sort keys with NaN after the values and nulls last in both directions."""
    tie = column(ROW_INDEX).asc()
    if ascending:
        return [key.asc_nulls_last(), tie]  # Spark already has NaN after every value
    if can_be_nan:
        return [key.isNull().asc(), F.isnan(key).asc(), key.desc(), tie]
    return [key.desc_nulls_last(), tie]


def sort_table(df: DataFrame, name: str | None, ascending: bool = True, text_numbers: str | None = AUTO) -> DataFrame:
    """Globally sorted rows: a range-partitioned sort. An unknown column sorts nothing.

    The frame needs its `row_index` column, which decides ties.
    """
    if name is None or name not in df.columns:
        return df
    key, can_be_nan = sort_expression(df, name, text_numbers)
    return df.orderBy(*sort_keys(key, can_be_nan, ascending))
