"""The form in which rows and statistics leave for a JSON reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .types import UINT64, column, is_floating, is_nested

#: A JSON reader with only doubles holds integers exactly up to here.
EXACT_INTEGER = 2**53

_JSON = {"ignoreNullFields": "false"}


def finite(col: Column) -> Column:
    """NaN and the infinities are not JSON: null."""
    return F.when(F.isnan(col) | col.isin(float("inf"), float("-inf")), None).otherwise(col)


def iso_text(col: Column, dtype: T.DataType) -> Column:
    """ISO form of a date or timestamp; the fraction only where there is one."""
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(col, ".SSSSSS")
    text = F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))
    return F.concat(text, F.lit("+00:00")) if isinstance(dtype, T.TimestampType) else text


def is_wide(col: Column, dtype: T.DataType) -> Column:
    """Whether an integer is past the range a double holds exactly."""
    return F.abs(col.cast("decimal(38,0)")) > F.lit(EXACT_INTEGER)


def _wire_value(col: Column, dtype: T.DataType, wide_as_text: bool) -> Column:
    if is_floating(dtype):
        return finite(col)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso_text(col, dtype)
    if wide_as_text and (isinstance(dtype, T.LongType) or dtype == UINT64):
        # text or number is decided value by value, so the field is a variant
        return F.when(is_wide(col, dtype), col.cast("string").cast("variant")).otherwise(col.cast("variant"))
    if isinstance(dtype, T.DecimalType):
        return col if dtype == UINT64 else col.cast("double")
    if isinstance(dtype, T.BinaryType):
        return F.make_valid_utf8(col.cast("string"))
    if is_nested(dtype):
        return F.to_json(col, _JSON)
    if isinstance(dtype, T.TimeType):
        return col.cast("string")
    return col


def wire_view(df: DataFrame, wide_as_text: bool = False) -> DataFrame:
    """Every column in its wire form.

    Non-finite floats are null, dates ISO text, decimals doubles, binary UTF-8 text and
    nested values JSON text. With `wide_as_text` a 64-bit integer column becomes a variant
    holding text for the values past 2**53 and numbers for the rest.
    """
    return df.select(
        *[_wire_value(column(f.name), f.dataType, wide_as_text).alias(f.name) for f in df.schema.fields]
    )


def row_json(df: DataFrame, exclude: tuple[str, ...] = ("row_index",)) -> Column:
    """One row as a JSON object without the row number, for use in a select on `df`."""
    fields = [
        _wire_value(column(f.name), f.dataType, wide_as_text=True).alias(f.name)
        for f in df.schema.fields
        if f.name not in exclude
    ]
    return F.to_json(F.struct(*fields), _JSON)
