"""Numbers written as text, and exact handling of typed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .types import column, is_string

# Which texts count as a 64-bit integer or as a float when a whole text
# column is read as numbers. Surrounding blanks, suffixes and digit separators do not.
INT_TEXT = r"^-?[0-9]+$"
FLOAT_TEXT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def is_number_text(col: Column) -> Column:
    """Whether the text is a number; the first character rules most other texts out."""
    first = F.ascii(col)
    likely = first.between(ord("+"), ord("9")) | first.isin([ord(c) for c in "iInN"])
    return likely & col.rlike(FLOAT_TEXT)


def text_to_long(col: Column) -> Column:
    """The text as a 64-bit integer, null where it is none."""
    return F.when(col.rlike(INT_TEXT), col.try_cast("bigint"))


def text_to_double(col: Column) -> Column:
    """The text as a double, null where it is none."""
    unsigned = F.regexp_replace(col, "^[+-]", "")
    value = F.when(F.lower(unsigned) == "nan", F.lit(float("nan"))).otherwise(unsigned.try_cast("double"))
    signed = F.when(col.startswith("-"), -value).otherwise(value)
    return F.when(is_number_text(col), signed)


def text_number_kind(df: DataFrame, name: str) -> str | None:
    """``int``, ``float`` or None: how a whole text column reads as numbers.

    Decided over every row. A column of ordinary text is recognised by its first
    non-number, so the search ends with the first partitions; only a column of
    numbers is read to its end.
    """
    if not is_string(df.schema[name].dataType):
        return None
    values = df.select(column(name).alias("v")).filter("v is not null")
    if not values.filter(~is_number_text(F.col("v"))).isEmpty():
        return None
    return "float" if not values.filter(text_to_long(F.col("v")).isNull()).isEmpty() else "int"


def numeric_view(col: Column, dtype: T.DataType, text_kind: str | None = None) -> Column:
    """The numeric reading of a column: itself, or its text as numbers."""
    if not is_string(dtype):
        return col
    return text_to_long(col) if text_kind == "int" else text_to_double(col)
