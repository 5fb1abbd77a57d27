"""Many columns as rows of (column number, value), grouped by value type.

Work on a whole table is written once over these rows instead of once per column: the size
of the generated code does not depend on the number of columns, and each group of columns
takes one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import text_view
from ..functions.types import is_floating, is_integral, is_nested, is_string


def constants(values: list, sql_type: str) -> Column:
    """An array of constants as one expression: cheap to build however many there are."""
    texts = ["NULL" if v is None else f"'{v}'" for v in values]
    return F.expr(f"CAST(array({', '.join(texts)}) AS array<{sql_type}>)")


@dataclass
class Melted:
    """Columns of one value type; `members` maps a column number to its expression."""

    dtype: T.DataType
    #: real text, as opposed to the text form of another type
    text: bool = False
    members: dict[int, Column] = field(default_factory=dict)

    def rows(self, df: DataFrame) -> DataFrame:
        """One row (i, x) per member and input row, nulls included."""
        exploded = df.select(F.posexplode(F.array(*self.members.values())).alias("pos", "x"))
        return exploded.select(F.get(constants(list(self.members), "int"), F.col("pos")).alias("i"), "x")

    @property
    def is_number(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_double(self) -> bool:
        return isinstance(self.dtype, T.DoubleType)


def value_type(dtype: T.DataType) -> T.DataType:
    """The type a column's values are compared in; the mapping into it loses nothing."""
    if is_integral(dtype):
        return T.LongType()
    if is_floating(dtype):
        return T.DoubleType()
    if isinstance(dtype, (T.DecimalType, T.TimestampType, T.BooleanType)):
        return dtype
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return T.TimestampNTZType()
    return T.StringType()


def melt(df: DataFrame, columns: dict[int, str]) -> list[Melted]:
    """Group numbered columns by value type."""
    groups: dict[tuple, Melted] = {}
    for i, name in columns.items():
        dtype = df.schema[name].dataType
        target, text = value_type(dtype), is_string(dtype)
        col = F.col(name)
        as_text = isinstance(target, T.StringType) and not text
        if as_text or is_nested(dtype):
            col = text_view(col, dtype)
        elif target != dtype:
            col = col.cast(target)
        groups.setdefault((repr(target), text), Melted(target, text)).members[i] = col
    return list(groups.values())
