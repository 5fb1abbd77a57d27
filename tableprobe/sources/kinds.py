"""Types of columns whose every value carries its own kind.

Such a column holds structs (kind, text). The kinds are bool, int, float, text, blob, date,
datetime, time and timedelta; the text is the value as written out, for a blob its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import blob_size_text
from ..functions.types import column
from .inference import null_markers

CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])

#: Kinds that one type holds together; any other mixture is text.
_FAMILIES = {
    "bool": "bool",
    "int": "number",
    "float": "number",
    "text": "text",
    "blob": "text",
    "date": "temporal",
    "datetime": "temporal",
}

_UINT64_MAX = str(2**64 - 1)
#: Columns whose types are decided in one job.
_COLUMNS_PER_JOB = 64


def cell_text(cell: Column) -> Column:
    """The value as text; a blob as its size."""
    return F.when(cell["kind"] == "blob", blob_size_text(cell["text"].cast("bigint"))).otherwise(cell["text"])


def without_markers(cell: Column, sheet: bool) -> Column:
    """Null where the cell is a text that means missing."""
    marker = (cell["kind"] == "text") & null_markers(cell["text"], sheet).isNull()
    return F.when(~F.coalesce(marker, F.lit(False)), cell)


def resolve_kinds(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace (kind, text) columns by typed ones, decided over every row.

    Integers and floats make a double, dates and datetimes a timestamp; everything else that
    mixes kinds, or would lose a value in its type, is the text of every value.
    """
    return cast_cells(df, cell_types(df, names))


def cell_types(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The type of each (kind, text) column."""
    types: list[str] = []
    for start in range(0, len(names), _COLUMNS_PER_JOB):
        chunk = names[start : start + _COLUMNS_PER_JOB]
        cells = df.select(F.posexplode(F.array(*[column(n) for n in chunk])).alias("i", "cell"))
        types += kind_types(cells, len(chunk))
    return dict(zip(names, types))


def cast_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(kind, text) columns in their types, in one projection."""
    return df.withColumns({n: typed_cell(column(n), t) for n, t in types.items()}) if types else df


def typed_cell(cell: Column, dtype: str) -> Column:
    """A (kind, text) cell in the type of its column."""
    return cell_text(cell) if dtype == "string" else cell["text"].cast(dtype)


def kind_types(cells: DataFrame, width: int) -> list[str]:
    """The types of columns 0..`width` - 1, from rows (i, cell). One aggregation."""
    text, kind = F.col("cell.text"), F.col("cell.kind")
    whole = F.when(kind == "int", text.try_cast("decimal(38,0)"))
    per_kind = (
        cells.filter(kind.isNotNull())
        .groupBy("i", kind.alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("values"),
            F.count(F.when(kind == "int", text.try_cast("bigint"))).alias("longs"),
            F.count_if(whole.between(F.lit(0), F.lit(_UINT64_MAX).cast("decimal(20,0)"))).alias("unsigned"),
        )
    )
    found: dict[int, dict] = {}
    for row in per_kind.collect():  # at most one row per column and kind
        found.setdefault(row.i, {})[row.kind] = row
    return [_type_of(found.get(i, {})) for i in range(width)]


def _type_of(kinds: dict) -> str:
    families = {_FAMILIES.get(k, k) for k in kinds}
    if len(families) != 1:
        return "string"
    family = families.pop()
    if family == "bool":
        return "boolean"
    if family == "temporal":
        return "date" if set(kinds) == {"date"} else "timestamp_ntz"
    if family != "number":
        return "string"
    if "float" in kinds:
        return "double"
    row = kinds["int"]
    if row.longs == row["values"]:
        return "bigint"
    return "decimal(20,0)" if row.unsigned == row["values"] else "string"
