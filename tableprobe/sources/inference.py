"""Types of text columns, decided over every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import column

# The texts that mean "missing" in a delimited file or a spreadsheet.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The errors a spreadsheet cell can hold. They mean "missing" only there.
SHEET_ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")

# What a text can be read as. Eighteen digits always fit 64 bits, more are looked at closely.
_SHORT_INTEGER = r"^-?[0-9]{1,18}$"
_INTEGER = r"^-?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?$"
_BOOLEAN = r"^(?i:true|false)$"

#: The classes of texts, and the type of a column that holds only some of them.
_LONG, _UNSIGNED_LONG, _UNSIGNED, _WIDE, _FRACTION, _FLAG, _OTHER = range(7)
_TYPES = (
    ({_LONG, _UNSIGNED_LONG}, "bigint"),
    ({_UNSIGNED_LONG, _UNSIGNED}, "decimal(20,0)"),
    ({_FLAG}, "boolean"),
    ({_LONG, _UNSIGNED_LONG, _UNSIGNED, _WIDE}, "string"),
    ({_LONG, _UNSIGNED_LONG, _UNSIGNED, _WIDE, _FRACTION}, "double"),
)

#: The largest unsigned 64-bit integer.
_UINT64_MAX = str(2**64 - 1)

#: Columns whose types are decided in one job.
_COLUMNS_PER_JOB = 1024


def null_markers(col: Column, sheet: bool = False) -> Column:
    """Null where the text is one of the missing-value markers."""
    return F.when(~col.isin(*MISSING, *(SHEET_ERRORS if sheet else ())), col)


def mark_missing(df: DataFrame, names: list[str] | None = None, sheet: bool = False) -> DataFrame:
    """`null_markers` on text columns (all of them by default)."""
    return df.withColumns({n: null_markers(column(n), sheet) for n in (df.columns if names is None else names)})


def infer_types(df: DataFrame, names: list[str] | None = None) -> dict[str, str]:
    """The narrowest type that holds every value of each text column.

    boolean, bigint, decimal(20,0) for unsigned 64-bit integers, double, else string. One
    odd value anywhere makes the column text; so does an integer too wide for 64 bits, which
    keeps all its digits. A column without values is text.
    """
    names = df.columns if names is None else names
    out = {}
    for start in range(0, len(names), _COLUMNS_PER_JOB):
        chunk = names[start : start + _COLUMNS_PER_JOB]
        out |= _infer_chunk(df.select(*[column(n).alias(f"c{i}") for i, n in enumerate(chunk)]), chunk)
    return out


def _text_class(x: Column) -> Column:
    """The narrowest class of one text. The first character settles most of the others."""
    first = F.ascii(x)
    number = first.between(ord("+"), ord("9"))
    negative = first == ord("-")
    fits_unsigned = ~negative & (x.try_cast("decimal(38,0)") <= F.lit(_UINT64_MAX).cast("decimal(20,0)"))
    wide = (
        F.when(x.try_cast("bigint").isNotNull(), F.when(negative, _LONG).otherwise(_UNSIGNED_LONG))
        .when(fits_unsigned, _UNSIGNED)
        .otherwise(_WIDE)
    )
    return (
        F.when(number & x.rlike(_SHORT_INTEGER), F.when(negative, _LONG).otherwise(_UNSIGNED_LONG))
        .when(number & x.rlike(_REAL), _FRACTION)
        .when(number & x.rlike(_INTEGER), wide)
        .when(first.isin([ord(c) for c in "tTfF"]) & x.rlike(_BOOLEAN), _FLAG)
        .otherwise(_OTHER)
    )


def _infer_chunk(frame: DataFrame, names: list[str]) -> dict[str, str]:
    rows = frame.select(F.posexplode(F.array(*frame.columns)).alias("i", "x")).filter("x is not null")
    classes: dict[int, set[int]] = {}
    for row in rows.select("i", _text_class(F.col("x")).alias("class")).distinct().collect():
        classes.setdefault(row.i, set()).add(row["class"])  # at most one row per column and class
    out = {}
    for i, name in enumerate(names):
        found = classes.get(i, {_OTHER})
        out[name] = next((t for holds, t in _TYPES if found <= holds), "string")
    return out


def cast_text(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to their inferred types, in one projection."""
    changed = {n: column(n).cast(t) for n, t in types.items() if t != "string"}
    return df.withColumns(changed) if changed else df


def type_text_columns(df: DataFrame, names: list[str] | None = None, sheet: bool = False) -> DataFrame:
    """Markers to nulls, then every text column in its inferred type."""
    names = df.columns if names is None else names
    marked = mark_missing(df, names, sheet)
    return cast_text(marked, infer_types(marked, names))
