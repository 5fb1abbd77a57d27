"""Text renderings of columns, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .types import column, is_floating, is_nested, is_string

#: What a null reads as in a text filter and in value counts.
NULL_TOKEN = "(null)"
#: What an empty string reads as in a list of values.
EMPTY_TOKEN = "(empty)"

_JSON = {"ignoreNullFields": "false"}


def double_text(x: Column) -> Column:
    """Text of a double with the fewest digits: ``1``, ``0.1``, ``1e+20``, ``nan``, ``inf``."""
    size = F.abs(x)
    java = x.cast("string")
    # seventeen digits always tell two doubles apart, most need fewer; zeros at the end say nothing
    fifteen, sixteen, seventeen = (F.format_string(f"%.{d}e", x) for d in (14, 15, 16))
    shortest = F.when(fifteen.cast("double") == x, fifteen).when(sixteen.cast("double") == x, sixteen)
    digits = F.regexp_replace(shortest.otherwise(seventeen), r"\.?0*e([+-])0?", "e$1")
    # scale 22 holds every digit of the smallest plain value
    exact = F.rtrim(x.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when((size < 1e10) & (x == F.floor(x)), F.floor(x).cast("string"))
        .when((size >= 1e-3) & (size < 1e7), java)  # where Java writes no exponent
        .when((size >= 1e-6) & (size < 1e10), exact)
        .otherwise(digits)
    )


#: A text longer than this is told apart by its digest where texts are grouped.
DIGEST_OVER = 128


def digest_key(col: Column) -> Column:
    """The text, or the marked SHA-256 digest of a long one. Equal texts have equal keys."""
    # the mark makes a digest longer than any text that stands for itself
    digest = F.concat(F.lit("\x00" * DIGEST_OVER), F.sha2(col, 256))
    return F.when(F.char_length(col) > DIGEST_OVER, digest).otherwise(col)


def text_view(col: Column, dtype: T.DataType) -> Column:
    """The text a filter searches and a value count groups by."""
    if is_string(dtype):
        return col
    if isinstance(dtype, T.FloatType):
        return double_text(col.cast("string").cast("double"))
    if is_floating(dtype):
        return double_text(col)
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.TimestampType):
        return F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))
    if isinstance(dtype, T.BinaryType):
        return hex_text(col)
    if is_nested(dtype):
        return F.to_json(col, _JSON)
    return col.cast("string")


def text_or_token(col: Column, dtype: T.DataType) -> Column:
    """`text_view` with nulls as the literal ``(null)``."""
    return F.coalesce(text_view(col, dtype), F.lit(NULL_TOKEN))


def hex_text(col: Column) -> Column:
    """Binary as lower-case hex: lossless, and never fails on any bytes."""
    return F.lower(F.hex(col))


def truncate_text(col: Column, limit: int = 100) -> Column:
    """The first `limit` characters and an ellipsis; 0 means no limit."""
    if limit <= 0:
        return col
    return F.when(F.char_length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def blob_size_text(size: Column) -> Column:
    """``<BLOB 1.3 KB>`` from a byte count, one decimal, half up, no trailing ``.0``."""

    def scaled(unit_bytes: int, unit: str) -> Column:
        number = F.format_string("%.1f", size / F.lit(float(unit_bytes)))
        return F.concat(F.lit("<BLOB "), F.regexp_replace(number, r"\.0$", ""), F.lit(f" {unit}>"))

    kib, mib = 1024, 1024 * 1024
    return (
        F.when(size < kib, scaled(1, "B")).when(size < mib, scaled(kib, "KB")).when(size >= mib, scaled(mib, "MB"))
    )


def blob_placeholder(col: Column) -> Column:
    """Size text of a binary value; the bytes go no further than this projection."""
    return blob_size_text(F.octet_length(col))


def file_size_text(size: Column) -> Column:
    """``1.25 MB``: two decimals, trailing zeros dropped, ``0 B`` for an empty file."""
    out = F.when(size == 0, F.lit("0 B"))
    units = ["B", "KB", "MB", "GB", "TB"]
    for power, unit in enumerate(units):
        number = F.regexp_replace(
            F.round(size / F.lit(float(1024**power)), 2).cast("decimal(24,2)").cast("string"), r"\.?0+$", ""
        )
        text = F.concat(number, F.lit(f" {unit}"))
        out = out.otherwise(text) if power == len(units) - 1 else out.when(size < 1024 ** (power + 1), text)
    return out


def slugify(col: Column) -> Column:
    """Lower case, other runs than letters and digits as one underscore, ``sheet`` when empty."""
    runs = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_")
    trimmed = F.regexp_replace(runs, "^_+|_+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("sheet"))


def display_value(col: Column) -> Column:
    """Value text for a list of values, with the empty string made visible."""
    return F.when(col == "", F.lit(EMPTY_TOKEN)).otherwise(col)


__all__ = [
    "DIGEST_OVER",
    "NULL_TOKEN",
    "EMPTY_TOKEN",
    "blob_placeholder",
    "blob_size_text",
    "column",
    "digest_key",
    "display_value",
    "double_text",
    "file_size_text",
    "hex_text",
    "slugify",
    "text_or_token",
    "text_view",
    "truncate_text",
]
