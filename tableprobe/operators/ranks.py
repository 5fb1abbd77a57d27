"""The row at one rank of a sorted table, found by counting.

The order is that of `sorting`: values, then NaN, then nulls, ties by row number. One pass counts these classes; the next ones cut the range
of the key that holds the rank into `BUCKETS` pieces, count the rows of each and keep the piece with the rank, with its exact
smallest and largest key, until one key or a few rows are left; then the same is done with the row numbers of that key. A trillion rows take about
five scans of the one column. Tasks pre-aggregate; `BUCKETS` rows each are shuffled, and no step keeps rows but for the last `LISTED`.

Any function that never falls as the key rises can deal keys into buckets, since the bounds are kept exactly: differences of
numbers and of times, orders of magnitude where evenly cut pieces are uneven, and for text the bytes behind what the smallest
and the largest have in common.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.types import column, is_floating, is_integral, is_string
from .quantiles import _magnitude_of
from .row_index import ROW_INDEX

#: Pieces a range of keys is cut into.
BUCKETS = 2048
#: A range with at most this many rows is listed.
LISTED = 2048
#: Bytes of a text that one pass looks at; as a number they and their length fit a double exactly.
_CHUNK = 6


@dataclass(frozen=True)
class Cut:
    """A row's place: whether its key is a ``value``, ``nan`` or ``null``, the value as text, the row number, and how many values follow."""

    kind: str
    text: str | None
    row_index: int
    follow: int = 0


def can_cut(dtype: T.DataType) -> bool:
    """Whether keys of this type can be dealt into buckets."""
    known = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType, T.BooleanType, T.BinaryType)
    return is_string(dtype) or isinstance(dtype, known)


def value_column(text: str, dtype: T.DataType) -> Column:
    """The value a `Cut` holds, as a constant of the key's type."""
    return F.unhex(F.lit(text)) if isinstance(dtype, T.BinaryType) else F.lit(text).cast(dtype)


def _text(key: Column, dtype: T.DataType) -> Column:
    """A key as text that `value_column` reads back exactly."""
    return F.hex(key) if isinstance(dtype, T.BinaryType) else key.cast("string")


def row_at(rows: DataFrame, rank: int, key: Column | None = None, can_be_nan: bool = False, ascending: bool = True) -> Cut | None:
    """The place of the row with `rank` rows before it, or None past the end. Without a key, rows are in the order of their numbers."""
    place = column(ROW_INDEX).alias("r")
    if key is None:
        row = _number_at(rows.select(place), rank)
        return None if row is None else Cut("null", None, row)
    keyed = rows.select(key.alias("k"), place)
    k, dtype = F.col("k"), keyed.schema["k"].dataType
    nan = F.isnan(k) if can_be_nan else F.lit(False)
    value = k.isNotNull() & ~nan
    own = F.when(value, k)
    found = keyed.agg(
        F.count_if(value).alias("value"),
        F.count_if(F.coalesce(nan, F.lit(False))).alias("nan"),
        F.count_if(k.isNull()).alias("null"),
        _text(F.min(own), dtype).alias("low"),
        _text(F.max(own), dtype).alias("high"),
    ).first()
    for kind, members in (("value", value), ("nan", k.isNotNull() & nan), ("null", k.isNull())):
        if rank >= found[kind]:
            rank -= found[kind]
            continue
        if kind == "value":
            cut = _value_at(keyed.filter(value), dtype, rank, found["value"], found.low, found.high, ascending)
            return replace(cut, follow=found["value"] - rank - 1)
        return Cut(kind, None, _number_at(keyed.filter(members).select("r"), rank))
    return None


def _value_at(keyed: DataFrame, dtype: T.DataType, rank: int, count: int, low: str, high: str, ascending: bool) -> Cut:
    """The place of a row among the keys from `low` to `high`, which `count` rows have."""
    k, magnitude = F.col("k"), False
    while low != high:
        inside = keyed.filter(k.between(value_column(low, dtype), value_column(high, dtype)))
        if count <= LISTED:
            order = [k.asc() if ascending else k.desc(), F.col("r").asc()]
            row = inside.orderBy(*order).limit(rank + 1).select(_text(k, dtype).alias("text"), "r").collect()[rank]
            return Cut("value", row.text, row.r)
        bucket = _bucket(k, dtype, low, high, magnitude)
        pieces = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
        pieces = pieces.select("b", "rows", _text(F.col("low"), dtype).alias("low"), _text(F.col("high"), dtype).alias("high")).collect()
        for piece in sorted(pieces, key=lambda p: p.b, reverse=not ascending):
            if rank < piece.rows:
                # cut the other way next where this one hardly helped
                magnitude = magnitude != (piece.rows * 16 > count)
                low, high, count = piece.low, piece.high, piece.rows
                break
            rank -= piece.rows
    return Cut("value", low, _number_at(keyed.filter(k == value_column(low, dtype)).select("r"), rank))


def _bucket(key: Column, dtype: T.DataType, low: str, high: str, magnitude: bool) -> Column:
    """The piece a key between `low` and `high` falls in; never falls as the key rises, and tells the two apart."""
    if is_floating(dtype) and (magnitude or not _finite_span(low, high)):
        largest = 1.7976931348623157e308

        def code(x: Column) -> Column:
            # the infinities lie beyond the largest numbers
            x = x.cast("double")
            return _magnitude_of(F.greatest(F.least(x, F.lit(largest)), F.lit(-largest))) + F.when(F.abs(x) > largest, F.signum(x)).otherwise(0.0)
    elif isinstance(dtype, T.BooleanType):
        code = lambda x: x.cast("int").cast("double")
    elif isinstance(dtype, T.DateType):
        code = lambda x: F.unix_date(x).cast("double")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = lambda x: F.unix_micros(x.cast("timestamp"))
        code = lambda x: (micros(x) - micros(value_column(low, dtype))).cast("double")
    elif isinstance(dtype, T.NumericType):
        wide = (lambda x: x.cast("decimal(38,0)")) if is_integral(dtype) else (lambda x: x.cast("double")) if is_floating(dtype) else (lambda x: x)
        code = lambda x: (wide(x) - wide(value_column(low, dtype))).cast("double")
    else:
        binary = isinstance(dtype, T.BinaryType)
        first, last = (bytes.fromhex(t) if binary else t.encode() for t in (low, high))
        same = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))

        def code(x: Column) -> Column:
            chunk = F.substring(x if binary else x.cast("string").cast("binary"), same + 1, _CHUNK)
            number = F.conv(F.rpad(F.hex(chunk), 2 * _CHUNK, "0"), 16, 10).cast("bigint")
            # a text that ends here is before those that go on with zero bytes
            return (number * 8 + F.octet_length(chunk)).cast("double")

    start, end = code(value_column(low, dtype)), code(value_column(high, dtype))
    share = F.floor((code(key) - start) / (end - start) * (BUCKETS - 1))
    return F.when(key == value_column(high, dtype), BUCKETS - 1).when(key == value_column(low, dtype), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), share)))


def _finite_span(low: str, high: str) -> bool:
    return abs(float(high) - float(low)) < float("inf")


def _number_at(numbers: DataFrame, rank: int) -> int | None:
    """The row number `r` at a rank."""
    count, low, high = numbers.agg(F.count("r"), F.min("r"), F.max("r")).first()
    if rank >= count:
        return None
    while high - low + 1 > count:
        inside = numbers.filter(F.col("r").between(low, high))
        if count <= LISTED:
            return sorted(row.r for row in inside.collect())[rank]
        bucket = F.floor((F.col("r") - low) * F.lit(BUCKETS).cast("decimal(20,0)") / F.lit(high - low + 1).cast("decimal(20,0)"))
        pieces = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
        for piece in sorted(pieces, key=lambda p: p.b):
            if rank < piece.rows:
                low, high, count = piece.low, piece.high, piece.rows
                break
            rank -= piece.rows
    # every number from low to high is there
    return low + rank
