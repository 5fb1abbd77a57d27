"""Exact order statistics of many columns without a sort or an unbounded buffer.

A counting pass cuts the range of a column into buckets and finds, from their exact counts,
the bucket each wanted rank falls in; the next pass cuts that bucket, and so on until few
enough values are left to list them. Each round narrows a column by a factor of thousands, so
a trillion rows take three or four scans of the wanted columns. Rows are counted per task;
what is shuffled and reaches the driver is at most `BUCKETS` rows per column and task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .melt import Melted, constants

#: Buckets a range is cut into.
BUCKETS = 2048
#: A range with at most this many rows is listed value by value.
LISTED_ROWS = 2048

_LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class _Range:
    """The `rows` values from `low` to `high`, both included, with `below` rows before them."""

    low: object
    high: object
    below: int
    rows: int
    #: cut by orders of magnitude instead of evenly
    magnitude: bool = False

    @property
    def by_magnitude(self) -> bool:
        return self.magnitude or not math.isfinite(float(self.high) - float(self.low))


def order_statistics(
    df: DataFrame,
    groups: list[Melted],
    extent: dict[int, tuple[int, object, object]],
    ranks: dict[int, list[int]],
) -> dict[int, dict[int, object]]:
    """The values at 0-based `ranks` of each column's values, nulls and NaN aside.

    `extent` holds the exact (count, min, max) of each column.
    """
    found: dict[int, dict[int, object]] = {i: {} for i in extent}
    open_ranges: dict[tuple[int, int], _Range] = {}
    for i, (count, low, high) in extent.items():
        for rank in ranks[i]:
            if low == high:
                found[i][rank] = low
            else:
                open_ranges[i, rank] = _Range(low, high, 0, count)
    while open_ranges:
        buckets = _count(df, groups, open_ranges)
        for (i, rank), current in list(open_ranges.items()):
            nearer = _narrow(rank, current, buckets[i, current])
            if nearer.low == nearer.high:
                found[i][rank] = nearer.low
                del open_ranges[i, rank]
            else:
                open_ranges[i, rank] = nearer
    return found


def _count(df: DataFrame, groups: list[Melted], open_ranges: dict) -> dict:
    """Per open range its buckets in ascending order, as (rows, smallest, largest), in one job."""
    branches = []
    cut: list[tuple[int, _Range]] = []
    parsers = {}
    for group in groups:
        # a column's open ranges are disjoint: a value is in one slot at most
        slots: dict[int, list[_Range]] = {}
        for (i, _), r in open_ranges.items():
            if i in group.members and r not in slots.setdefault(i, []):
                slots[i].append(r)
        if not slots:
            continue
        parse = float if group.is_double else int if isinstance(group.dtype, T.LongType) else Decimal
        parsers |= {i: parse for i in slots}
        kept = Melted(group.dtype, group.text, {i: group.members[i] for i in slots})
        branches.append(_bucket_counts(kept, df, slots, len(cut)))
        cut += [(i, r) for i, ranges in slots.items() for r in ranges]
    out: dict = {item: [] for item in cut}
    for row in reduce(DataFrame.unionAll, branches).collect():
        i, r = cut[row.k]
        out[i, r].append((row.rows, parsers[i](row.low), parsers[i](row.high)))
    for found in out.values():
        found.sort(key=lambda b: b[1])
    return out


def _bucket_counts(group: Melted, df: DataFrame, slots: dict[int, list[_Range]], first: int) -> DataFrame:
    """Counts of one type's columns, keyed by the number `k` of the range.

    Every constant of a range sits in an array that is read at `k`, so the expressions are
    the same however many ranges there are.
    """
    x, i, dtype, sql_type = F.col("x"), F.col("i"), group.dtype, group.dtype.simpleString()
    width = max(len(ranges) for ranges in slots.values())
    size = max(slots) + 1

    def bound(slot: int, side: str) -> Column:
        ranges = [slots[n][slot] if n in slots and slot < len(slots[n]) else None for n in range(size)]
        return F.get(constants([r and getattr(r, side) for r in ranges], sql_type), i)

    slot = F.lit(None).cast("int")
    for s in reversed(range(width)):
        slot = F.when(x.between(bound(s, "low"), bound(s, "high")), s).otherwise(slot)
    starts, flat = {}, []
    for n, ranges in slots.items():
        starts[n] = len(flat)
        flat += ranges
    start = F.get(constants([starts.get(n) for n in range(size)], "int"), i)
    rows = group.rows(df)
    if group.is_double:
        rows = rows.filter(~F.isnan(x))
    rows = rows.withColumn("slot", slot).filter("slot is not null").withColumn("k", start + F.col("slot"))

    k = F.col("k")

    def at(values: list, to: str) -> Column:
        return F.get(constants(values, to), k)

    listed = at([r.rows <= LISTED_ROWS for r in flat], "boolean")
    evenly = [not r.by_magnitude for r in flat]
    spans = [float(r.high - r.low) if even else 1.0 for r, even in zip(flat, evenly)]
    distance = x - at([r.low for r in flat], sql_type)
    if isinstance(dtype, T.LongType) and any(max(abs(r.low), abs(r.high)) >= 2**62 for r in flat):
        wide = "decimal(38,0)"  # the difference itself may not fit 64 bits
        distance = x.cast(wide) - at([r.low for r in flat], wide)
    number = F.floor(distance.cast("double") / at(spans, "double") * BUCKETS)
    if not all(evenly):
        lows = [_magnitude(max(float(r.low), -_LARGEST)) for r in flat]
        highs = [_magnitude(min(float(r.high), _LARGEST)) for r in flat]
        widths = [max(high - low, 1e-300) for low, high in zip(lows, highs)]
        share = (_magnitude_of(x.cast("double")) - at(lows, "double")) / at(widths, "double")
        # the infinities have buckets of their own
        bounded = F.least(F.greatest(share, F.lit(-1.0)), F.lit(2.0))
        number = F.when(at(evenly, "boolean"), number).otherwise(F.floor(bounded * BUCKETS))
    keyed = rows.select(
        (k + first).alias("k"),
        F.when(~listed, number).alias("bucket"),
        F.when(listed, x).alias("value"),
        "x",
    )
    return (
        keyed.groupBy("k", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
        .selectExpr("k", "rows", "CAST(low AS string)", "CAST(high AS string)")
    )


def _magnitude_of(x: Column) -> Column:
    """A number that rises with x and spreads its orders of magnitude evenly."""
    exponent = F.log2(F.abs(x)) + 1100.0  # positive for every double but 0
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * exponent)


def _magnitude(value: float) -> float:
    return 0.0 if value == 0 else math.copysign(math.log2(abs(value)) + 1100.0, value)


def _narrow(rank: int, current: _Range, buckets: list[tuple]) -> _Range:
    """The bucket that holds the rank; the other way of cutting next where this one was slow."""
    below = current.below
    for rows, low, high in buckets:
        if rank < below + rows:
            slow = rows * 16 > current.rows
            return _Range(low, high, below, rows, current.magnitude != slow)
        below += rows
    raise AssertionError("the counts of a column changed between two scans")


def interpolate(values: dict[int, object], count: int, share: float) -> float:
    """The quantile at `share`, linear between the two nearest ranks."""
    position = (count - 1) * share
    lower = int(position)
    first = float(values[lower])
    if position == lower:
        return first
    return first + (float(values[lower + 1]) - first) * (position - lower)


def quantile_ranks(count: int, shares) -> list[int]:
    """The ranks `interpolate` needs."""
    lowers = [int((count - 1) * s) for s in shares]
    return sorted({r for low in lowers for r in (low, min(low + 1, count - 1))})
