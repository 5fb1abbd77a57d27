"""How often each value of a column occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import ColumnNotFoundError, TableProbeError
from ..functions.text import digest_key, display_value, text_or_token
from ..functions.types import column, is_nested, is_string
from .row_index import ROW_INDEX, with_row_index

DEFAULT_VALUES = 100
#: Listed values that are broadcast to fetch their texts; more are joined by shuffle.
_BROADCAST_VALUES = 100_000


def value_counts(
    df: DataFrame,
    name: str,
    limit: int = DEFAULT_VALUES,
    tie: str = "first_seen",
    display: bool = False,
    long_texts: bool = False,
) -> DataFrame:
    """`value`, `count`, `pct` of all rows and `total_unique`, most frequent first.

    Nulls count as ``(null)`` and so does a real text ``(null)``. `limit` 0 lists every
    value. Equal counts are ordered by first appearance in the file, or by ``tie="value"``,
    which needs no row numbers. `display` shows the empty string as ``(empty)``.

    With `long_texts` long texts are grouped by their digest and never shuffled; the listed
    ones are fetched by the row they first appear in, which takes a second scan.

    Rows are counted per task before they are shuffled, by the typed value where that is
    one-to-one with its text, so a value that makes up most of the table is one row per task.
    """
    if name not in df.columns:
        raise ColumnNotFoundError(f"Column '{name}' not found in table")
    if tie not in ("first_seen", "value"):
        raise TableProbeError(f"unknown tie order {tie}")
    if long_texts and tie != "first_seen":
        raise TableProbeError("long texts are listed in the order they are first seen")
    dtype = df.schema[name].dataType
    first_seen = tie == "first_seen"
    rows = with_row_index(df) if first_seen and name != ROW_INDEX else df
    by_text = is_string(dtype) or is_nested(dtype)
    key = text_or_token(column(name), dtype) if by_text else column(name)
    if by_text and long_texts:
        key = digest_key(key)
    measures = [F.count(F.lit(1)).alias("n")] + ([F.min(column(ROW_INDEX)).alias("first")] if first_seen else [])
    groups = rows.groupBy(key.alias("key")).agg(*measures)

    sums = [F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")]
    if first_seen:
        # with every measure in use the plan of the groups is the same in both places, so
        # they are counted and shuffled once
        sums.append(F.max("first").alias("last"))
    totals = groups.agg(F.struct(*sums).alias("t")).scalar()
    if first_seen:
        groups = groups.filter(F.col("first") <= totals.getField("last"))

    value = F.col("key") if by_text else text_or_token(F.col("key"), dtype)
    listed = groups if first_seen else groups.withColumn("value", value)
    listed = listed.orderBy(F.col("n").desc(), F.col("first" if first_seen else "value").asc())
    if limit > 0:
        listed = listed.limit(limit)
    if by_text and long_texts:
        texts = rows.select(text_or_token(column(name), dtype).alias("value"), column(ROW_INDEX).alias("first"))
        found = F.broadcast(listed) if 0 < limit <= _BROADCAST_VALUES else listed
        listed = texts.join(found, "first").orderBy(F.col("n").desc(), F.col("first").asc())
    elif first_seen:
        listed = listed.withColumn("value", value)  # only the listed values become text
    return listed.select(
        (display_value(F.col("value")) if display else F.col("value")).alias("value"),
        F.col("n").alias("count"),
        F.round(F.col("n") / totals.getField("rows") * 100, 2).alias("pct"),
        totals.getField("values").alias("total_unique"),
    )


#: Buckets that values are dealt into by hash.
_BUCKETS = 1 << 16


def top_values(df: DataFrame, name: str, limit: int = DEFAULT_VALUES, tie: str = "first_seen") -> DataFrame:
    """`value`, `count`, `pct` of the most frequent values, as `value_counts` lists them, of a column with very many values.

    One pass counts the rows of `_BUCKETS` buckets of hashed values: no value is more frequent than its bucket. The values of the
    fullest buckets are counted exactly; where the last one listed is more frequent than every other bucket is full, the
    list is proven. Else the values of all buckets that are as full are counted, which proves it. So values of buckets that
    can't hold a listed one are never shuffled. Only where all values are about as frequent, no bucket can be left out. The passes but the last run at once.
    """
    if name not in df.columns:
        raise ColumnNotFoundError(f"Column '{name}' not found in table")
    if tie not in ("first_seen", "value") or limit < 1:
        raise TableProbeError("a number of values, and ties by first_seen or value, are needed")
    dtype = df.schema[name].dataType
    first_seen = tie == "first_seen"
    rows = with_row_index(df) if first_seen and name != ROW_INDEX else df
    by_text = is_string(dtype) or is_nested(dtype)
    key = text_or_token(column(name), dtype) if by_text else column(name)
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int")
    keyed = rows.select(key.alias("key"), bucket.alias("bucket"), *([column(ROW_INDEX).alias("place")] if first_seen else []))
    sizes = {r.bucket: r["count"] for r in keyed.groupBy("bucket").count().collect()}
    total = sum(sizes.values())
    value = F.col("key") if by_text else text_or_token(F.col("key"), dtype)

    def counted(buckets: set[int]) -> DataFrame:
        some = keyed
        if 2 * len(buckets) < len(sizes):  # else there is little to leave out
            # at most 65,536 numbers
            wanted = df.sparkSession.createDataFrame([(b,) for b in sorted(buckets)], "bucket int")
            some = keyed.join(F.broadcast(wanted), "bucket", "left_semi")
        measures = [F.count(F.lit(1)).alias("n")] + ([F.min("place").alias("first")] if first_seen else [])
        groups = some.groupBy("key").agg(*measures).withColumn("value", value)
        return groups.orderBy(F.col("n").desc(), F.col("first" if first_seen else "value").asc()).limit(limit)

    chosen = set(sorted(sizes, key=lambda b: (-sizes[b], b))[: 2 * limit + 16])
    listed = counted(chosen)
    if len(chosen) < len(sizes):
        least = sorted((r.n for r in listed.select("n").collect()), reverse=True)
        least = least[limit - 1] if len(least) == limit else 1
        needed = {b for b, n in sizes.items() if n >= least}
        if not needed <= chosen:
            listed = counted(needed)
    return listed.select("value", F.col("n").alias("count"), F.round(F.col("n") / F.lit(max(total, 1)) * 100, 2).alias("pct"))
