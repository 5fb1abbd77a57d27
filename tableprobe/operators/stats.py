"""Column statistics, for one column or for every column of a table at once.

Statistics always describe the whole table, never a page or a filter. Columns of one type
are handled together as rows of (column, value): one job for the counts, ranges, means and
lengths, one for the distinct values, a few for exact quantiles (see `quantiles`) and one for
the outliers, whatever the number of columns. What reaches the driver is one row per column.
"""

from __future__ import annotations

import datetime as dt
import math
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import ColumnNotFoundError
from ..functions.numbers import is_number_text, numeric_view, text_to_long
from ..functions.text import DIGEST_OVER, digest_key
from ..functions.types import column, is_string, null_columns_to_string, simplify_type
from .melt import Melted, constants, melt
from .quantiles import interpolate, order_statistics, quantile_ranks
from .sketches import estimates, merge, sketch

#: Columns handled by one job: bounds how many rows one input row becomes.
COLUMNS_PER_JOB = 64

#: Keys that are broadcast when long texts are looked up.
_FEW_KEYS = 10_000

_QUARTERS = (0.25, 0.5, 0.75)

STATS_SCHEMA = T.StructType(
    [T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType())]
    + [
        T.StructField(name, dtype())
        for name, dtype in (
            ("total_rows", T.LongType),
            ("non_null_count", T.LongType),
            ("non_null_percentage", T.DoubleType),
            ("null_count", T.LongType),
            ("null_percentage", T.DoubleType),
            ("unique_count", T.LongType),
            ("unique_percentage", T.DoubleType),
            ("min_value", T.DoubleType),
            ("max_value", T.DoubleType),
            ("mean", T.DoubleType),
            ("median", T.DoubleType),
            ("std_dev", T.DoubleType),
            ("outlier_count", T.LongType),
            ("outlier_percentage", T.DoubleType),
            ("outlier_lower_bound", T.DoubleType),
            ("outlier_upper_bound", T.DoubleType),
            ("most_common_value", T.StringType),
            ("most_common_count", T.LongType),
            ("min_length", T.LongType),
            ("max_length", T.LongType),
            ("avg_length", T.DoubleType),
            ("earliest_date", T.StringType),
            ("latest_date", T.StringType),
            ("date_range_days", T.LongType),
        )
    ]
)


def column_stats(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Statistics of one column, as one row."""
    return profile(df, [name], exact)


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Statistics of many columns, one row per column in the given order.

    With ``exact=False`` distinct counts, quartiles and outliers come from sketches (see `sketches`), which takes one
    scan and shuffles a row per task; there is then no most common value.
    """
    names = list(df.columns) if columns is None else list(columns)
    for name in names:
        if name not in df.columns:
            raise ColumnNotFoundError(f"Column '{name}' not found in table")
    df = null_columns_to_string(df)
    rows = []
    for start in range(0, len(names), COLUMNS_PER_JOB):
        some = names[start : start + COLUMNS_PER_JOB]
        rows += _profile_columns(df, some) if exact else _sketched_columns(sketch(df, some), df, some)
    return df.sparkSession.createDataFrame([_stats_row(r) for r in rows], STATS_SCHEMA)


def profile_of_parts(sketches: DataFrame, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile of `df` from saved `sketch` rows of its parts; of `df` only the types are looked at."""
    names = list(df.columns) if columns is None else list(columns)
    rows = _sketched_columns(merge(sketches, names), null_columns_to_string(df), names)
    return df.sparkSession.createDataFrame([_stats_row(r) for r in rows], STATS_SCHEMA)


def _sketched_columns(sketched: DataFrame, df: DataFrame, names: list[str]) -> list[dict]:
    """The figures of one row of sketches."""
    out = []
    for name, found in zip(names, estimates(sketched, names)):
        dtype = df.schema[name].dataType
        s = {"column_name": name, "data_type": found["type"] or simplify_type(dtype), "total_rows": found["rows"] or 0, "non_null_count": found["present"] or 0}
        s |= {"null_count": s["total_rows"] - s["non_null_count"], "unique_count": min(found["distinct"] or 0, s["non_null_count"])}
        numeric = found["numbers"] and not found["other"]
        if numeric or (found["values"] and not is_string(dtype)):
            variance = found["spread"] / found["values"]
            s |= {"mean": found["mean"], "std_dev": math.sqrt(max(variance, 0.0)) if math.isfinite(variance) else None}
        if numeric:
            q1, median, q3 = found["quartiles"]
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            s |= {"median": median, "outlier_lower_bound": low, "outlier_upper_bound": high, "outlier_count": found["outside"]}
            s |= {"min_value": found["low_number"], "max_value": found["high_number"]}
            s["outlier_percentage"] = round(found["outside"] / s["non_null_count"] * 100, 1)
        if s["non_null_count"] and is_string(dtype):
            s |= {"min_length": found["min_length"], "max_length": found["max_length"], "avg_length": found["length"] / s["non_null_count"]}
        if s["non_null_count"] and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            s |= _dates(df, found, dtype)
        out.append(s)
    return out


def _profile_columns(df: DataFrame, names: list[str]) -> list[dict]:
    # fixed short names from here on, whatever the columns are called
    frame = df.select(*[column(n).alias(f"c{i}") for i, n in enumerate(names)])
    types = [f.dataType for f in frame.schema.fields]
    groups = melt(frame, {i: f"c{i}" for i in range(len(names))})
    stats = [{"column_name": n, "data_type": simplify_type(t)} for n, t in zip(names, types)]
    _collect_metrics(frame, groups, stats)
    for s, dtype in zip(stats, types):
        s["null_count"] = s["total_rows"] - s["non_null_count"]
        if s["non_null_count"] and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            s |= _dates(frame, s, dtype)
    # the distinct values and the quartiles do not need each other: their jobs run side by side
    with ThreadPoolExecutor(1) as pool:
        distinct = pool.submit(inheritable_thread_target(frame.sparkSession)(_distinct_values), frame, groups, stats)
        numbers = [g for g in groups if g.is_number] + _number_texts(frame, types, stats)
        _quartiles(frame, numbers, stats)
        distinct.result()
    return stats


# counts, ranges, lengths -----------------------------------------------------------------


#: Every metric of the first job and its type; a column has those its type allows.
_METRICS = {
    "total_rows": "bigint",
    "non_null_count": "bigint",
    "numbers": "bigint",
    "mean": "double",
    "std_dev": "double",
    "low": "string",
    "high": "string",
    "min_length": "bigint",
    "max_length": "bigint",
    "avg_length": "double",
    "not_number": "bigint",
}


def _metrics(group: Melted) -> dict[str, Column]:
    """Aggregates over the values `x` of a column."""
    x = F.col("x")
    out = {"total_rows": F.count(F.lit(1)), "non_null_count": F.count(x)}
    if group.is_number:
        # the range and the quartiles leave NaN out, mean and deviation do not
        valid = F.when(~F.isnan(x), x) if group.is_double else x
        out |= {"numbers": F.count(valid), "mean": F.avg(x), "std_dev": F.stddev_pop(x)}
        out |= {"low": F.min(valid), "high": F.max(valid)}
    elif isinstance(group.dtype, (T.TimestampType, T.TimestampNTZType)):
        out |= {"low": F.min(x), "high": F.max(x)}
    elif group.text:
        length = F.char_length(x)
        out |= {"min_length": F.min(length), "max_length": F.max(length), "avg_length": F.avg(length)}
        out["not_number"] = F.count_if(~is_number_text(x))
    return out


def _collect_metrics(frame: DataFrame, groups: list[Melted], stats: list[dict]) -> None:
    """The metrics of every column into `stats`: one scan per value type, one job."""
    branches, parsers = [], {}
    for group in groups:
        metrics = _metrics(group)
        found = group.rows(frame).groupBy("i").agg(*[expr.alias(m) for m, expr in metrics.items()])
        typed = [f"CAST({m if m in metrics else 'NULL'} AS {t}) AS {m}" for m, t in _METRICS.items()]
        branches.append(found.selectExpr("i", *typed))
        parsers |= dict.fromkeys(group.members, _parser(group.dtype))
        for i in group.members:  # all there is where the table has no rows
            stats[i] |= {"total_rows": 0, "non_null_count": 0, "numbers": 0, "unique_count": 0}
    if not branches:
        return
    for row in reduce(DataFrame.unionAll, branches).collect():
        values = {m: row[m] for m in _METRICS if row[m] is not None}
        values |= {side: parsers[row.i](values[side]) for side in ("low", "high") if side in values}
        stats[row.i] |= values


def _parser(dtype: T.DataType):
    """How the text of a smallest or largest value is read back."""
    if isinstance(dtype, T.LongType):
        return int
    if isinstance(dtype, T.DoubleType):
        return float
    return Decimal if isinstance(dtype, T.DecimalType) else str


def _dates(frame: DataFrame, s: dict, dtype: T.DataType) -> dict:
    """First and last date as text, and the whole days between them, rounded down."""
    try:
        first, last = (dt.datetime.fromisoformat(s[side]) for side in ("low", "high"))
    except ValueError:  # a year past 9999
        return {"earliest_date": s["low"], "latest_date": s["high"]}
    days = (last - first) // dt.timedelta(days=1)
    if isinstance(dtype, T.DateType):
        return {"earliest_date": str(first.date()), "latest_date": str(last.date()), "date_range_days": days}
    utc = frame.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "+00:00")
    zone = "+00:00" if utc and isinstance(dtype, T.TimestampType) else ""
    return {"earliest_date": f"{first}{zone}", "latest_date": f"{last}{zone}", "date_range_days": days}


# distinct values -------------------------------------------------------------------------


def _distinct_values(frame: DataFrame, groups: list[Melted], stats: list[dict]) -> None:
    """Distinct counts of all columns and the most common texts, as one job.

    Values are counted per task before they are shuffled by (column, value), so a value that
    fills most of a column is one row per task.
    """
    branches = []
    for group in groups:
        members = group.members
        if isinstance(group.dtype, T.StringType):
            long = {i for i in members if not group.text or stats[i].get("max_length", 0) > DIGEST_OVER}
            members = {i: digest_key(col) if i in long else col for i, col in members.items()}
        values = Melted(group.dtype, group.text, members).rows(frame).filter("x is not null")
        counted = values.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
        distinct = F.count(F.lit(1)).alias("unique_count")
        if group.text:
            top = F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("top")  # most frequent, then smallest
            found = counted.groupBy("i").agg(distinct, top)
            branches.append(found.select("i", "unique_count", (-F.col("top.n")).alias("n"), F.col("top.x").alias("x")))
        else:
            found = counted.groupBy("i").agg(distinct)
            branches.append(
                found.select("i", "unique_count", F.lit(None).cast("bigint").alias("n"), F.lit("").alias("x"))
            )
    if not branches:
        return
    for row in reduce(DataFrame.unionAll, branches).collect():
        s = stats[row.i]
        s["unique_count"] = row.unique_count
        if row.n is not None:
            s["most_common_count"] = row.n
            long = len(row.x) > DIGEST_OVER
            s["most_common_value"] = _smallest_of_top(frame, F.col(f"c{row.i}"), row.n) if long else row.x


def _smallest_of_top(frame: DataFrame, col: Column, count: int) -> str:
    """The smallest of the most frequent texts, where long texts are among them.

    Their keys are looked up again. Few keys are broadcast; many can only be many where none
    is frequent, so that join has no hot key.
    """
    texts = frame.filter(col.isNotNull()).select(col.alias("text"), digest_key(col).alias("key"))
    if count > 1:
        top = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == count).select("key")
        few = top.limit(_FEW_KEYS + 1).collect()
        if len(few) <= _FEW_KEYS:
            top = F.broadcast(frame.sparkSession.createDataFrame(few, top.schema))
        texts = texts.join(top, "key", "left_semi")
    return texts.agg(F.min("text")).first()[0]


# numbers ---------------------------------------------------------------------------------


def _number_texts(frame: DataFrame, types: list[T.DataType], stats: list[dict]) -> list[Melted]:
    """The text columns that hold only numbers, read as such, with their metrics added."""
    texts = [
        i for i, (t, s) in enumerate(zip(types, stats)) if is_string(t) and s["non_null_count"] and not s["not_number"]
    ]
    if not texts:
        return []
    fractions = [F.count_if(text_to_long(F.col(f"c{i}")).isNull() & F.col(f"c{i}").isNotNull()) for i in texts]
    kinds = {"int": Melted(T.LongType()), "float": Melted(T.DoubleType())}
    for i, not_integers in zip(texts, frame.agg(*fractions).first()):
        kind = "float" if not_integers else "int"
        kinds[kind].members[i] = numeric_view(F.col(f"c{i}"), types[i], kind)
    groups = [g for g in kinds.values() if g.members]
    scratch = [dict() for _ in stats]
    _collect_metrics(frame, groups, scratch)
    for s, found in zip(stats, scratch):
        s |= {m: v for m, v in found.items() if m not in ("total_rows", "non_null_count", "unique_count")}
    return groups


def _quartiles(frame: DataFrame, groups: list[Melted], stats: list[dict]) -> None:
    """Median, and the values outside the quartiles by more than 1.5 times their distance."""
    some = {i: stats[i] for g in groups for i in g.members if stats[i]["numbers"]}
    if some:
        extent = {i: (s["numbers"], s["low"], s["high"]) for i, s in some.items()}
        ranks = {i: quantile_ranks(s["numbers"], _QUARTERS) for i, s in some.items()}
        ordered = order_statistics(frame, groups, extent, ranks)
        for i, s in some.items():
            s["quartiles"] = [interpolate(ordered[i], s["numbers"], q) for q in _QUARTERS]
    for s in some.values():
        q1, median, q3 = s["quartiles"]
        s["bounds"] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        s |= {"median": median, "outlier_lower_bound": s["bounds"][0], "outlier_upper_bound": s["bounds"][1]}
        s |= {"min_value": float(s["low"]), "max_value": float(s["high"])}
        s["outlier_count"] = 0
    branches = []
    for group in groups:
        limits = {i: some[i]["bounds"] for i in group.members if i in some}
        if not limits:
            continue
        values = Melted(T.DoubleType(), members={i: group.members[i].cast("double") for i in limits}).rows(frame)
        low, high = (
            F.get(constants([limits.get(i, (None, None))[side] for i in range(len(stats))], "double"), F.col("i"))
            for side in (0, 1)
        )
        outside = ((F.col("x") < low) | (F.col("x") > high)) & ~F.isnan("x")
        branches.append(values.filter(outside).groupBy("i").agg(F.count(F.lit(1)).alias("n")))
    for row in reduce(DataFrame.unionAll, branches).collect() if branches else ():
        some[row.i]["outlier_count"] = row.n
    for s in some.values():
        s["outlier_percentage"] = round(s["outlier_count"] / s["non_null_count"] * 100, 1)


_DECIMALS = dict.fromkeys(("mean", "median", "std_dev", "outlier_lower_bound", "outlier_upper_bound"), 2)
_DECIMALS |= {"avg_length": 1}


def _stats_row(s: dict) -> tuple:
    """One output row: shares in percent, and null for what JSON cannot hold."""
    total = s["total_rows"]
    null_share = s["null_count"] / total * 100 if total else 0.0
    s["null_percentage"] = round(null_share, 1)
    s["non_null_percentage"] = round(100 - null_share, 1) if total else 0.0
    s["unique_percentage"] = round(s["unique_count"] / total * 100, 1) if total else 0.0
    row = []
    for f in STATS_SCHEMA.fields:
        value = s.get(f.name)
        if isinstance(value, float):
            value = round(value, _DECIMALS.get(f.name, 17)) if math.isfinite(value) else None
        row.append(value)
    return tuple(row)
