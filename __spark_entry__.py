"""The registered queries, each with its DuckDB counterpart.

Every query runs an operator of `tableprobe` over whole tables. Tables without nulls, NaN or
odd values get them by an expression over all rows, the same on both sides.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from tableprobe.functions import (  # noqa: E402
    blob_placeholder,
    file_size_text,
    hex_text,
    row_json,
    slugify,
    text_view,
    truncate_text,
    wire_view,
)
from tableprobe.operators import (  # noqa: E402
    Filter,
    apply_filters,
    column_stats,
    compile_filters,
    page,
    page_totals,
    parse_filter_entry,
    profile,
    top_values,
    value_counts,
    with_row_index,
)
from tableprobe.operators.sheet import to_sheet_safe  # noqa: E402
from tableprobe.plans import Explorer, count_export, export  # noqa: E402
from tableprobe.session import configure, scratch_dir  # noqa: E402
from tableprobe.sources import (  # noqa: E402
    classify_files,
    column_metadata,
    grid_to_table,
    infer_types,
    list_tables,
    mark_missing,
    parquet_catalogue,
    read_csv,
    read_sqlite,
    read_table,
    read_tsv,
    read_workbook,
    resolve_kinds,
    table_to_grid,
    type_text_columns,
)
from tableprobe.streaming import current_profile, keep_current, keep_profile, latest, live_profile, live_value_counts, read_arriving  # noqa: E402
from tableprobe.testing import join_files, write_databases, write_split, write_workbooks  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a function under its own name, with its SQL where there is one."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        _QUERIES[function.__name__] = run
        if sql is not None:
            _ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(df: DataFrame, least: int) -> int:
    """Parts of 250,000 rows, so that the share of a task does not grow with the table."""
    return max(least, -(-df.count() // 250_000))


# The columns of `orders` in wire form, and its rows with their position.
_ORDERS = """o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority"""
_NUMBERED_ORDERS = "(SELECT *, row_number() OVER () AS row_index FROM orders) o"


# pages -----------------------------------------------------------------------------------


@_query(f"SELECT {_ORDERS}, row_index FROM {_NUMBERED_ORDERS} WHERE row_index BETWEEN 1001 AND 1500")
def page_plain(spark, d):
    return wire_view(page(_table(spark, d, "orders"), offset=1000, limit=500, whole_table=True))


def flagship(orders: DataFrame) -> DataFrame:
    """Rows 21-30 of the urgent orders by price, with their original row numbers."""
    urgent = [Filter("o_orderpriority", "URG")]
    return wire_view(page(orders, urgent, "o_totalprice", ascending=False, offset=20, limit=10, position="position"))


@_query(
    f"""SELECT {_ORDERS}, row_index, position FROM (
      SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, row_index) AS position
      FROM {_NUMBERED_ORDERS} WHERE contains(o_orderpriority, 'URG')) p
    WHERE position BETWEEN 21 AND 30"""
)
def page_filtered_sorted(spark, d):
    return flagship(_table(spark, d, "orders"))


@_query(
    f"""SELECT {_ORDERS}, row_index, position FROM (
      SELECT *, row_number() OVER (ORDER BY o_custkey, row_index) AS position FROM {_NUMBERED_ORDERS}) p
    WHERE position BETWEEN 501 AND 1000"""
)
def page_second_continues(spark, d):
    return wire_view(page(_table(spark, d, "orders"), sort_by="o_custkey", offset=500, limit=500, position="position"))


@_query(
    f"""SELECT {_ORDERS}, row_index FROM (
      SELECT *, row_number() OVER (ORDER BY o_custkey, row_index) AS position FROM {_NUMBERED_ORDERS}) p
    WHERE position BETWEEN 501 AND 1000"""
)
def page_keyset(spark, d):
    """The same rows as the second page, reached from the last row of the first."""
    orders = _table(spark, d, "orders")
    last = page(orders, sort_by="o_custkey", limit=500).collect()[-1]
    return wire_view(page(orders, sort_by="o_custkey", limit=500, after=(last.o_custkey, last.row_index)))


# The columns of `lineitem` in wire form, and its rows with their position.
_LINES = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS l_shipdate"""
_NUMBERED_LINES = "(SELECT *, row_number() OVER () AS row_index FROM lineitem) l"


def _deep_page_sql(order: str, filtered: str = "true") -> str:
    return f"""SELECT {_LINES}, row_index, position FROM (
      SELECT *, row_number() OVER (ORDER BY {order}row_index) AS position, count(*) OVER () AS total FROM {_NUMBERED_LINES} WHERE {filtered}) p
    WHERE position BETWEEN total * 6 // 10 + 1 AND total * 6 // 10 + 500"""


def _deep_page(spark, d, sort_by=None, filters=(), **options):
    """500 rows from six tenths of the table on."""
    lines = _table(spark, d, "lineitem")
    total = page_totals(lines, filters, use_regex=options.get("use_regex", False)).first().total_rows
    return wire_view(page(lines, filters, sort_by, offset=total * 6 // 10, limit=500, position="position", **options))


@_query(_deep_page_sql("l_shipdate, "))
def page_deep_sorted(spark, d):
    return _deep_page(spark, d, "l_shipdate")


@_query(_deep_page_sql("l_returnflag DESC, "))
def page_deep_sorted_text(spark, d):
    """Three texts order all rows, so that row numbers decide."""
    return _deep_page(spark, d, "l_returnflag", ascending=False)


@_query(_deep_page_sql("l_extendedprice DESC, ", "l_quantity >= 5"))
def page_deep_filtered_sorted(spark, d):
    return _deep_page(spark, d, "l_extendedprice", [Filter("l_quantity", "5", "number", ">=")], ascending=False)


@_query(_deep_page_sql("", "contains(l_returnflag, 'N') OR contains(l_returnflag, 'A')"))
def page_deep_filtered(spark, d):
    """The rows that pass a filter, in file order."""
    return _deep_page(spark, d, None, [Filter("l_returnflag", "N|A")], use_regex=True)


@_query(_deep_page_sql("l_extendedprice DESC, "))
def page_sorted_copy(spark, d):
    """A deep page from a copy that was sorted once."""
    table = Explorer(spark, f"{d}/lineitem.parquet", kind="parquet").stage(sort_by="l_extendedprice", ascending=False)
    total = table.totals().first().total_rows
    return table.page(sort_by="l_extendedprice", ascending=False, offset=total * 6 // 10, limit=500, position="position")


@_query(
    """SELECT CAST(1000 AS BIGINT) AS "offset", CAST(500 AS BIGINT) AS "limit", count(*) AS total_rows,
      1500 < count(*) AS has_more FROM orders WHERE contains(o_orderpriority, 'URG')"""
)
def page_total_rows(spark, d):
    return page_totals(_table(spark, d, "orders"), [Filter("o_orderpriority", "URG")], 1000, 500)


@_query("SELECT o_orderkey, row_number() OVER () AS row_index FROM orders")
def row_index_single_file(spark, d):
    return with_row_index(_table(spark, d, "orders")).select("o_orderkey", "row_index")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_index FROM orders")
def row_index_many_files(spark, d):
    """Positions over a folder of files, in the order of their paths."""
    folder = scratch_dir(spark, "orders")
    ordered = _table(spark, d, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.write.parquet(folder)
    return with_row_index(spark.read.parquet(folder)).select("o_orderkey", "row_index")


@_query("SELECT o_orderkey, row_index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_index"
        " FROM orders) WHERE row_index BETWEEN 5001 AND 5500")
def page_many_files(spark, d):
    """A plain page of a folder reads only the files that hold it."""
    folder = scratch_dir(spark, "orders")
    ordered = _table(spark, d, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.write.parquet(folder)
    return page(spark.read.parquet(folder), offset=5000, limit=500, whole_table=True).select("o_orderkey", "row_index")


# filters ---------------------------------------------------------------------------------


@_query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def filter_substring(spark, d):
    return apply_filters(_table(spark, d, "part"), [Filter("p_name", "ring")]).select("p_partkey", "p_name")


@_query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RiNG'))")
def filter_substring_ci(spark, d):
    part = _table(spark, d, "part")
    return apply_filters(part, [Filter("p_name", "RiNG")], case_insensitive=True).select("p_partkey", "p_name")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE contains(CAST(l_orderkey AS VARCHAR), '77')")
def filter_substring_int(spark, d):
    return apply_filters(_table(spark, d, "lineitem"), [Filter("l_orderkey", "77")]).select(
        "l_orderkey", "l_linenumber"
    )


_DOUBLE_TEXT = (
    "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
)


@_query(f"SELECT l_orderkey, l_extendedprice FROM lineitem WHERE contains({_DOUBLE_TEXT.format('l_extendedprice')}, '5.1')")
def filter_substring_double(spark, d):
    return apply_filters(_table(spark, d, "lineitem"), [Filter("l_extendedprice", "5.1")]).select(
        "l_orderkey", "l_extendedprice"
    )


@_query("SELECT o_orderkey FROM orders WHERE contains(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), '-12-2')")
def filter_substring_datetime(spark, d):
    return apply_filters(_table(spark, d, "orders"), [Filter("o_orderdate", "-12-2")]).select("o_orderkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '0[0-3]7$|^Customer#0+1[25]')")
def filter_regex(spark, d):
    wanted = [Filter("c_name", "0[0-3]7$|^Customer#0+1[25]")]
    return apply_filters(_table(spark, d, "customer"), wanted, use_regex=True).select("c_custkey", "c_name")


@_query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(eco|pro).*y?$', 'i')")
def filter_regex_ci(spark, d):
    wanted = [Filter("p_type", "^(eco|pro).*y?$")]
    part = _table(spark, d, "part")
    return apply_filters(part, wanted, case_insensitive=True, use_regex=True).select("p_partkey", "p_type")


@_query("SELECT doc_id FROM documents WHERE contains(text, '(a') OR contains(text, 'x(a')")
def filter_regex_invalid(spark, d):
    """An invalid pattern is searched for as it stands."""
    return apply_filters(_table(spark, d, "documents"), [Filter("text", "(a")], use_regex=True).select("doc_id")


def _holes(df: DataFrame, name: str, value: str) -> DataFrame:
    """Nulls in place of one value."""
    return df.withColumn(name, F.nullif(F.col(name), F.lit(value)))


@_query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders"
        " WHERE coalesce(nullif(o_orderstatus, 'P'), '(null)') IN ('F', '(null)')")
def filter_value_list(spark, d):
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P")
    wanted = [Filter("o_orderstatus", ("F", "(null)"), "values")]
    return apply_filters(orders, wanted).select("o_orderkey", "o_orderstatus")


@_query("SELECT * FROM part WHERE p_size IN (5, 7)")
def filter_value_list_numbers(spark, d):
    """Texts that are no size, or not as the size is written, match nothing."""
    wanted = [Filter("p_size", ("5", "7", "09", "x", "(null)"), "values")]
    return apply_filters(_table(spark, d, "part"), wanted)


@_query("SELECT o_orderkey FROM orders WHERE contains(coalesce(nullif(o_orderstatus, 'P'), '(null)'), 'null')")
def filter_null_token(spark, d):
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P")
    return apply_filters(orders, [Filter("o_orderstatus", "null")]).select("o_orderkey")


def _number_filter(operator: str) -> Query:
    def run(spark, d):
        wanted = [Filter("l_quantity", "24", "number", operator)]
        return apply_filters(_table(spark, d, "lineitem"), wanted).select("l_orderkey", "l_linenumber", "l_quantity")

    return run


for _label, _operator in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "=")):
    _run = _number_filter(_operator)
    _run.__name__ = f"filter_number_{_label}"
    _query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_operator} 24")(_run)


@_query("SELECT p_partkey, p_size FROM part WHERE p_size > 10.5")
def filter_int_decimal_entry(spark, d):
    return apply_filters(_table(spark, d, "part"), [Filter("p_size", "10.5", "number", ">")]).select(
        "p_partkey", "p_size"
    )


@_query("SELECT event_id FROM events WHERE CAST(user_id AS HUGEINT) + 9223372036854775808 > 9223372036854775830")
def filter_wide_int(spark, d):
    """Unsigned 64-bit integers are compared digit by digit, not as doubles."""
    wide = (F.col("user_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast(
        "decimal(20,0)"
    )
    events = _table(spark, d, "events").withColumn("wide", wide)
    return apply_filters(events, [Filter("wide", "9223372036854775830", "number", ">")]).select("event_id")


_NAN_EVENTS = "(SELECT event_id, CASE WHEN event_id % 10 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value FROM events)"


def _nan_events(spark, d):
    events = _table(spark, d, "events")
    return events.withColumn("value", F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")))


@_query(f"SELECT event_id, value FROM {_NAN_EVENTS} WHERE value > 5 AND NOT isnan(value)")
def filter_nan_false(spark, d):
    return apply_filters(_nan_events(spark, d), [Filter("value", "5", "number", ">")]).select("event_id", "value")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND contains(l_returnflag, 'A')"
        " AND l_discount < 0.05")
def filter_and(spark, d):
    wanted = [
        Filter("l_quantity", "30", "number", ">="),
        Filter("l_returnflag", "A"),
        Filter("l_discount", "0.05", "number", "<"),
    ]
    return apply_filters(_table(spark, d, "lineitem"), wanted).select("l_orderkey", "l_linenumber")


@_query("SELECT c_custkey, CAST(4 AS BIGINT) AS skipped FROM customer")
def filter_ignored(spark, d):
    """Filters that say nothing leave the table whole."""
    customer = _table(spark, d, "customer")
    wanted = [
        Filter("no_such_column", "x"),
        Filter("c_name", ""),
        Filter("c_acctbal", "much", "number", ">"),
        Filter("c_acctbal", "1", "number", "=>"),
    ]
    compiled = compile_filters(customer, wanted)
    rows = customer if compiled.predicate is None else customer.filter(compiled.predicate)
    return rows.select("c_custkey", F.lit(len(compiled.skipped)).cast("bigint").alias("skipped"))


@_query("SELECT c_custkey FROM customer WHERE c_acctbal <= 2500.5 AND contains(c_mktsegment, 'B')")
def filter_typed_entries(spark, d):
    """Filters as typed above the columns."""
    customer = _table(spark, d, "customer")
    typed = {"c_acctbal": "<= 2500.5", "c_mktsegment": "B", "c_name": "  "}
    wanted = [parse_filter_entry(n, e, customer.schema[n].dataType) for n, e in typed.items()]
    return apply_filters(customer, [w for w in wanted if w]).select("c_custkey")


# order -----------------------------------------------------------------------------------


def _status_sort(ascending: bool) -> Query:
    def run(spark, d):
        orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "F")
        rows = page(orders, sort_by="o_orderstatus", ascending=ascending, offset=4000, limit=500, position="position")
        return rows.select("o_orderkey", "o_orderstatus", "row_index", "position")

    return run


for _label, _ascending in (("asc", True), ("desc", False)):
    _run = _status_sort(_ascending)
    _run.__name__ = f"sort_nulls_last_{_label}"
    _query(
        f"""SELECT o_orderkey, o_orderstatus, row_index, position FROM (
          SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, row_index,
            row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') {_label.upper()} NULLS LAST, row_index) AS position
          FROM {_NUMBERED_ORDERS}) p WHERE position BETWEEN 4001 AND 4500"""
    )(_run)


@_query(
    f"""SELECT event_id, row_index, position FROM (
      SELECT event_id, row_index, row_number() OVER (
        ORDER BY value IS NULL, coalesce(isnan(value), false), value DESC, row_index) AS position
      FROM (SELECT event_id, row_index, CASE WHEN event_id % 7 = 0 THEN NULL
              WHEN event_id % 5 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value
            FROM (SELECT *, row_number() OVER () AS row_index FROM events)) e) p
    WHERE position BETWEEN 6001 AND 9000"""
)
def sort_nan_then_nulls(spark, d):
    """Values, then NaN, then nulls, also from high to low."""
    value = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, float("nan"))
    events = _table(spark, d, "events").withColumn("value", value.otherwise(F.col("value")))
    rows = page(events, sort_by="value", ascending=False, offset=6000, limit=3000, position="position")
    return rows.select("event_id", "row_index", "position")


@_query(
    """SELECT p_partkey, p_size, row_index, position FROM (
      SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, row_index,
        row_number() OVER (ORDER BY p_size, row_index) AS position
      FROM (SELECT *, row_number() OVER () AS row_index FROM part)) p WHERE position <= 500"""
)
def sort_numeric_text(spark, d):
    """Numbers written as text come in the order of the numbers."""
    part = _table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("string"))
    rows = page(part, sort_by="p_size", limit=500, position="position")
    return rows.select("p_partkey", "p_size", "row_index", "position")


# statistics ------------------------------------------------------------------------------


def _stats_sql(source: str, expr: str, name: str, dtype: str, number: str | None = None) -> str:
    """One statistics row in SQL. `number` is the numeric reading of the column, if it has one."""

    def r(expression: str, digits: int) -> str:
        # statistics round the binary value, with ties to even
        return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"

    is_text = dtype == "string"
    value = f"CAST({number} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    longest = "length(x)" if is_text else "CAST(NULL AS BIGINT)"
    moment = {"date": "CAST(x AS DATE)", "datetime": "CAST(x AS TIMESTAMP)"}.get(dtype, "CAST(NULL AS TIMESTAMP)")
    shown = {
        "date": "strftime({0}, '%Y-%m-%d')",
        "datetime": "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%d %H:%M:%S')"
        " ELSE strftime({0}, '%Y-%m-%d %H:%M:%S.%f') END",
    }.get(dtype, "CAST({0} AS VARCHAR)")
    span = "CAST(floor((epoch_us(CAST(last AS TIMESTAMP)) - epoch_us(CAST(first AS TIMESTAMP))) / 86400000000) AS BIGINT)"
    top = (
        "(SELECT {0} FROM (SELECT x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY x ORDER BY n DESC, x LIMIT 1))"
        if is_text
        else None
    )
    return f"""SELECT '{name}' AS column_name, '{dtype}' AS data_type, total_rows, non_null_count,
      CASE WHEN total_rows = 0 THEN CAST(0 AS DOUBLE) ELSE {r('100 - CAST(total_rows - non_null_count AS DOUBLE) / total_rows * 100', 1)}
        END AS non_null_percentage,
      total_rows - non_null_count AS null_count,
      CASE WHEN total_rows = 0 THEN CAST(0 AS DOUBLE) ELSE {r('CAST(total_rows - non_null_count AS DOUBLE) / total_rows * 100', 1)}
        END AS null_percentage,
      unique_count,
      CASE WHEN total_rows = 0 THEN CAST(0 AS DOUBLE) ELSE {r('CAST(unique_count AS DOUBLE) / total_rows * 100', 1)}
        END AS unique_percentage,
      low AS min_value, high AS max_value,
      CASE WHEN isfinite(mean) THEN {r('mean', 2)} END AS mean, {r('q2', 2)} AS median,
      CASE WHEN isfinite(deviation) THEN {r('deviation', 2)} END AS std_dev,
      outliers AS outlier_count,
      {r('CAST(outliers AS DOUBLE) / non_null_count * 100', 1)} AS outlier_percentage,
      {r('q1 - 1.5 * (q3 - q1)', 2)} AS outlier_lower_bound, {r('q3 + 1.5 * (q3 - q1)', 2)} AS outlier_upper_bound,
      {top.format('x') if top else 'CAST(NULL AS VARCHAR)'} AS most_common_value,
      {top.format('n') if top else 'CAST(NULL AS BIGINT)'} AS most_common_count,
      min_length, max_length, {r('avg_length', 1)} AS avg_length,
      CAST({shown.format('first')} AS VARCHAR) AS earliest_date, CAST({shown.format('last')} AS VARCHAR) AS latest_date,
      {span} AS date_range_days
    FROM (SELECT count(*) AS total_rows, count(x) AS non_null_count, count(DISTINCT x) AS unique_count,
        avg(y) AS mean, min(y) FILTER (WHERE NOT isnan(y)) AS low, max(y) FILTER (WHERE NOT isnan(y)) AS high,
        CASE WHEN isfinite(avg(y)) THEN stddev_pop(y) FILTER (WHERE isfinite(y)) END AS deviation,
        min({longest}) AS min_length, max({longest}) AS max_length, avg({longest}) AS avg_length,
        min({moment}) AS first, max({moment}) AS last FROM v) a,
      (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3
       FROM v WHERE NOT isnan(y)) q,
      (SELECT CASE WHEN count(y) = 0 THEN NULL ELSE count(*) FILTER (WHERE NOT isnan(y) AND (y < b.lo OR y > b.hi)) END AS outliers
       FROM v, (SELECT quantile_cont(y, 0.25) - 1.5 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) AS lo,
                  quantile_cont(y, 0.75) + 1.5 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) AS hi
                FROM v WHERE NOT isnan(y)) b) o""".replace(
        "FROM v", f"FROM (SELECT x, {value} AS y FROM (SELECT {expr} AS x FROM {source}) s) v"
    )


@_query(_stats_sql("lineitem", "l_extendedprice", "l_extendedprice", "float", "x"))
def stats_numeric(spark, d):
    return column_stats(_table(spark, d, "lineitem"), "l_extendedprice")


@_query(_stats_sql("lineitem", "l_orderkey", "l_orderkey", "int", "x"))
def stats_integer(spark, d):
    return column_stats(_table(spark, d, "lineitem"), "l_orderkey")


@_query(_stats_sql("events", "value", "value", "float", "x"))
def stats_outliers(spark, d):
    return column_stats(_table(spark, d, "events"), "value")


@_query(_stats_sql(_NAN_EVENTS, "value", "value", "float", "x"))
def stats_nan(spark, d):
    """NaN is left out of range, quartiles and outliers; the mean of a column with NaN is not a number."""
    return column_stats(_nan_events(spark, d), "value")


@_query(_stats_sql("part", "p_type", "p_type", "string"))
def stats_string(spark, d):
    return column_stats(_table(spark, d, "part"), "p_type")


@_query(_stats_sql("documents", "text", "text", "string"))
def stats_long_text(spark, d):
    return column_stats(_table(spark, d, "documents"), "text")


@_query(_stats_sql("events", "ts", "ts", "datetime"))
def stats_datetime(spark, d):
    return column_stats(_table(spark, d, "events"), "ts")


@_query(_stats_sql("orders", "CAST(o_orderdate AS DATE)", "o_orderdate", "date"))
def stats_date(spark, d):
    return column_stats(_table(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")), "o_orderdate")


@_query(_stats_sql("lineitem", "l_returnflag = 'R'", "returned", "boolean"))
def stats_boolean(spark, d):
    return column_stats(_table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("returned")), "returned")


@_query(_stats_sql("part", "CAST(p_size AS VARCHAR)", "p_size", "string", "x"))
def stats_numeric_text(spark, d):
    return column_stats(_table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("string")), "p_size")


@_query(_stats_sql("orders", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END", "o_totalprice", "float", "x"))
def stats_with_nulls(spark, d):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return column_stats(_table(spark, d, "orders").withColumn("o_totalprice", price), "o_totalprice")


@_query(
    """SELECT 'p_name' AS column_name, 'string' AS data_type, count(*) AS total_rows, CAST(0 AS BIGINT) AS non_null_count,
      count(*) AS null_count, CAST(100 AS DOUBLE) AS null_percentage, CAST(0 AS DOUBLE) AS non_null_percentage, CAST(0 AS BIGINT) AS unique_count,
      CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS BIGINT) AS max_length FROM part"""
)
def stats_all_null(spark, d):
    nothing = _table(spark, d, "part").withColumn("p_name", F.nullif("p_name", "p_name"))
    return column_stats(nothing, "p_name").select(
        "column_name", "data_type", "total_rows", "non_null_count", "null_count", "null_percentage",
        "non_null_percentage", "unique_count", "mean", "max_length",
    )


@_query(
    """SELECT 'p_size' AS column_name, 'int' AS data_type, count(*) AS total_rows, count(p_size) AS non_null_count,
      CAST(0 AS DOUBLE) AS null_percentage, CAST(0 AS DOUBLE) AS non_null_percentage, count(DISTINCT p_size) AS unique_count,
      CAST(NULL AS DOUBLE) AS mean FROM part WHERE p_size < -1"""
)
def stats_zero_rows(spark, d):
    empty = _table(spark, d, "part").filter("p_size < -1")
    return column_stats(empty, "p_size").select(
        "column_name", "data_type", "total_rows", "non_null_count", "null_percentage", "non_null_percentage",
        "unique_count", "mean",
    )


_PROFILES = {
    "orders": {
        "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float",
        "o_orderdate": "datetime", "o_orderpriority": "string",
    },
    "events": {
        "event_id": "int", "ts": "datetime", "user_id": "int", "event_type": "string", "value": "float",
        "props": "string",
    },
    "lineitem": {
        "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float",
        "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "datetime",
    },
    "documents": {"doc_id": "int", "text": "string", "lang": "string", "source": "string", "n_chars": "int"},
}


def _profile_query(table: str) -> Query:
    def run(spark, d):
        return profile(_table(spark, d, table))

    return run


for _name, _columns in _PROFILES.items():
    _run = _profile_query(_name)
    _run.__name__ = f"profile_{_name}"
    _query(
        " UNION ALL ".join(
            f"SELECT * FROM ({_stats_sql(_name, c, c, t, 'x' if t in ('int', 'float') else None)})"
            for c, t in _columns.items()
        )
    )(_run)


@_query()
def profile_approximate(spark, d):
    """The one-scan form: sketched distinct counts and quartiles."""
    return profile(_table(spark, d, "lineitem"), exact=False)


def _folder(spark, label: str, *parts: DataFrame) -> str:
    """A folder of Parquet files of several layouts."""
    folder = scratch_dir(spark, label)
    for number, part in enumerate(parts):
        part.write.parquet(f"{folder}/part={number}")
    return folder


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus,
      o_totalprice, CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END AS o_orderpriority,
      CAST(o_orderkey % 3 AS INT) AS part FROM orders"""
)
def parquet_unlike_files(spark, d):
    """Orders in files of three layouts, with columns in other orders and of other widths."""
    orders = _table(spark, d, "orders")
    third = [orders.filter(F.col("o_orderkey") % 3 == n) for n in range(3)]
    folder = _folder(
        spark,
        "unlike",
        third[0].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"),
        third[1].select("o_totalprice", F.col("o_custkey").cast("int"), "o_orderstatus", "o_orderkey"),
        third[2].select("o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"),
    )
    return read_table(spark, folder, kind="parquet")


@_query(
    """SELECT l_linenumber AS part, c.name AS name, count(*) AS rows, CAST(sum(CASE WHEN c.name = 'l_tax' AND l_tax = 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
      CASE c.name WHEN 'l_orderkey' THEN CAST(min(l_orderkey) AS VARCHAR) WHEN 'l_returnflag' THEN min(l_returnflag)
        ELSE CAST(min(CASE WHEN l_tax <> 0.05 THEN l_tax END) AS VARCHAR) END AS low,
      CASE c.name WHEN 'l_orderkey' THEN CAST(max(l_orderkey) AS VARCHAR) WHEN 'l_returnflag' THEN max(l_returnflag)
        ELSE CAST(max(CASE WHEN l_tax <> 0.05 THEN l_tax END) AS VARCHAR) END AS high
    FROM lineitem, (VALUES ('l_orderkey'), ('l_returnflag'), ('l_tax')) c(name) GROUP BY l_linenumber, c.name"""
)
def parquet_catalogue_bounds(spark, d):
    """Rows, nulls and bounds from footers alone, of a folder with a file for each line number."""
    lines = _table(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") != 0.05, F.col("l_tax")))
    folder = scratch_dir(spark, "catalogue")
    write_split(lines.select("l_linenumber", "l_orderkey", "l_returnflag", "l_tax"), "l_linenumber", folder)
    found = parquet_catalogue(spark, folder)
    part = F.regexp_extract("path", "l_linenumber=([0-9]+)", 1).cast("int").alias("part")
    return found.select(part, F.col("rows"), F.explode("columns").alias("c")).select("part", "c.name", "rows", "c.nulls", "c.low", "c.high")


@_query(
    """SELECT name, type, position, (SELECT count(*) FROM lineitem) AS total_rows FROM (VALUES
      ('l_orderkey', 'int', 1), ('l_partkey', 'int', 2), ('l_suppkey', 'int', 3), ('l_linenumber', 'int', 4),
      ('l_quantity', 'float', 5), ('l_extendedprice', 'float', 6), ('l_discount', 'float', 7), ('l_tax', 'float', 8),
      ('l_returnflag', 'string', 9), ('l_linestatus', 'string', 10), ('l_shipdate', 'datetime', 11))
      t(name, type, position)"""
)
def table_columns(spark, d):
    return column_metadata(_table(spark, d, "lineitem")).drop("file_size", "source_type")


# value counts ----------------------------------------------------------------------------


def _counts_sql(source: str, value: str, limit: int = 0, tie: str = "first") -> str:
    cut = f"LIMIT {limit}" if limit else ""
    return f"""SELECT value, "count", pct, total_unique FROM (
      SELECT {value} AS value, count(*) AS "count", min(ri) AS first,
        CAST(round(CAST(CAST(count(*) / sum(count(*)) OVER () * 100 AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS pct,
        count(*) OVER () AS total_unique
      FROM (SELECT *, row_number() OVER () AS ri FROM {source}) GROUP BY 1) g
    ORDER BY "count" DESC, {tie} {cut}"""


@_query(_counts_sql("events", "event_type"))
def value_counts_top(spark, d):
    return value_counts(_table(spark, d, "events"), "event_type")


@_query(_counts_sql("part", "p_brand", 10))
def value_counts_limited(spark, d):
    return value_counts(_table(spark, d, "part"), "p_brand", 10)


@_query(_counts_sql("part", "p_name"))
def value_counts_all(spark, d):
    return value_counts(_table(spark, d, "part"), "p_name", 0)


@_query(_counts_sql("part", "p_brand", 7, "value"))
def value_counts_tie_by_value(spark, d):
    return value_counts(_table(spark, d, "part"), "p_brand", 7, tie="value")


@_query(_counts_sql("orders", "coalesce(nullif(o_orderstatus, 'P'), '(null)')"))
def value_counts_null(spark, d):
    return value_counts(_holes(_table(spark, d, "orders"), "o_orderstatus", "P"), "o_orderstatus")


@_query(_counts_sql("documents", "text", 50))
def value_counts_long_texts(spark, d):
    """The most frequent whole documents; only digests of them are shuffled."""
    return value_counts(_table(spark, d, "documents"), "text", 50, long_texts=True)


@_query(f"""SELECT value, "count", pct FROM ({_counts_sql("lineitem", "CAST(l_partkey AS VARCHAR)", 25)})""")
def top_values_many(spark, d):
    """The most frequent values of a column of many, proven without counting all of them."""
    return top_values(_table(spark, d, "lineitem"), "l_partkey", 25)


@_query("""SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag ELSE l_orderkey || '-' || l_linenumber END AS value, count(*) AS "count",
      CAST(round(CAST(CAST(count(*) / sum(count(*)) OVER () * 100 AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS pct
    FROM lineitem GROUP BY 1 ORDER BY "count" DESC LIMIT 3""")
def top_values_skewed(spark, d):
    """Three values hold a third of the rows, the others occur once."""
    odd = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_returnflag")).otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return top_values(_table(spark, d, "lineitem").withColumn("v", odd), "v", 3)


@_query(_counts_sql("lineitem", _DOUBLE_TEXT.format("l_discount"), 0))
def value_counts_double(spark, d):
    return value_counts(_table(spark, d, "lineitem"), "l_discount", 0)


@_query(_counts_sql("lineitem", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f')", 100))
def value_counts_datetime(spark, d):
    return value_counts(_table(spark, d, "lineitem"), "l_shipdate", 100)


@_query(
    """SELECT CASE WHEN v = '' THEN '(empty)' ELSE v END AS value, count(*) AS "count" FROM (
      SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS v FROM orders) GROUP BY 1"""
)
def value_counts_empty_shown(spark, d):
    blank = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    orders = _table(spark, d, "orders").withColumn("o_orderstatus", blank)
    return value_counts(orders, "o_orderstatus", display=True).select("value", "count")


# types -----------------------------------------------------------------------------------


def _text_part(spark, d):
    """`part` as text, with a column that turns to text late, one of wide integers and one of flags."""
    text = _table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("key"),
        "p_name",
        F.when(F.col("p_partkey") % 7 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.when(F.col("p_partkey") == 1999, "ACCFS-108").otherwise(F.col("p_size").cast("string")).alias("mixed"),
        F.concat(F.lit("922337203685478"), F.lpad(F.col("p_partkey").cast("string"), 4, "0")).alias("wide"),
        (F.col("p_size") > 20).cast("string").alias("large"),
        F.nullif("p_name", "p_name").alias("empty"),
    )
    return text


@_query(
    """SELECT * FROM (VALUES ('key', 'bigint'), ('p_name', 'string'), ('size', 'bigint'), ('price', 'double'),
      ('large', 'boolean'), ('empty', 'string'),
      ('wide', 'decimal(20,0)'),
      ('mixed', (SELECT CASE WHEN bool_or(p_partkey = 1999) THEN 'string' ELSE 'bigint' END FROM part))) t(name, type)"""
)
def infer_column_types(spark, d):
    marked = mark_missing(_text_part(spark, d))
    return spark.createDataFrame(list(infer_types(marked).items()), "name string, type string")


@_query(
    """SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS size,
      p_retailprice AS price, p_size > 20 AS large FROM part"""
)
def missing_markers(spark, d):
    """Markers are nulls, so a column of numbers with some NA stays one of numbers."""
    return type_text_columns(_text_part(spark, d)).select("key", "size", "price", "large")


def _cell(kind, text):
    return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"))


@_query(
    """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS widened, o_orderdate AS moment,
      CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE CAST(o_custkey AS VARCHAR) END AS mixed,
      CAST(o_orderkey AS VARCHAR) || '00000000000000000000000000' AS wide, o_orderstatus = 'F' AS flag FROM orders"""
)
def kind_resolution(spark, d):
    """Columns whose values carry their own kind."""
    orders = _table(spark, d, "orders")
    key, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    cells = orders.select(
        "o_orderkey",
        _cell(F.when(status == "O", "int").otherwise("float"), key).alias("widened"),
        _cell(F.when(status == "O", "date").otherwise("datetime"), moment).alias("moment"),
        _cell(F.when(status == "P", "datetime").otherwise("int"), F.when(status == "P", moment).otherwise(key)).alias("mixed"),
        _cell("int", F.concat(F.col("o_orderkey").cast("string"), F.lit("0" * 26))).alias("wide"),
        _cell("bool", (status == "F").cast("string")).alias("flag"),
    )
    return resolve_kinds(cells, ["widened", "moment", "mixed", "wide", "flag"])


@_query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,"
        " row_number() OVER () AS row_index FROM customer")
def grid_to_typed_table(spark, d):
    """A table taken apart into cells and put together again."""
    customer = with_row_index(_table(spark, d, "customer"), "n")
    kinds = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"}
    return grid_to_table(table_to_grid(customer, "n", kinds), row_index=True)


# renderings ------------------------------------------------------------------------------


@_query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN '<BLOB ' || CAST(n AS VARCHAR) || ' B>'
        WHEN n < 1048576 THEN '<BLOB ' || regexp_replace(CAST(CAST(floor(n / 1024.0 * 10 + 0.5) / 10 AS DECIMAL(12,1)) AS VARCHAR), '\\.0$', '') || ' KB>'
        ELSE '<BLOB ' || regexp_replace(CAST(CAST(floor(n / 1048576.0 * 10 + 0.5) / 10 AS DECIMAL(12,1)) AS VARCHAR), '\\.0$', '') || ' MB>' END AS shown
      FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)"""
)
def blob_placeholders(spark, d):
    return _table(spark, d, "documents").select("doc_id", blob_placeholder(F.encode("text", "UTF-8")).alias("shown"))


@_query("SELECT c_custkey, lower(hex(encode(c_name))) AS hex FROM customer")
def hex_binary(spark, d):
    return _table(spark, d, "customer").select("c_custkey", hex_text(F.encode("c_name", "UTF-8")).alias("hex"))


@_query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS cell FROM documents")
def truncate_cells(spark, d):
    return _table(spark, d, "documents").select("doc_id", truncate_text(F.col("text"), 100).alias("cell"))


@_query(
    """SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
        ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, user_id, event_type,
      CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, props FROM events"""
)
def wire_form(spark, d):
    return wire_view(_nan_events(spark, d))


@_query()
def wire_form_nested(spark, d):
    return wire_view(_table(spark, d, "embeddings"))


@_query("SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': nullif(o_orderstatus, 'P'),"
        " 'o_orderpriority': o_orderpriority}) AS VARCHAR) AS json FROM orders")
def rows_as_json(spark, d):
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P")
    rows = with_row_index(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return rows.select(row_json(rows).alias("json"))


@_query(
    """SELECT event_id, '{"wide":' || CASE WHEN wide > 9007199254740992 THEN '"' || CAST(wide AS VARCHAR) || '"'
      ELSE CAST(wide AS VARCHAR) END || '}' AS json
    FROM (SELECT event_id, event_id + 9007199254740000 AS wide FROM events)"""
)
def wide_integers_as_json(spark, d):
    """Integers a double cannot hold leave as text, value by value."""
    events = _table(spark, d, "events").select("event_id", (F.col("event_id") + 9007199254740000).alias("wide"))
    return events.select("event_id", row_json(events, exclude=("event_id",)).alias("json"))


@_query(
    """SELECT o_orderkey, CAST(to_json([o_orderkey, o_custkey]) AS VARCHAR) AS keys,
      CAST(to_json({'status': nullif(o_orderstatus, 'P'), 'day': strftime(o_orderdate, '%Y-%m-%d')}) AS VARCHAR) AS state
    FROM orders"""
)
def wire_form_of_structs(spark, d):
    """Lists and structs leave as JSON text, with their nulls."""
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P")
    state = F.struct(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return wire_view(orders.select("o_orderkey", F.array("o_orderkey", "o_custkey").alias("keys"), state.alias("state")))


@_query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
        " AS slug FROM part")
def slugs(spark, d):
    return _table(spark, d, "part").select("p_partkey", slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@_query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B'
      WHEN n < 1048576 THEN regexp_replace(CAST(CAST(round(n / 1024.0, 2) AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') || ' KB'
      ELSE regexp_replace(CAST(CAST(round(n / 1048576.0, 2) AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') || ' MB' END AS size
      FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)"""
)
def file_sizes(spark, d):
    return _table(spark, d, "documents").select("doc_id", file_size_text(F.col("n_chars") * 37).alias("size"))


@_query(f"SELECT l_orderkey, l_linenumber, {_DOUBLE_TEXT.format('l_quantity')} AS quantity,"
        f" {_DOUBLE_TEXT.format('l_extendedprice')} AS price, {_DOUBLE_TEXT.format('l_tax')} AS tax FROM lineitem")
def number_texts(spark, d):
    lineitem = _table(spark, d, "lineitem")

    def shown(name):
        return text_view(F.col(name), lineitem.schema[name].dataType)

    return lineitem.select(
        "l_orderkey", "l_linenumber", shown("l_quantity").alias("quantity"), shown("l_extendedprice").alias("price"),
        shown("l_tax").alias("tax"),
    )


# exports ---------------------------------------------------------------------------------


@_query(
    """SELECT CAST(o_orderkey + 9007199254740000 AS VARCHAR) AS id, o_custkey AS "ID.1", o_orderstatus AS "Id.2" FROM orders"""
)
def sheet_safe(spark, d):
    """Names that differ by more than case; integers a spreadsheet would round as text."""
    orders = _table(spark, d, "orders").select(
        (F.col("o_orderkey") + 9007199254740000).alias("id"), F.col("o_custkey").alias("ID"), F.col("o_orderstatus").alias("Id")
    )
    return to_sheet_safe(orders)


def _exported(spark, d, name: str, fmt: str, **options) -> str:
    return export(_table(spark, d, name), scratch_dir(spark, name), fmt, **options)


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,"
        " o_orderpriority FROM orders WHERE contains(o_orderpriority, 'URG')")
def export_parquet(spark, d):
    path = _exported(spark, d, "orders", "parquet", filters=[Filter("o_orderpriority", "URG")])
    return spark.read.parquet(path).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


_ORDERS_TEXT = """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders"""


@_query(_ORDERS_TEXT)
def export_csv(spark, d):
    """Written and read back with whole-file type inference."""
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P")
    return read_csv(spark, export(orders, scratch_dir(spark, "orders"), "csv"))


@_query(_ORDERS_TEXT)
def export_tsv(spark, d):
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P")
    return read_tsv(spark, export(orders, scratch_dir(spark, "orders"), "tsv"))


@_query("SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,"
        " strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders WHERE o_totalprice > 400000")
def export_jsonl(spark, d):
    path = _exported(spark, d, "orders", "jsonl", filters=[Filter("o_totalprice", "400000", "number", ">")])
    rows = spark.read.schema("o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string").json(path)
    return rows


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, row_index) AS row_index FROM"
        f" {_NUMBERED_ORDERS}")
def export_sorted(spark, d):
    """The order of the exported files is the order of the table."""
    path = _exported(spark, d, "orders", "parquet", sort_by="o_totalprice", ascending=False)
    return with_row_index(spark.read.parquet(path)).select("o_orderkey", "row_index")


@_query("SELECT CAST(o_orderkey + 9007199254740000 AS VARCHAR) AS \"Key\", o_custkey AS \"key.1\" FROM orders")
def export_sheets(spark, d):
    orders = _table(spark, d, "orders").select(
        (F.col("o_orderkey") + 9007199254740000).alias("Key"), F.col("o_custkey").alias("key")
    )
    path = export(orders, scratch_dir(spark, "orders"), "xlsx")
    return read_csv(spark, path, types={"Key": "string", "key.1": "bigint"})


@_query("SELECT count(*) AS rows FROM documents")
def export_row_count(spark, d):
    """Texts with line breaks and quotes: rows are counted by parsing."""
    return count_export(spark, _exported(spark, d, "documents", "csv"), "csv")


# sources ---------------------------------------------------------------------------------


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_ingest_documents(spark, d):
    """Whole texts with quotes and line breaks survive the round trip."""
    return read_csv(spark, _exported(spark, d, "documents", "csv"))


@_query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,"
        " row_number() OVER (ORDER BY c_custkey) AS row_index FROM customer")
def csv_ingest_numbered(spark, d):
    ordered = _table(spark, d, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    return read_csv(spark, export(ordered, scratch_dir(spark, "customer"), "csv"), row_index=True)


@_query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, 'Zürich ' || c_name AS city FROM customer")
def csv_ingest_latin1(spark, d):
    """Files that are not UTF-8 are read as Latin-1."""
    customer = _table(spark, d, "customer").withColumn("city", F.concat(F.lit("Zürich "), "c_name"))
    folder = scratch_dir(spark, "customer")
    customer.write.csv(folder, header=True, encoding="ISO-8859-1")
    return read_csv(spark, folder)


@_query("""SELECT o_orderkey, o_custkey, o_orderpriority || chr(10) || 'of "' || o_orderstatus || '", ' AS note, o_totalprice FROM orders""")
def csv_ingest_blank_lines(spark, d):
    """One file whose records span lines, with lines of blanks between some of them."""
    orders = _table(spark, d, "orders")
    note = F.concat(F.lit('"'), "o_orderpriority", F.lit('\nof ""'), "o_orderstatus", F.lit('"", "'))
    record = F.concat_ws(",", "o_orderkey", "o_custkey", note, "o_totalprice")
    blank = F.when(F.col("o_orderkey") % 5 == 0, "\n\n   ").otherwise("")
    lines = orders.select(F.concat(record, blank).alias("value"), F.col("o_orderkey").alias("place"))
    header = spark.createDataFrame([("o_orderkey,o_custkey,note,o_totalprice", -1)], lines.schema)
    ranges = header.unionByName(lines).repartitionByRange(_parts(orders, 4), "place").sortWithinPartitions("place")
    parts, folder = scratch_dir(spark, "orders-parts"), scratch_dir(spark, "orders")
    ranges.select("value").write.text(parts)
    join_files(spark, parts, f"{folder}/orders.csv")
    return read_csv(spark, folder)


@_query("SELECT * FROM customer")
def csv_ingest_mixed_headers(spark, d):
    """Files with the same columns in another order are one table, by name."""
    customer, folder = _table(spark, d, "customer"), scratch_dir(spark, "customer")
    odd = F.col("c_custkey") % 2 == 1
    customer.filter(odd).write.csv(folder, header=True)
    customer.filter(~odd).select(*reversed(customer.columns)).write.mode("append").csv(folder, header=True)
    return read_csv(spark, folder, types=dict(customer.dtypes))


@_query("SELECT c_custkey, c_name, c_custkey || '\" pipe' AS size, CASE WHEN c_custkey % 7 = 0 THEN 'two' || chr(10) || 'lines'"
        " WHEN c_custkey % 7 = 1 THEN '6\" x' END AS note FROM customer")
def csv_ingest_stray_quotes(spark, d):
    """Inch marks inside unquoted fields, beside quoted fields over two lines."""
    kind = F.col("c_custkey") % 7
    note = F.when(kind == 0, "two\nlines").when(kind == 1, '6" x')
    customer = _table(spark, d, "customer").select(
        "c_custkey", "c_name", F.concat("c_custkey", F.lit('" pipe')).alias("size"), note.alias("note")
    )
    folder = scratch_dir(spark, "customer")
    customer.write.csv(folder, header=True, escapeQuotes=False)
    return read_csv(spark, folder, types={"c_custkey": "bigint"})


@_query("SELECT event_id, user_id, event_type, value, props, CAST(epoch_us(ts) AS BIGINT) AS ts FROM events")
def tsv_ingest(spark, d):
    events = _table(spark, d, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return read_tsv(spark, export(events, scratch_dir(spark, "events"), "tsv"))


def _databases(spark, d) -> str:
    customer = _table(spark, d, "customer").withColumn(
        "mixed", F.when(F.col("c_custkey") % 100 == 3, F.col("c_name")).otherwise(F.col("c_nationkey").cast("string"))
    )
    ordered = customer.repartitionByRange(_parts(customer, 4), "c_custkey").sortWithinPartitions("c_custkey")
    folder = scratch_dir(spark, "databases")
    write_databases(ordered, folder, "customers")
    return folder


@_query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,"
        " CASE WHEN c_custkey % 100 = 3 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS mixed,"
        " row_number() OVER (ORDER BY c_custkey) AS row_index FROM customer")
def sqlite_ingest(spark, d):
    """A folder of databases as one table."""
    return read_sqlite(spark, _databases(spark, d), "customers", row_index=True)


@_query("SELECT CAST(0 AS BIGINT) AS position, 'customers' AS name")
def sqlite_tables(spark, d):
    return list_tables(spark, _databases(spark, d), "sqlite").select("position", "name").distinct()


@_query("SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,"
        " CAST(o_orderdate AS VARCHAR) AS o_orderdate, row_number() OVER (ORDER BY o_orderkey) AS row_index FROM orders")
def workbook_ingest(spark, d):
    """A folder of workbooks as one table: numbers, texts, blanks and dates."""
    orders = _holes(_table(spark, d, "orders"), "o_orderstatus", "P").drop("o_orderpriority")
    ordered = orders.repartitionByRange(_parts(orders, 4), "o_orderkey").sortWithinPartitions("o_orderkey")
    folder = scratch_dir(spark, "workbooks")
    write_workbooks(ordered, folder, "Orders 2024")
    rows = read_workbook(spark, folder, "Orders 2024", row_index=True)
    return rows.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority,"
        " row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) AS row_index FROM orders")
def workbook_ingest_unlike_files(spark, d):
    """Workbooks whose columns stand in different orders, matched by name."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    folder = scratch_dir(spark, "workbooks")
    parts = _parts(orders, 2)
    for rest, columns in enumerate([orders.columns, orders.columns[::-1]]):
        some = orders.where(F.col("o_orderkey") % 2 == rest).repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey")
        write_workbooks(some.select(*columns), f"{folder}/{rest}", "Orders 2024")
    rows = read_workbook(spark, folder, "Orders 2024", row_index=True)
    return rows.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@_query(
    """SELECT * FROM (VALUES ('benchmark', 'parquet'), ('conversations', 'parquet'), ('customer', 'parquet'),
      ('documents', 'parquet'), ('embeddings', 'parquet'), ('events', 'parquet'), ('labels', 'parquet'),
      ('lineitem', 'parquet'), ('nation', 'parquet'), ('orders', 'parquet'), ('pages', 'parquet'), ('part', 'parquet'),
      ('region', 'parquet'), ('supplier', 'parquet')) t(name, source_type)"""
)
def classified_files(spark, d):
    """The type of every table, be it one file or a folder of files."""
    files = classify_files(spark, d)
    return files.select(F.regexp_extract("path", r"([^/]+)\.parquet(?:/|$)", 1).alias("name"), "source_type").distinct()


@_query(
    f"""SELECT {_ORDERS}, row_index FROM (
      SELECT *, row_number() OVER (ORDER BY o_totalprice, row_index) AS position
      FROM {_NUMBERED_ORDERS} WHERE o_custkey >= 500 AND contains(lower(o_orderpriority), 'low')) p
    WHERE position <= 500"""
)
def explorer_page(spark, d):
    """The same through the one object a user holds, with the filters in their JSON form."""
    table = Explorer(spark, f"{d}/orders.parquet")
    filters = {
        "o_custkey": {"type": "number", "value": "500", "operator": ">="},
        "o_orderpriority": {"type": "text", "value": "LOW"},
    }
    return table.page(filters, sort_by="o_totalprice", case_insensitive=True)


@_query("SELECT * FROM part")
def read_any_table(spark, d):
    return read_table(spark, f"{d}/part.parquet")


# streams ---------------------------------------------------------------------------------


def _arriving(spark, d, name: str) -> DataFrame:
    return read_arriving(spark, f"{d}/{name}.parquet", _table(spark, d, name).schema)


def _settled(spark, result: DataFrame) -> DataFrame:
    folder = scratch_dir(spark, "live")
    query = keep_current(result, f"{folder}/result", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return latest(spark, f"{folder}/result")


@_query("""SELECT event_type AS value, count(*) AS "count" FROM events WHERE value > 5 GROUP BY 1""")
def live_counts(spark, d):
    stream = _arriving(spark, d, "events")
    return _settled(spark, live_value_counts(stream, "event_type", [Filter("value", "5", "number", ">")]))


@_query(
    """SELECT 'value' AS column_name, count(*) AS total_rows, count(value) AS non_null_count,
        count(*) - count(value) AS null_count, min(value) AS min_value, max(value) AS max_value, round(avg(value), 2) AS mean
      FROM events
    UNION ALL SELECT 'event_type', count(*), count(event_type), count(*) - count(event_type), NULL, NULL, NULL FROM events
    UNION ALL SELECT 'user_id', count(*), count(user_id), count(*) - count(user_id), min(user_id), max(user_id),
      round(avg(user_id), 2) FROM events"""
)
def live_statistics(spark, d):
    stream = _arriving(spark, d, "events")
    return _settled(spark, live_profile(stream, ["value", "event_type", "user_id"])).drop("unique_estimate")


def _live_column(name: str, kind: str, number: str = "NULL", length: str = "NULL") -> str:
    return f"""SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) AS total_rows, count({name}) AS non_null_count, count(*) - count({name}) AS null_count,
      CAST(min({number}) AS DOUBLE) AS min_value, CAST(max({number}) AS DOUBLE) AS max_value, CAST(round(avg({number}), 2) AS DOUBLE) AS mean,
      CAST(min({length}) AS BIGINT) AS min_length, CAST(max({length}) AS BIGINT) AS max_length FROM events"""


@_query(
    " UNION ALL ".join(
        [
            _live_column("event_id", "int", "event_id"),
            _live_column("user_id", "int", "user_id"),
            _live_column("event_type", "string", length="length(event_type)"),
            _live_column("value", "float", "value"),
            _live_column("props", "string", length="length(props)"),
            _live_column("ts", "datetime"),
        ]
    )
)
def live_profile_of_arrivals(spark, d):
    """All columns, from one row of sketches for each batch; quartiles and distinct counts are left to the tests."""
    events, folder = _table(spark, d, "events"), scratch_dir(spark, "live")
    arriving = scratch_dir(spark, "arriving")
    events.repartition(6, "event_id").write.parquet(arriving)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    keep_profile(stream, f"{folder}/sketches", f"{folder}/checkpoint", available_now=True).awaitTermination()
    found = current_profile(spark, f"{folder}/sketches", events.schema)
    return found.select("column_name", "data_type", "total_rows", "non_null_count", "null_count", "min_value", "max_value", "mean", "min_length", "max_length")


# driver contract -------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: one page of the filtered, sorted orders with original row numbers."""
    return flagship(_table(configure(spark), "/root/testdata/sf0.001", "orders"))


try:
    import corpus_pipeline
    from tableprobe.llm import queries as _llm
except ModuleNotFoundError as missing:
    # the subpackage and the pipeline may be left out together
    if missing.name not in ("corpus_pipeline", "tableprobe.llm", "tableprobe.llm.queries"):
        raise
else:
    _QUERIES.update(_llm.QUERIES, pipeline=corpus_pipeline.run)
    _ORACLES.update(_llm.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
