"""Pages of the filtered and sorted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import TableProbeError
from ..functions.types import column
from .filters import compile_filters
from .ranks import Cut, can_cut, row_at, value_column
from .row_index import ROW_INDEX, rows_between, with_row_index
from .sorting import AUTO, sort_expression, sort_keys

DEFAULT_PAGE_ROWS = 500
#: From this offset on a page starts behind a row that counting found; below, every task keeps the rows before it.
DEEP_ROWS = 10_000


def page(
    df: DataFrame,
    filters=(),
    sort_by: str | None = None,
    ascending: bool = True,
    offset: int = 0,
    limit: int = DEFAULT_PAGE_ROWS,
    case_insensitive: bool = False,
    use_regex: bool = False,
    after: tuple[object, int] | None = None,
    text_numbers: str | None = AUTO,
    position: str | None = None,
    whole_table: bool = False,
    footers: DataFrame | None = None,
) -> DataFrame:
    """Rows `offset`..`offset + limit` of the filtered and sorted table, with `row_index`.

    A page is one top-k pass: every task keeps `offset + limit` rows and nothing is shuffled but
    those. From `DEEP_ROWS` on, the last row before the page is found by counting the sort column (see `ranks`; these jobs run
    at once), and the pass keeps `limit` rows behind it, however deep the page is. With `whole_table`, the promise that `df` is the table as read and not a part of it, a
    page without filter and sort is a range of row numbers and reads only the files that hold
    them. `after`, the (sort value, row_index) of the last row seen, continues
    a sorted table at any depth without an offset. `position` names a column that numbers the
    rows of the result from `offset + 1`. `footers` are those of the table's Parquet files, if they are known.
    """
    if offset < 0 or limit < 0:
        raise TableProbeError("offset and limit cannot be negative")
    compiled = compile_filters(df, filters, case_insensitive, use_regex)
    sorted_page = sort_by is not None and sort_by in df.columns
    if whole_table and not sorted_page and compiled.predicate is None and after is None:
        rows = rows_between(df, offset + 1, offset + limit, footers=footers).orderBy(column(ROW_INDEX).asc()).limit(limit)
    else:
        rows = with_row_index(df, footers=footers)
        if compiled.predicate is not None:
            rows = rows.filter(compiled.predicate)
        keys = [column(ROW_INDEX).asc()]
        if sorted_page:
            key, can_be_nan = sort_expression(df, sort_by, text_numbers)
            keys = sort_keys(key, can_be_nan, ascending)
            if after is not None:
                rows = rows.filter(_behind(key, can_be_nan, ascending, *after))
        elif after is not None:
            rows = rows.filter(column(ROW_INDEX) > after[1])
        skipped = offset
        if offset >= DEEP_ROWS and (not sorted_page or can_cut(rows.select(key).schema[0].dataType)):
            cut = row_at(rows, offset - 1, *((key, can_be_nan, ascending) if sorted_page else ()))
            skipped = 0
            rows = rows.filter(_behind_cut(cut, limit, rows, *((key, can_be_nan, ascending) if sorted_page else ())))
        rows = rows.orderBy(*keys).offset(skipped).limit(limit)
    if position is not None:
        # a limited sort has one output partition, so the id counts its rows from 0
        rows = rows.withColumn(position, F.monotonically_increasing_id() + (offset + 1))
    return rows


def _behind_cut(cut: Cut | None, limit: int, rows: DataFrame, key: Column | None = None, can_be_nan: bool = False, ascending: bool = True) -> Column:
    """At least the next `limit` rows after a place in the order, and none before; none after a place past the end."""
    if cut is None:
        return F.lit(False)
    later = column(ROW_INDEX) > cut.row_index
    if key is None:
        return later
    value = None if cut.kind == "null" else float("nan") if cut.kind == "nan" else value_column(cut.text, rows.select(key).schema[0].dataType)
    if cut.kind == "value" and cut.follow >= limit:
        # values alone fill the page, and the scan skips what lies before them
        return (key >= value if ascending else key <= value) & ((key != value) | later)
    return _behind(key, can_be_nan, ascending, value, cut.row_index)


def _behind(key: Column, can_be_nan: bool, ascending: bool, value: object, row_index: int) -> Column:
    """Rows after (value, row_index) in the order of `sort_keys`."""
    later = column(ROW_INDEX) > row_index
    if value is None:
        return key.isNull() & later
    if isinstance(value, float) and value != value:
        return key.isNull() | (F.isnan(key) & later)
    bound = value if isinstance(value, Column) else F.lit(value)
    past = key > bound if ascending else key < bound
    if can_be_nan and not ascending:
        past = past | F.isnan(key)
    return past | key.isNull() | ((key == bound) & later)


def placed_page(rows: DataFrame, offset: int, limit: int, footers: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """Rows `offset`..`offset + limit` of a table whose files hold it in the wanted order, from the files that have them."""
    if offset < 0 or limit < 0:
        raise TableProbeError("offset and limit cannot be negative")
    place = position or "__place"
    found = rows_between(rows, offset + 1, offset + limit, place, footers)
    found = found.orderBy(column(place).asc()).limit(limit)
    return found if position is not None else found.drop(place)


def page_totals(
    df: DataFrame,
    filters=(),
    offset: int = 0,
    limit: int = DEFAULT_PAGE_ROWS,
    case_insensitive: bool = False,
    use_regex: bool = False,
) -> DataFrame:
    """One row: `total_rows` that pass the filters, and whether rows follow this page."""
    predicate = compile_filters(df, filters, case_insensitive, use_regex).predicate
    rows = df if predicate is None else df.filter(predicate)
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.select(
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit).cast("bigint").alias("limit"),
        "total_rows",
        (F.least(F.lit(offset + limit).cast("bigint"), F.col("total_rows")) < F.col("total_rows")).alias("has_more"),
    )
