"""A table as its reader sees it: look, page, filter, sort, describe, export."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ColumnNotFoundError, TableProbeError, TableReadError
from ..functions.text import truncate_text
from ..functions.types import column, is_string
from ..functions.wire import row_json, wire_view
from ..operators.filters import Filter, filters_from_request, parse_filter_entry
from ..operators.paging import DEFAULT_PAGE_ROWS, page, page_totals, placed_page
from ..operators.row_index import ROW_INDEX, with_row_index
from ..operators.sorting import sort_table
from ..operators.stats import column_stats, profile
from ..operators.value_counts import DEFAULT_VALUES, value_counts
from ..session import scratch_dir
from ..sources.classify import source_type
from ..sources.tables import TABBED, list_tables, parquet_catalogue, read_parquet, read_table, table_metadata
from .export import export, output_name

#: Rows of one file of a sorted copy, at most.
SORTED_FILE_ROWS = 1_000_000


class Explorer:
    """One table of one source.

    The table is read lazily; its column types are settled once. `filters` everywhere are
    `Filter` objects, or the JSON form ``{column: {type, value, operator, valueList}}``.
    """

    def __init__(self, spark: SparkSession, path: str, table: str | None = None, kind: str | None = None):
        self.spark, self.path, self.table = spark, path, table
        self._footers: DataFrame | None = None
        #: sorted copies and their footers, by column and direction
        self._orders: dict[tuple[str, bool], tuple[DataFrame, DataFrame | None]] = {}
        self.kind = kind or source_type(path)
        if self.kind in TABBED:
            #: the table with its row numbers
            self.rows = read_table(spark, path, table, self.kind, row_index=True)
            #: the table without them
            self.df = self.rows.drop(ROW_INDEX)
            self._pages = self.rows
        else:
            # statistics need no row numbers, and a plain page finds its files itself
            self._footers = self._read_footers() if self.kind == "parquet" else None
            if self._footers is not None:
                self.df = self._pages = read_parquet(spark, path, known=self._footers)
            else:
                self.df = self._pages = read_table(spark, path, table, self.kind)
            try:
                self.rows = with_row_index(self.df, unfiltered=self.df, footers=self._footers)
            except TableProbeError:  # files of different encodings are scanned apart
                self.rows = self._pages = read_table(spark, path, table, self.kind, row_index=True)

    def _read_footers(self, path: str | None = None) -> DataFrame | None:
        """The footers of a folder's files, read once; of one file they are at hand, and some stores don't show them."""
        path = path or self.path
        try:
            found = parquet_catalogue(self.spark, path)
        except TableReadError:
            return None
        if len(self.spark.read.parquet(path).inputFiles()) <= 1:
            return None
        folder = scratch_dir(self.spark, "footers")
        found.write.parquet(folder)
        return self.spark.read.schema(found.schema).parquet(folder)

    def catalogue(self) -> DataFrame:
        """What the footers of a Parquet table say, a row per file."""
        return parquet_catalogue(self.spark, self.path) if self._footers is None else self._footers

    def refresh(self) -> "Explorer":
        """The same table, read again after its source has changed."""
        return Explorer(self.spark, self.path, self.table, self.kind)

    def stage(self, folder: str | None = None, sort_by: str | None = None, ascending: bool = True) -> "Explorer":
        """The same table from a Parquet copy with its row numbers, in the shared scratch folder by default.

        Worth its one pass where a source that is costly to decode is looked at repeatedly. With `sort_by` the copy is a second one, in
        that order, and serves the pages sorted so: it is dealt by ranges and sorted once, its footers tell the place of every file in the
        order, and a page at any depth opens the one or two files of at most `SORTED_FILE_ROWS` rows that hold it.
        """
        folder = folder or scratch_dir(self.spark, "table")
        if sort_by is not None:
            return self._sorted_stage(folder, sort_by, ascending)
        self.rows.write.mode("errorifexists").parquet(folder)
        staged = copy(self)
        staged._footers = None
        staged.rows = staged._pages = self.spark.read.parquet(folder)
        staged.df = staged.rows.drop(ROW_INDEX)
        return staged

    def _sorted_stage(self, folder: str, sort_by: str, ascending: bool) -> "Explorer":
        if sort_by not in self.df.columns:
            raise ColumnNotFoundError(f"no column {sort_by}")
        ordered = sort_table(self.rows, sort_by, ascending)
        # files are written in the order of the ranges, and named so
        ordered.write.mode("errorifexists").option("maxRecordsPerFile", SORTED_FILE_ROWS).parquet(folder)
        rows = self.spark.read.schema(ordered.schema).parquet(folder)
        known = self._read_footers(folder)
        staged = copy(self)
        staged._orders = {**self._orders, (sort_by, ascending): (rows, known)}
        return staged

    def tables(self) -> DataFrame:
        """The worksheets or database tables next to this one; none for other sources."""
        if self.kind in TABBED:
            return list_tables(self.spark, self.path, self.kind)
        return self.spark.createDataFrame([], "path string, position bigint, name string")

    def metadata(self) -> DataFrame:
        return table_metadata(self.spark, self.path, self.table, self.kind)

    def filter_entry(self, name: str, entry: str) -> Filter | None:
        """What a user typed above a column, as a filter."""
        return parse_filter_entry(name, entry, self.rows.schema[name].dataType)

    def page(
        self,
        filters=(),
        sort_by: str | None = None,
        ascending: bool = True,
        offset: int = 0,
        limit: int = DEFAULT_PAGE_ROWS,
        max_cell_chars: int = 0,
        wide_as_text: bool = False,
        **options,
    ) -> DataFrame:
        """One page in wire form with `row_index`; long texts cut at `max_cell_chars`.

        With `wide_as_text` integers past 2**53 are text, as in `page_json`; see `wire_view`.
        """
        rows = self._page(_filters(filters), sort_by, ascending, offset, limit, **options)
        shown = wire_view(rows, wide_as_text)
        if max_cell_chars:
            texts = [f.name for f in shown.schema.fields if is_string(f.dataType)]
            shown = shown.withColumns({n: truncate_text(column(n), max_cell_chars) for n in texts})
        return shown

    def page_json(self, *args, **options) -> DataFrame:
        """One page as `row_index, json`, each row a JSON object."""
        filters = options.pop("filters", args[0] if args else ())
        rows = self._page(_filters(filters), *args[1:], **options)
        return rows.select(F.col(ROW_INDEX), row_json(rows).alias("json"))

    def _page(self, filters, sort_by=None, ascending=True, offset=0, limit=DEFAULT_PAGE_ROWS, after=None, position=None, **options) -> DataFrame:
        if (sort_by, ascending) in self._orders and not filters and after is None:
            rows, known = self._orders[sort_by, ascending]
            return placed_page(rows, offset, limit, known, position)
        return page(
            self._pages, filters, sort_by, ascending, offset, limit, after=after, position=position, whole_table=True, footers=self._footers, **options
        )

    def totals(self, filters=(), offset: int = 0, limit: int = DEFAULT_PAGE_ROWS, **options) -> DataFrame:
        return page_totals(self.df, _filters(filters), offset, limit, **options)

    def column_stats(self, name: str, exact: bool = True) -> DataFrame:
        return column_stats(self.df, name, exact)

    def profile(self, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
        return profile(self.df, columns, exact)

    def unique_values(self, name: str, limit: int = DEFAULT_VALUES, **options) -> DataFrame:
        return value_counts(self.rows, name, limit, **options)

    def export(self, folder: str, fmt: str = "original", filters=(), **options) -> str:
        """Write the filtered, sorted table below `folder` under its usual name."""
        wanted = _filters(filters)
        source_name = self.path.rstrip("/").rsplit("/", 1)[-1]
        name = output_name(source_name, fmt, self.table, bool(wanted))
        return export(self.rows, f"{folder}/{name}", fmt, self.kind, wanted, keep_row_index=False, **options)


def _filters(filters) -> list[Filter]:
    return filters_from_request(filters) if isinstance(filters, dict) else list(filters)
