"""From spreadsheet cells to a typed table.

Cells come as whole rows, the way a workbook is decoded, or as a long table of single cells.
Row 1 of the first sheet names the columns, whatever it holds. Rows behind the last one with
a value are not there, blank rows between are; short rows are filled with nulls.
Missing-value markers and error values are nulls, and every column gets its type from all its
values. Sheets of several paths are stacked in the order of the paths; their cells are matched by column name, in
any order, and a sheet that does not have the columns of the first is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import TableReadError
from ..functions.types import column
from ..operators.row_index import ROW_INDEX, join_offsets, mark_numbered, running_offsets, sampled_splits
from .headers import header_names
from .kinds import kind_types, typed_cell, without_markers


def rows_to_table(rows: DataFrame, row_index: bool = False) -> DataFrame:
    """Rows `path, row, cells`, where `cells` is an array of (kind, text) by column.

    The rows of each path are complete from 1 to the last one with a value. Nothing is
    shuffled but one row per path and one per column and kind.
    """
    sheets = rows.groupBy("path").agg(F.max("row").alias("last"), F.max(F.size("cells")).alias("width"))
    shape = _shape(sheets)
    if not shape.width:
        return rows.sparkSession.createDataFrame([], T.StructType([]))
    headers = sheets.join(rows.filter("row = 1").select("path", F.col("cells.text").alias("header")), "path", "left")
    names, places = _columns(headers, shape)
    body = rows.filter("row > 1")
    if places is not None:
        ordered = F.transform("places", lambda place: F.get("cells", place))
        body = body.join(places, "path").withColumn("cells", ordered).drop("places")
    cells = body.select(F.posexplode("cells").alias("i", "cell"))
    types = kind_types(cells.withColumn("cell", without_markers(F.col("cell"), sheet=True)), shape.width)
    values = [F.get("cells", F.lit(i)) for i in range(shape.width)]
    return _table(body, values, names, types, sheets, shape, row_index)


def grid_to_table(cells: DataFrame, row_index: bool = False) -> DataFrame:
    """A long table `path, row, col, kind, text` of the cells that hold something.

    `row` and `col` count from 1. The cells of a row, at most the columns of a worksheet, are
    brought together by one shuffle.
    """
    cells = cells.filter(F.col("kind").isNotNull())
    below_header = F.when(F.col("row") > 1, F.col("row"))
    sheets = cells.groupBy("path").agg(
        F.max("row").alias("last"), F.max("col").alias("width"), F.count_distinct(below_header).alias("filled")
    )
    shape = _shape(sheets, F.max((F.col("last") - 1 > F.col("filled")).cast("int")).alias("gaps"))
    if not shape.width:
        return cells.sparkSession.createDataFrame([], T.StructType([]))
    head = cells.filter("row = 1").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("texts"))
    texts = F.transform(F.sequence(F.lit(1), F.col("width").cast("int")), lambda c: F.element_at("texts", c.cast(cells.schema["col"].dataType)))
    names, places = _columns(sheets.join(head, "path", "left").withColumn("header", texts), shape)
    if places is not None:
        moved = places.select("path", F.posexplode("places").alias("to", "place"))
        moved = moved.select("path", (F.col("to") + 1).alias("to"), (F.col("place") + 1).alias("col"))
        cells = cells.join(moved, ["path", "col"]).withColumn("col", F.col("to")).drop("to")
    body = cells.filter("row > 1").select("path", "row", "col", F.struct("kind", "text").alias("cell"))
    marked = body.select((F.col("col") - 1).alias("i"), without_markers(F.col("cell"), sheet=True).alias("cell"))
    types = kind_types(marked, shape.width)
    columns = list(range(1, shape.width + 1))
    rows = body.groupBy("path", "row").pivot("col", columns).agg(F.first("cell"))
    if shape.gaps:
        every = sheets.filter("last > 1").select(
            "path", F.explode(F.sequence(F.lit(2).cast("bigint"), "last")).alias("row")
        )
        rows = every.join(rows, ["path", "row"], "left")
    return _table(rows, [F.col(f"`{c}`") for c in columns], names, types, sheets, shape, row_index)


def _columns(headers: DataFrame, shape) -> tuple[list[str], DataFrame | None]:
    """The names of the columns, and by path where each is, if not all sheets have the order of the first.

    `headers`: `path` and `header`, the texts of row 1. They are compared in Spark; those of two sheets at most reach the driver.
    """
    width = shape.width
    named = headers.select("path", F.coalesce("header", F.array().cast("array<string>")).alias("header"))
    first = named.filter(F.col("path") == shape["first"]).first()
    names = header_names(first.header, width)

    @F.udf("array<int>")
    def places_of(texts):
        own = {name: i for i, name in enumerate(header_names(list(texts), width))}
        return [own[name] for name in names] if own.keys() == set(names) else None

    placed = named.withColumn("places", places_of("header"))
    other = placed.filter("places IS NULL").orderBy("path").first()
    if other:
        raise TableReadError(f"{other.path} has the columns {header_names(other.header, width)}, {first.path} has {names}")
    if placed.filter(F.col("places") != F.array(*map(F.lit, range(width)))).limit(1).count() == 0:
        return names, None
    return names, placed.select("path", "places")


def _shape(sheets: DataFrame, *more: Column):
    """What all sheets have in common, as one row."""
    return sheets.agg(
        F.max("width").alias("width"),
        F.min("path").alias("first"),
        F.count("path").alias("sheets"),
        F.max(F.length("path")).alias("path_length"),
        *more,
    ).first()


def _table(rows, values: list[Column], names: list[str], types: list[str], sheets, shape, row_index: bool) -> DataFrame:
    position = []
    if row_index and ROW_INDEX in names:
        raise TableReadError(f"the table has a column of its own called {ROW_INDEX}: read it without row numbers")
    if row_index and shape.sheets == 1:
        position = [(F.col("row") - 1).alias(ROW_INDEX)]
    elif row_index:
        counts = sheets.select(F.col("path").alias("__file"), (F.col("last") - 1).alias("rows"))
        starts = running_offsets(counts, sampled_splits(counts, shape.sheets)).select(F.col("__file").alias("path"), "__offset")
        rows = join_offsets(rows, starts, ["path"], shape.sheets, shape.path_length + 32)
        position = [(F.col("row") - 1 + F.col("__offset")).alias(ROW_INDEX)]
    typed = [typed_cell(without_markers(v, sheet=True), t).alias(n) for v, n, t in zip(values, names, types)]
    table = rows.select(*typed, *position)
    return mark_numbered(table) if row_index else table


def table_to_grid(df: DataFrame, row: str, kinds: dict[str, str], path: str = "") -> DataFrame:
    """The cells of a table under a header row: what `grid_to_table` reads back.

    `row` is a column with the row number from 1, `kinds` maps each column to its cell kind.
    """
    names = list(kinds)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("col"), F.lit(kinds[n]).alias("kind"), column(n).cast("string").alias("text"))
            for c, n in enumerate(names, 1)
        ]
    )
    body = df.select((column(row) + 1).alias("row"), F.inline(cells)).filter("text is not null")
    head = df.sparkSession.createDataFrame(
        [(1, c, "text", n) for c, n in enumerate(names, 1)], "row bigint, col int, kind string, text string"
    )
    return body.unionByName(head).select(F.lit(path).alias("path"), "row", "col", "kind", "text")
