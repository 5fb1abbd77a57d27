"""Comma- and tab-separated text.

Types come from every row, never from a sample: one pass finds the encoding, the header of
every file and whether a record of it spans lines, one decides the types, and the returned
frame is a plain scan with casts. Types can be given, which spares their pass.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import TableReadError
from ..functions.types import column
from ..operators.row_index import ROW_INDEX, locate, number_located, plain_path, source_files
from .headers import header_names
from .inference import cast_text, infer_types, mark_missing
from .records import BLOCK, FILE, SEQ, can_split, spanning_records

#: Holds the whole record where a row has more or fewer fields than the header.
_RAGGED = "__ragged__"


class _Layout(NamedTuple):
    """What files have in common that one scan reads."""

    names: tuple[str, ...]
    encoding: str
    multi_line: bool


def read_csv(spark: SparkSession, path, **options) -> DataFrame:
    """Comma-separated files with a header row. See `read_delimited`."""
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path, **options) -> DataFrame:
    """Tab-separated files with a header row. See `read_delimited`."""
    return read_delimited(spark, path, "\t", **options)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str,
    encoding: str | None = None,
    multi_line: bool | None = None,
    types: dict[str, str] | None = None,
    row_index: bool = False,
) -> DataFrame:
    """Read delimited files as one table with whole-file type inference.

    Columns are matched by name: a file may have them in another order than the first file by
    path, but files that do not have the same columns are refused. A file that is not UTF-8
    throughout is read as Latin-1. Files are split, those with line breaks inside quoted fields
    too (see `records`), unless a line ends in a carriage return alone. Blank lines are no rows. A row with more fields than the header, blank or not, is an error; missing
    fields are null. `types` (name to Spark type) spares the inference. With `row_index` the
    original row number is added.
    """
    paths = [path] if isinstance(path, str) else list(path)
    options = {"sep": delimiter, "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
    layouts = _layouts(spark, paths, options, encoding, multi_line)
    names = next(iter(layouts)).names
    if row_index and ROW_INDEX in names:
        raise TableReadError(f"the table has a column of its own called {ROW_INDEX}: read it without row numbers")
    parts = []
    for layout, files in layouts.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*layout.names, _RAGGED]])
        if layout.multi_line and can_split(spark, files):
            rows = _spanning_rows(spark, files, layout, schema, options, row_index)
        else:
            reader = spark.read.options(header=True, encoding=layout.encoding, multiLine=layout.multi_line, **options)
            rows = reader.options(columnNameOfCorruptRecord=_RAGGED, columnPruning=False).schema(schema).csv(files if len(layouts) > 1 else paths)
            rows = locate(rows) if row_index else rows
        parts.append(_refuse_extra_fields(rows, layout.names, options))
    marked = mark_missing(reduce(DataFrame.unionByName, parts), list(names))
    try:
        typed = cast_text(marked, infer_types(marked, list(names)) if types is None else types)
    except PySparkException as error:
        raise TableReadError(f"cannot read {paths}: {error}") from error
    return number_located(typed) if row_index else typed


def _spanning_rows(spark: SparkSession, files: list[str], layout: _Layout, schema: T.StructType, options: dict, row_index: bool) -> DataFrame:
    """Rows of files with records that span lines."""
    records = spanning_records(spark, files, layout.encoding, options["sep"])
    parser = {**options, "multiLine": "true", "columnNameOfCorruptRecord": _RAGGED}
    place = [FILE, BLOCK, SEQ] if row_index else []
    return records.select(F.from_csv("record", schema.json(), parser).alias("r"), *place).select("r.*", *place)


def _layouts(
    spark: SparkSession, paths: list[str], options: dict, encoding: str | None, multi_line: bool | None
) -> dict[_Layout, list[str]]:
    """The files of each layout, that of the first file first: one pass over the lines.

    Files without a line have no rows either and are left out.
    """
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        place.alias("place"),
        "value",
        F.lit(True).alias("utf8") if encoding else F.is_valid_utf8("value").alias("utf8"),
        F.lit(False).alias("spans") if multi_line is not None else _open_quote("value", options["sep"]).alias("spans"),
    )
    # sets of flags are aggregated by hash; beside mere flags the text of `first` would have every task sort its lines by file
    per_file = lines.filter(F.trim("value") != "").groupBy("file").agg(
        F.min_by("value", "place").alias("first"), F.collect_set("utf8").alias("utf8"), F.collect_set("spans").alias("spans")
    )
    per_file = per_file.withColumns({"utf8": ~F.array_contains("utf8", F.lit(False)), "spans": F.array_contains("spans", F.lit(True))})
    # a first line that is only part of the header says nothing about other files
    alone = F.when(_open_quote("first", options["sep"]), F.col("file"))
    alike = per_file.groupBy("first", "utf8", "spans", alone.alias("alone")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    found = sorted((sorted(map(plain_path, r.files)), r.utf8, r.spans) for r in alike.select("files", "utf8", "spans").collect())
    if not found:
        raise TableReadError(f"no file with a header at {paths}")
    layouts: dict[_Layout, list[str]] = {}
    for files, utf8, spans in found:
        used = encoding or ("UTF-8" if utf8 else "ISO-8859-1")
        broken = spans if multi_line is None else multi_line
        names = _header(spark, files[0], options | {"multiLine": broken}, used)
        layouts.setdefault(_Layout(tuple(names), used, broken), []).extend(files)
    first = found[0][0][0]
    names = next(iter(layouts)).names
    for layout, files in layouts.items():
        if set(layout.names) != set(names):
            raise TableReadError(f"{files[0]} has the columns {list(layout.names)}, {first} has {list(names)}")
    return layouts


def _open_quote(line: str, delimiter: str) -> Column:
    """Whether a quote opens a field of a line that does not close in it.

    A quote inside an unquoted field, such as an inch mark, opens nothing.
    """
    start = rf"(^|\Q{delimiter}\E)"
    closed = rf'{start}"[^"]*+(?:""[^"]*+)*+"(?=\Q{delimiter}\E|$)'
    return F.contains(line, F.lit('"')) & F.regexp_replace(line, closed, "$1").rlike(rf'{start}"')


def _header(spark: SparkSession, file: str, options: dict, encoding: str) -> list[str]:
    first = spark.read.options(header=False, encoding=encoding, **options).csv(file).head(1)
    if not first:
        raise TableReadError(f"{file} is empty")
    cells = list(first[0])
    if any(c and "\x00" in c for c in cells):
        raise TableReadError(f"{file} has zero bytes in its header: it is not UTF-8 or Latin-1 text")
    if cells[0]:
        cells[0] = cells[0].lstrip("\ufeff")
    if cells[-1]:
        # left over where a line feed inside a quoted name was taken for the end of lines
        cells[-1] = cells[-1].rstrip("\r")
    names = header_names(cells)
    folded = {n.lower() for n in names}
    if len(folded) < len(names) and spark.conf.get("spark.sql.caseSensitive") != "true":
        raise TableReadError("column names differ only by case: set spark.sql.caseSensitive to true")
    return names


def _refuse_extra_fields(raw: DataFrame, names: tuple[str, ...], options: dict) -> DataFrame:
    """The rows without `_RAGGED`; a row that is too wide fails the scan, not a pass of its own.

    Only ragged rows are looked at: one more field is put behind the record, and where that
    does not show among the header's columns, the row already had them all. The digest of a
    record cannot occur in the record.
    """
    record = F.regexp_replace(column(_RAGGED), r"[\r\n]+$", "")
    digest = F.sha2(record, 256)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv(F.concat(record, F.lit(options["sep"]), digest), schema, options)
    short = F.contains(parsed.cast("string"), digest)
    # Spark refuses to read a record's text without any of its fields
    message = F.concat(
        F.lit(f"a row has more than the header's {len(names)} fields: "), record, F.left(F.coalesce(column(names[0]), F.lit("")), F.lit(0))
    )
    fits = F.when(column(_RAGGED).isNull(), True).when(short, True).otherwise(F.raise_error(message))
    return raw.filter(fits).drop(_RAGGED)
