"""One entry point for every source, and what there is to know before reading one."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import TableReadError
from ..functions.types import column, is_integral, is_numeric, null_columns_to_string, simplify_type
from ..operators.footers import footers, literal_path, reachable
from ..operators.row_index import ROW_INDEX, mark_numbered, source_files, with_row_index
from .classify import classify_files, open_input, source_type
from .delimited import read_csv, read_tsv
from .sqlite import list_sqlite_tables, read_sqlite
from .workbook import list_sheets, read_workbook

#: Source types with more than one table per file.
TABBED = ("excel", "sqlite")


#: Layouts of files that one table may be put together from.
MAX_LAYOUTS = 200


def read_parquet(spark: SparkSession, path, row_index: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Parquet files as one table.

    Files of different layouts are matched by column name: a column that a file lacks is null there, numbers of several types take the
    wider one, and a column of the null type takes that of the other files, or is text. Other types that differ are refused. A
    nanosecond timestamp is cut to microseconds, which needs the session settings of `configure`. `known` are the footers of
    the files, where they were read before.
    """
    paths = [path] if isinstance(path, str) else list(path)
    try:
        raw = spark.read.parquet(*paths)
        files = sorted(source_files(raw))
        if len(files) <= 1 or not reachable(files[0]):
            if len(files) > 1:
                raw = spark.read.option("mergeSchema", "true").parquet(*paths)
            return _one_layout(raw, files, row_index, None)
        known = footers(spark, files) if known is None else known
        # a row per layout
        layouts = known.groupBy("layout").agg(F.min("path").alias("first")).orderBy("first").limit(MAX_LAYOUTS + 1).collect()
        if len(layouts) > MAX_LAYOUTS:
            raise TableReadError(f"Cannot read parquet files: more than {MAX_LAYOUTS} different layouts")
        if len(layouts) == 1:
            return _one_layout(raw, files, row_index, known)
        return _merged_layouts(spark, paths, raw, known, layouts, row_index)
    except PySparkException as error:
        raise TableReadError(f"Cannot read parquet file: {error}") from error


def _one_layout(raw: DataFrame, files: list[str], row_index: bool, known: DataFrame | None) -> DataFrame:
    df = with_row_index(raw, unfiltered=raw, footers=known) if row_index else raw
    return null_columns_to_string(df.withColumns(_footer_casts(raw, files)))


def _merged_layouts(
    spark: SparkSession, paths: list[str], raw: DataFrame, known: DataFrame, layouts: list, row_index: bool
) -> DataFrame:
    """Files of several layouts by column name."""
    parts = [spark.read.parquet(literal_path(layout.first)) for layout in layouts]
    casts = [_footer_casts(part, [layout.first]) for part, layout in zip(parts, layouts)]
    fields: dict[str, T.DataType | None] = {}
    holder: dict[str, str] = {}
    same = not any(casts)
    for part, cast, layout in zip(parts, casts, layouts):
        voids = {name for name, kind in json.loads(layout.layout) if kind == "null"}
        for field in part.withColumns(cast).schema:
            name, dtype = field.name, None if field.name in voids else field.dataType
            if name not in fields or fields[name] is None:
                fields[name], holder[name] = dtype, layout.first
            elif dtype is not None and dtype != fields[name]:
                same = False
                fields[name] = _wider(spark, fields[name], dtype, name, holder[name], layout.first)
    if same:
        # one scan; what a file lacks is null
        schema = T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])
        df = spark.read.schema(schema).parquet(*paths)
        return with_row_index(df, footers=known) if row_index else df
    # files whose types have to be mended are scanned apart, in the order of the layouts
    mended = []
    # columns that stand in the names of the folders
    named = [name for name in raw.columns if name not in fields]
    base = {"basePath": re.sub(r"\\(.)", r"\1", paths[0])} if named and len(paths) == 1 else {}
    for part, cast, layout in zip(parts, casts, layouts):
        own = [literal_path(r.path) for r in known.filter(F.col("layout") == layout.layout).select("path").collect()]
        df = spark.read.options(**base).schema(part.schema).parquet(*own)
        numbered = with_row_index(df, footers=known) if row_index else df
        df = numbered.withColumns(cast)
        df = df.withColumns({name: column(name).cast(dtype or "string") for name, dtype in fields.items() if name in part.columns and dtype != df.schema[name].dataType})
        mended.append(df)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mended)
    whole = whole.select(*[column(name) for name in [*fields, *named, *([ROW_INDEX] if row_index else [])]])
    return mark_numbered(whole) if row_index else whole


def _wider(spark: SparkSession, a: T.DataType, b: T.DataType, name: str, first: str, other: str) -> T.DataType:
    """The type that holds numbers of both."""
    if not (is_numeric(a) and is_numeric(b)):
        raise TableReadError(f"Cannot read parquet files: {name} is {a.simpleString()} in {first} and {b.simpleString()} in {other}")
    nothing = spark.range(0)
    return nothing.select(F.lit(None).cast(a).alias("v")).union(nothing.select(F.lit(None).cast(b))).schema["v"].dataType


def _footer_casts(raw: DataFrame, files: list[str]) -> dict[str, Column]:
    """Casts for the columns whose type in the first file is not the one Spark reads."""
    try:
        with open_input(files[0]) as stream:
            fields = pq.read_schema(stream)
    except (IndexError, OSError, ValueError):  # no file, or not one of this file system's
        return {}
    casts = {}
    for field in fields:
        if field.name not in raw.columns:
            continue
        col = column(field.name)
        if pa.types.is_null(field.type):
            casts[field.name] = col.cast("string")
        elif pa.types.is_timestamp(field.type) and field.type.unit == "ns" and is_integral(raw.schema[field.name].dataType):
            quoted = field.name.replace("`", "``")
            moment = F.timestamp_micros(F.expr(f"(`{quoted}` - pmod(`{quoted}`, 1000)) div 1000"))
            casts[field.name] = moment if field.type.tz else moment.cast("timestamp_ntz")
    return casts


def parquet_catalogue(spark: SparkSession, path) -> DataFrame:
    """What the footers below a path say, a row per file: `file, path, size, rows, row_groups, layout, columns`."""
    try:
        files = source_files(spark.read.parquet(*([path] if isinstance(path, str) else path)))
    except PySparkException as error:
        raise TableReadError(f"Cannot read parquet file: {error}") from error
    if not files or not reachable(files[0]):
        raise TableReadError("Cannot read the footers of this store")
    return footers(spark, files)


def read_table(
    spark: SparkSession, path: str, table: str | None = None, kind: str | None = None, row_index: bool = False
) -> DataFrame:
    """Read a file, or a folder of files of one type, as a table.

    `table` is a worksheet or a database table and is ignored elsewhere. `kind` is needed for
    a folder whose name does not end in an extension; a file is recognised by its content or
    name.
    """
    kind = kind or source_type(path)
    try:
        if kind == "parquet":
            return read_parquet(spark, path, row_index)
        if kind == "csv":
            return read_csv(spark, path, row_index=row_index)
        if kind == "tsv":
            return read_tsv(spark, path, row_index=row_index)
        if kind == "sqlite":
            return read_sqlite(spark, path, table, row_index)
        if kind == "excel":
            return read_workbook(spark, path, table, row_index)
    except PySparkException as error:
        raise TableReadError(f"Cannot read {kind} file: {error}") from error
    raise TableReadError(f"Unsupported file type: {kind}")


def list_tables(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """`path, position, name` of the worksheets or database tables below a path."""
    kind = kind or source_type(path)
    if kind == "excel":
        return list_sheets(spark, path)
    files = classify_files(spark, path).filter(F.col("source_type") == "sqlite")
    return list_sqlite_tables(files)


def column_metadata(df: DataFrame, size_bytes: int | None = None, source: str | None = None) -> DataFrame:
    """`position, name, type, total_rows, file_size, source_type`, one row per column.

    The rows are counted without reading a column; for Parquet that is the footers.
    """
    names = [(i, f.name, simplify_type(f.dataType)) for i, f in enumerate(df.schema.fields, 1)]
    listed = df.sparkSession.createDataFrame(names, "position int, name string, type string")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return listed.select(
        "*",
        total.alias("total_rows"),
        F.lit(size_bytes).cast("bigint").alias("file_size"),
        F.lit(source).cast("string").alias("source_type"),
    )


def table_metadata(spark: SparkSession, path: str, table: str | None = None, kind: str | None = None) -> DataFrame:
    """`column_metadata` of a source, with the size of its files and its type."""
    kind = kind or source_type(path)
    df = read_table(spark, path, table, kind)
    size = classify_files(spark, path).agg(F.sum("size")).first()[0]
    return column_metadata(df, size, kind)
