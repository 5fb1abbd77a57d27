"""Counts and profiles that stay current while files arrive.

There is no event time: a row counts from the moment its file is there, so there is no
watermark, and the state is one row per value (or per column). `keep_profile` keeps mergeable sketches instead: a batch
writes one row for what arrived in it, and the profile of everything is that of the merged rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import ColumnNotFoundError, TableReadError
from ..functions.text import text_or_token, text_view
from ..functions.types import column, is_floating, is_numeric
from ..operators.filters import apply_filters
from ..operators.sketches import merge, sketch
from ..operators.stats import profile_of_parts


def read_arriving(spark: SparkSession, path: str, schema: T.StructType, files: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder, present and future; `path` may also be one file."""
    path = path.rstrip("/")
    # a stream takes a plain path for a folder, a pattern for whatever it matches
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(pattern)


def live_value_counts(stream: DataFrame, name: str, filters=(), **options) -> DataFrame:
    """`value, count` over everything that has arrived and passes the filters."""
    if name not in stream.columns:
        raise ColumnNotFoundError(f"Column '{name}' not found in table")
    rows = apply_filters(stream, filters, **options)
    value = text_or_token(column(name), stream.schema[name].dataType)
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def live_profile(stream: DataFrame, columns: list[str] | None = None, filters=(), **options) -> DataFrame:
    """`column_name, total_rows, non_null_count, null_count, min_value, max_value, mean, unique_estimate`."""
    names = list(stream.columns) if columns is None else list(columns)
    rows = apply_filters(stream, filters, **options)
    entries = []
    for name in names:
        dtype, col = stream.schema[name].dataType, column(name)
        number = col.cast("double") if is_numeric(dtype) else F.lit(None).cast("double")
        nan = F.coalesce(F.isnan(number), F.lit(False)) if is_floating(dtype) else F.lit(False)
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"),
                text_view(col, dtype).alias("text"),
                F.when(~nan, number).alias("number"),
                nan.alias("nan"),
            )
        )
    values = rows.select(F.inline(F.array(*entries)))
    return values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("text").alias("non_null_count"),
        F.count_if(F.col("text").isNull()).alias("null_count"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        # the mean of a column with NaN is null, as in the statistics of a table
        F.when(~F.bool_or("nan"), F.round(F.avg("number"), 2)).alias("mean"),
        F.approx_count_distinct("text").alias("unique_estimate"),
    )


def keep_current(result: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the whole result after every batch of arrivals to ``<folder>/batch=<n>``.

    A batch that is run again after a failure replaces its own folder. With `available_now`
    the query ends when the files present have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: Batches whose sketches are merged into one row.
MERGED_BATCHES = 64


def keep_profile(
    stream: DataFrame, folder: str, checkpoint: str, columns: list[str] | None = None, filters=(), available_now: bool = False, **options
) -> StreamingQuery:
    """Sketch every batch of arrivals into ``<folder>/batch=<n>``; `current_profile` reads them.

    A batch looks at its own rows only. After every `MERGED_BATCHES` batches their rows are merged into ``<folder>/upto=<n>``, and what it is made of is
    removed once it is complete. A batch that is run again replaces its own folder, so nothing counts twice.
    """
    rows = apply_filters(stream, filters, **options)
    names = list(rows.columns) if columns is None else list(columns)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sketch(batch, names).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if (number + 1) % MERGED_BATCHES == 0 and number not in _finished(spark, folder, "upto"):
            merge(_parts(spark, folder, number), names).write.mode("overwrite").parquet(f"{folder}/upto={number}")
        last = max(_finished(spark, folder, "upto"), default=-1)
        for kind, done in (("upto", lambda n: n < last), ("batch", lambda n: n <= last)):
            for n in filter(done, _finished(spark, folder, kind)):
                _remove(spark, f"{folder}/{kind}={n}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_profile(spark: SparkSession, folder: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """The profile of everything in the complete batches, as `profile` with ``exact=False`` gives it."""
    return profile_of_parts(_parts(spark, folder), spark.createDataFrame([], schema), columns)


def _parts(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The sketches to be merged: the last merged row, and those of the batches since."""
    bases = [n for n in _finished(spark, folder, "upto") if upto is None or n < upto]
    last = max(bases, default=-1)
    since = [n for n in _finished(spark, folder, "batch") if n > last and (upto is None or n <= upto)]
    paths = [f"{folder}/upto={last}"] * (last >= 0) + [f"{folder}/batch={n}" for n in since]
    if not paths:
        raise TableReadError(f"no complete batch in {folder}")
    return spark.read.parquet(*paths)


def _finished(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers of the folders that have their success marker."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return [int(status.getPath().getParent().getName().removeprefix(f"{kind}=")) for status in found or []]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The result after the last complete batch: the last one whose folder has its success marker."""
    finished = _finished(spark, folder, "batch")
    if not finished:
        raise TableReadError(f"no complete batch in {folder}")
    return spark.read.parquet(f"{folder}/batch={max(finished)}")
