"""The 1-based position of every row in its unfiltered source.

Files are ordered by path. Inside a Parquet file the scan itself knows the position of a
row; inside a text file it is counted per split. Only per-file (or per-split) counts are
ever shuffled: they become running offsets that are joined back to the rows.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..errors import TableProbeError
from ..functions.types import column
from .footers import footers as footers_of, literal_path, reachable

ROW_INDEX = "row_index"

#: Largest offset table, in bytes, that is sent to every executor.
BROADCAST_BYTES = 256 * 1024 * 1024
#: Files per window when offsets are summed up.
_FILES_PER_WINDOW = 4096
#: Files a page predicate names at most.
_MAX_NAMED_FILES = 1000

_MARK = "row_number"
_FILE, _BLOCK, _SEQ, _OFFSET = "__file", "__block", "__seq", "__offset"


def _knows(df: DataFrame, field: str) -> bool:
    """Whether the frame still carries this field of its file scan."""
    try:
        return field in df.select("_metadata").schema["_metadata"].dataType.names
    except AnalysisException:
        return False


def has_row_numbers(df: DataFrame, name: str = ROW_INDEX) -> bool:
    """Whether the column of this name was made by `with_row_index`."""
    return name in df.columns and bool(df.schema[name].metadata.get(_MARK))


def is_numbered(df: DataFrame, name: str = ROW_INDEX) -> bool:
    """Whether the frame has its row numbers. A column of the table that is only called so is refused."""
    if name not in df.columns or has_row_numbers(df, name):
        return name in df.columns
    raise TableProbeError(f"the table has a column of its own called {name}: rename it")


def mark_numbered(df: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """Tell the row numbers from a column of the same name; the mark is stored with the table."""
    return df.withMetadata(name, {_MARK: True})


def plain_path(uri: str) -> str:
    """A file URI of a scan as the path Spark reads it by."""
    path = unquote(uri)
    return path.replace(":///", ":/", 1) if path.startswith("file:///") else path


def source_files(df: DataFrame) -> list[str]:
    """Paths of the files below a frame."""
    return [plain_path(uri) for uri in df.inputFiles()]


def with_row_index(
    df: DataFrame, name: str = ROW_INDEX, unfiltered: DataFrame | None = None, footers: DataFrame | None = None
) -> DataFrame:
    """Add the original row number as a bigint column.

    A Parquet frame may already be filtered: the number is still the position in its files. The rows of each file are taken from
    `footers` (see `footers`), which are read where they are not given; only in a store that Spark alone reaches are they
    counted, on `unfiltered` or on the files read again. A text frame
    is numbered as it is, so pass it before any filter. A frame that does not come straight
    from files has no position and is refused.
    """
    if is_numbered(df, name):
        return df
    if _knows(df, "row_index"):
        return mark_numbered(_parquet_index(df, name, unfiltered, footers), name)
    if _knows(df, "file_block_start"):
        return number_located(locate(df), name)
    raise TableProbeError("row positions need a table read from files; write the frame out and read it back")


def join_offsets(df: DataFrame, offsets: DataFrame, keys: list[str], max_rows: int, row_bytes: int) -> DataFrame:
    """Join a small table of offsets: broadcast within the size bound, else a shuffled join."""
    if max_rows * row_bytes <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    return df.join(offsets, keys)


def running_offsets(counts: DataFrame, splits: list[str]) -> DataFrame:
    """Rows before each file, from a (file, rows) frame, without one task holding all files.

    `splits` are sorted file paths that cut the order into ranges. Each range is summed on
    its own; the range totals, at most one per split, are summed and added back.
    """
    cuts = F.array(*[F.lit(s) for s in splits]) if splits else None
    rank = F.size(F.filter(cuts, lambda cut: cut <= F.col(_FILE))) if splits else F.lit(0)
    ranged = counts.withColumn("__range", rank)
    before = Window.partitionBy("__range").orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn(_OFFSET, F.coalesce(F.sum("rows").over(before), F.lit(0)))
    if not splits:
        return inside.drop("__range")
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("__range")
        .agg(F.sum("rows").alias("rows"))
        .select("__range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("__ahead"))
    )
    return inside.join(F.broadcast(totals), "__range").select(
        _FILE, "rows", (F.col(_OFFSET) + F.col("__ahead")).alias(_OFFSET)
    )


def _splits(files: list[str]) -> list[str]:
    """Every n-th path, in the spelling the scan uses, so that no range has too many files."""
    step = max(_FILES_PER_WINDOW, -(-len(files) // 512))
    return sorted(quote(f, safe="/:=+,@") for f in files)[step::step]


def sampled_splits(counts: DataFrame, files: int) -> list[str]:
    """Splits for `running_offsets` where the paths are only known to the frame."""
    if files <= _FILES_PER_WINDOW:
        return []
    # a fixed pseudo-random choice: the same on every evaluation
    return sorted(r[0] for r in counts.select(_FILE).orderBy(F.xxhash64(_FILE)).limit(511).collect())


def file_offsets(
    spark: SparkSession, files: list[str], unfiltered: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """(file, its rows, rows before it) of Parquet files, from their footers where these can be read."""
    if known is not None:
        counts = known.select(F.col("file").alias(_FILE), "rows")
    elif reachable(files[0]):
        counts = footers_of(spark, files).select(F.col("file").alias(_FILE), "rows")
    else:
        scan = unfiltered if unfiltered is not None else spark.read.parquet(*[literal_path(f) for f in files])
        counts = scan.groupBy(F.col("_metadata.file_path").alias(_FILE)).agg(F.count(F.lit(1)).alias("rows"))
    return running_offsets(counts, _splits(files))


def _parquet_index(df: DataFrame, name: str, unfiltered: DataFrame | None, known: DataFrame | None) -> DataFrame:
    files = source_files(df)
    if len(files) <= 1 and known is None:
        return df.withColumn(name, F.col("_metadata.row_index") + 1)
    offsets = file_offsets(df.sparkSession, files, unfiltered, known).drop("rows")
    return _add_offsets(df, name, offsets, len(files), max(map(len, files), default=0))


def _add_offsets(df: DataFrame, name: str, offsets: DataFrame, max_rows: int, path_length: int) -> DataFrame:
    """Position in the file plus the rows before the file."""
    keyed = df.withColumns({_FILE: F.col("_metadata.file_path"), name: F.col("_metadata.row_index") + 1})
    joined = join_offsets(keyed, offsets, [_FILE], max_rows, path_length + 48)
    return joined.withColumn(name, F.col(name) + F.col(_OFFSET)).drop(_FILE, _OFFSET)


def rows_between(df: DataFrame, first: int, last: int, name: str = ROW_INDEX, footers: DataFrame | None = None) -> DataFrame:
    """The rows numbered `first`..`last` of an unfiltered table, with their numbers.

    Of a folder of Parquet files only those that hold the rows are read: their footers, read here if they are not given, tell
    which, and the scan drops the others before any task starts.
    """
    numbered = None
    files = source_files(df) if not is_numbered(df, name) and _knows(df, "row_index") else []
    if len(files) > 1:
        overlap = (F.col(_OFFSET) < last) & (F.col(_OFFSET) + F.col("rows") >= first)
        offsets = file_offsets(df.sparkSession, files, None, footers).filter(overlap).select(_FILE, _OFFSET)
        hits = offsets.limit(_MAX_NAMED_FILES + 1).collect()
        if len(hits) <= _MAX_NAMED_FILES:
            known = df.sparkSession.createDataFrame(hits, f"{_FILE} string, {_OFFSET} bigint")
            chosen = df.filter(F.col("_metadata.file_path").isin([h[0] for h in hits]))
            numbered = mark_numbered(_add_offsets(chosen, name, known, len(hits), max(map(len, files))), name)
    rows = with_row_index(df, name, None, footers) if numbered is None else numbered
    return rows.filter(column(name).between(first, last))


def locate(df: DataFrame) -> DataFrame:
    """Note where each row of a text scan comes from: file, split, and order in the task."""
    return df.withColumns(
        {
            _FILE: F.col("_metadata.file_path"),
            _BLOCK: F.col("_metadata.file_block_start"),
            _SEQ: F.monotonically_increasing_id(),
        }
    )


def number_located(located: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """Number text rows by (file, split, order in the split).

    Both uses of the scan below plan the same splits, so a row gets the same sequence number
    in both; the difference to its split's first number is the position in the split.
    """
    files = source_files(located)
    blocks = located.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("rows"), F.min(_SEQ).alias("__first"))
    per_file = blocks.groupBy(_FILE).agg(F.sum("rows").alias("rows"))
    earlier = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    in_file = blocks.withColumn("__before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    starts = in_file.join(running_offsets(per_file, _splits(files)).drop("rows"), _FILE).select(
        _FILE, _BLOCK, (F.col(_OFFSET) + F.col("__before") - F.col("__first")).alias(_OFFSET)
    )
    # a file is cut into at most one split more than the scan has tasks
    splits = len(files) + located.rdd.getNumPartitions()
    joined = join_offsets(located, starts, [_FILE, _BLOCK], splits, max(map(len, files), default=0) + 56)
    numbered = joined.withColumn(name, F.col(_SEQ) + F.col(_OFFSET) + 1)
    return mark_numbered(numbered.drop(_FILE, _BLOCK, _SEQ, _OFFSET), name)
