"""What kind of table a file holds."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import file_size_text
from ..operators.row_index import plain_path

# Fixed value: the first 16 bytes of every SQLite database.
SQLITE_MAGIC = b"SQLite format 3\x00"

#: Extension -> type. A database is told by its first bytes, whatever its name.
EXTENSIONS = {
    "parquet": "parquet",
    "xlsx": "excel",
    "xls": "excel",
    "csv": "csv",
    "tsv": "tsv",
}

# the small functions below run inside tasks, where this package need not be installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_input(path: str):
    """A binary stream of a file on any file system pyarrow knows, local paths included."""
    import urllib.parse

    import pyarrow.fs as fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:").replace("///", "/", 1))
    system, inner = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
    return system.open_input_file(inner)


def is_sqlite(path: str) -> bool:
    try:
        with open_input(path) as stream:
            return stream.read(len(SQLITE_MAGIC)) == SQLITE_MAGIC
    except OSError:
        return False


def _stat(batches):
    """Size and time of files that no scan reads; a store that only Spark reaches tells no time."""
    import pandas as pd

    for pdf in batches:
        times = []
        for path in pdf["path"]:
            try:
                times.append(modified_at(path))
            except (OSError, ValueError, NotImplementedError):
                times.append(None)
        yield pdf.assign(size=0, modified=pd.to_datetime(pd.Series(times, index=pdf.index, dtype="Int64"), unit="ms", utc=True))


def modified_at(path: str) -> int | None:
    """When a file was last changed, in milliseconds."""
    import urllib.parse

    import pyarrow.fs as fs

    if path.startswith("file:") or "://" not in path:
        info = fs.LocalFileSystem().get_file_info(path.removeprefix("file:").replace("///", "/", 1))
    else:
        system, inner = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
        info = system.get_file_info(inner)
    return info.mtime_ns // 1_000_000 if info.mtime_ns is not None else None


def _sniff(batches):
    for pdf in batches:
        yield pdf.assign(sqlite=[is_sqlite(p) for p in pdf["path"]])


def classify_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path, size, size_text, modified, source_type` of every file below a folder.

    The listing does not open a file; of each only the first 16 bytes are read, in the tasks.
    An unknown extension without the database magic is ``unknown``. Spark leaves files of zero
    bytes out of a scan; those of its listing that the scan lacks are added, their time read in the tasks, and go by their names.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    # the listing is on the driver in any case
    named = spark.createDataFrame([(plain_path(f),) for f in found.inputFiles()], "path string")
    empty = named.join(files.select("path"), "path", "left_anti").mapInPandas(_stat, "path string, size bigint, modified timestamp")
    files = files.unionByName(empty)
    sniffed = files.mapInPandas(_sniff, "path string, size bigint, modified timestamp, sqlite boolean")
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    by_name = F.coalesce(F.try_element_at(known, extension), F.lit("unknown"))
    return sniffed.select(
        "path",
        "size",
        file_size_text(F.col("size")).alias("size_text"),
        "modified",
        F.when(F.col("sqlite"), "sqlite").otherwise(by_name).alias("source_type"),
    )


def source_type(path: str) -> str:
    """The type of one file, decided on the driver."""
    if is_sqlite(path):
        return "sqlite"
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", "unknown")
