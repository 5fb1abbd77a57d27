"""What the footers of Parquet files say: rows, layout, and the bounds and nulls of every column.

Spark lists the files, tasks read the last bytes of each; no row and no page is touched. A store that only Spark's own readers reach
has no footers here, and its users fall back to a scan.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Files whose footers one task reads.
_FILES_PER_TASK = 64

FOOTERS = (
    "file string, path string, size bigint, rows bigint, row_groups int, layout string, "
    "columns array<struct<name: string, type: string, nulls: bigint, low: string, high: string>>"
)

# the functions below run inside tasks, where this package need not be installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reachable(path: str) -> bool:
    """Whether the footer of a file can be read without Spark."""
    import pyarrow as pa

    from ..sources.classify import open_input

    try:
        open_input(path).close()
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def literal_path(path: str) -> str:
    """A path for a reader that would take some characters for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def footers(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row per file: its name as a scan spells it, rows, row groups, layout (names and types as JSON) and columns.

    `low` and `high` are the bounds of a column as text, null where a row group does not tell. Fields of nested columns
    are columns with a dotted name.
    """
    from ..sources.classify import open_input

    listed = spark.read.format("binaryFile").load([literal_path(f) for f in files]).select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as stream:
                    found = read_footer(stream)
                yield pa.RecordBatch.from_pylist([row | found], schema=_arrow())

    return listed.coalesce(-(-len(files) // _FILES_PER_TASK)).mapInArrow(read, FOOTERS)


def _arrow():
    import pyarrow as pa

    text, count = pa.string(), pa.int64()
    one = pa.struct([("name", text), ("type", text), ("nulls", count), ("low", text), ("high", text)])
    fields = [("file", text), ("path", text), ("size", count), ("rows", count), ("row_groups", pa.int32()), ("layout", text), ("columns", pa.list_(one))]
    return pa.schema(fields)


def read_footer(stream) -> dict:
    """What the footer of one open file says."""
    import json

    import pyarrow.parquet as pq

    source = pq.ParquetFile(stream)
    meta = source.metadata
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    columns = []
    for c in range(meta.num_columns):
        leaf = meta.schema.column(c)
        stats = [group.column(c).statistics for group in groups]
        # a group of nulls alone has no bounds, and needs none
        bounds = [s for s in stats if s is None or not (s.has_null_count and s.null_count and s.num_values == 0)]
        told = bool(bounds) and all(s is not None and s.has_min_max for s in bounds)
        columns.append(
            {
                "name": leaf.path,
                "type": str(leaf.logical_type) if str(leaf.logical_type) != "None" else leaf.physical_type,
                "nulls": sum(s.null_count for s in stats) if all(s is not None and s.has_null_count for s in stats) else None,
                "low": bound_text(min(s.min for s in bounds)) if told else None,
                "high": bound_text(max(s.max for s in bounds)) if told else None,
            }
        )
    layout = json.dumps([[f.name, str(f.type)] for f in source.schema_arrow])
    return {"rows": meta.num_rows, "row_groups": len(groups), "layout": layout, "columns": columns}


def bound_text(value) -> str:
    if isinstance(value, bytes):
        return value.hex()
    return value.isoformat() if hasattr(value, "isoformat") else str(value)
