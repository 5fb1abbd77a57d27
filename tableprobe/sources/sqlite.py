"""Tables of SQLite databases, many files as one table.

Registered as the Spark data source ``sqlite_table``. Files are cut into row-id ranges, each
read by one task, read-only. A blob never leaves its file: the query asks for its length only.
Every value arrives with its own storage class; `read_sqlite` settles the column types.
"""

from __future__ import annotations

import sqlite3
import sys
from contextlib import closing
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import TableReadError
from ..operators.row_index import ROW_INDEX, join_offsets, mark_numbered, running_offsets
from .classify import is_sqlite, open_input
from .kinds import CELL, cast_cells, cell_types

#: Bytes of a database file that one task reads.
SLICE_BYTES = 128 * 1024 * 1024
_BATCH_ROWS = 8192
_FILE, _SLICE, _POSITION = "__file", "__slice", "__position"

_TABLES = r"SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\_%' ESCAPE '\' ORDER BY name"

# Tables with their columns; of the latter, hidden = 1 marks those of virtual tables that cannot be read.
_LAYOUT = r"""SELECT m.name, x.name FROM sqlite_master m LEFT JOIN pragma_table_xinfo(m.name) x ON x.hidden <> 1
  WHERE m.type = 'table' AND m.name NOT LIKE 'sqlite\_%' ESCAPE '\' AND (:wanted IS NULL OR m.name = :wanted) ORDER BY m.name, x.cid"""

# the source below is pickled into tasks, where this package need not be installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _connect(path: str) -> sqlite3.Connection:
    """A read-only connection: to the file itself, or to a copy in memory of a remote one."""
    from urllib.parse import quote

    if path.startswith("file:") or "://" not in path:
        local = path.removeprefix("file:").replace("///", "/", 1)
        return sqlite3.connect(f"file:{quote(local)}?mode=ro", uri=True)
    connection = sqlite3.connect(":memory:")
    with open_input(path) as stream:
        connection.deserialize(stream.read())
    connection.execute("PRAGMA query_only = on")
    return connection


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _tables(path: str) -> list[str]:
    with closing(_connect(path)) as connection:
        return [name for (name,) in connection.execute(_TABLES)]


def _columns(path: str, table: str | None) -> tuple[str, list[str]]:
    """The table (the first one by default) and its columns, generated ones included."""
    with closing(_connect(path)) as connection:
        found = connection.execute(_LAYOUT, {"wanted": table}).fetchall()
    if not found:
        raise ValueError(f"{path} has no table{'' if table is None else ' ' + table}")
    chosen = found[0][0]
    columns = [column for name, column in found if name == chosen and column is not None]
    if not columns:
        raise ValueError(f"{path}: nothing to read in table {chosen}")
    return chosen, columns


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of every database below a folder, by path."""
    import urllib.parse

    import pyarrow.fs as fs

    prefix = ""
    if path.startswith("file:") or "://" not in path:
        system, inner = fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    else:
        prefix = path.split("://", 1)[0] + "://"
        system, inner = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"File not found: {path}")
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [(prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted((p, n) for p, n in files if is_sqlite(p))


@dataclass
class _Slice(InputPartition):
    path: str
    number: int
    slices: int


class SqliteTableSource(DataSource):
    """Options: `path` of a file or folder, `table` (default: the first one by name).

    With ``counts=true`` there is one row per row-id range, with its number of rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _listing(self) -> list[tuple[str, int]]:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"No SQLite database at {self.options['path']}")
        return files

    def schema(self) -> T.StructType:
        place = [T.StructField(_FILE, T.StringType()), T.StructField(_SLICE, T.LongType())]
        if self.options.get("counts") == "true":
            return T.StructType([*place, T.StructField("rows", T.LongType())])
        _, columns = _columns(self._listing()[0][0], self.options.get("table"))
        cells = [T.StructField(c, CELL) for c in columns]
        return T.StructType([*cells, *place, T.StructField(_POSITION, T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        counts = self.options.get("counts") == "true"
        return SqliteTableReader(self._listing(), self.options.get("table"), schema, counts)


class SqliteTableReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], table: str | None, schema: T.StructType, counts: bool):
        self.files, self.table, self.schema, self.counts = files, table, schema, counts

    def partitions(self) -> list[_Slice]:
        out = []
        for path, size in self.files:
            slices = max(1, -(-size // SLICE_BYTES))
            out += [_Slice(path, n, slices) for n in range(slices)]
        return out

    def read(self, partition: _Slice):
        """Arrow batches of one row-id range, in row order."""
        import pyarrow as pa

        table, columns = _columns(partition.path, self.table)
        surplus = [] if self.counts else [c for c in columns if c not in self.schema.names]
        if surplus:
            raise ValueError(f"{partition.path}: table {table} has columns that the first database does not have: {', '.join(surplus)}")
        if self.counts:
            with closing(_connect(partition.path)) as connection:
                (rows,) = connection.execute(*self._query(connection, table, "count(*)", partition, ordered=False)).fetchone()
            yield pa.RecordBatch.from_pylist([{_FILE: partition.path, _SLICE: partition.number, "rows": rows}])
            return
        wanted = [f.name for f in self.schema.fields[:-3]]
        missing = set(wanted) - set(columns)
        selected = ", ".join("NULL, NULL" if c in missing else _cell_sql(c) for c in wanted)
        with closing(_connect(partition.path)) as connection:
            rows = connection.execute(*self._query(connection, table, selected, partition))
            position = 0
            cell_type = pa.struct([("kind", pa.string()), ("text", pa.string())])
            while batch := rows.fetchmany(_BATCH_ROWS):
                arrays = []
                for c in range(len(wanted)):
                    cells = [_cell(row[2 * c], row[2 * c + 1]) for row in batch]
                    arrays.append(pa.array(cells, cell_type))
                arrays += [
                    pa.array([partition.path] * len(batch)),
                    pa.array([partition.number] * len(batch), pa.int64()),
                    pa.array(range(position, position + len(batch)), pa.int64()),
                ]
                position += len(batch)
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema.fields])

    @staticmethod
    def _query(connection, table: str, selected: str, part: _Slice, ordered: bool = True) -> tuple:
        source, key = _name(table), _row_id(connection, table)
        if key is None:  # read by the first task
            return (f"SELECT {selected} FROM {source} WHERE ?", (part.number == 0,))
        low, high = connection.execute(f"SELECT min({key}), max({key}) FROM {source}").fetchone()
        if low is None:
            return (f"SELECT {selected} FROM {source} WHERE 0", ())
        width = -(-(high - low + 1) // part.slices)
        start = low + width * part.number
        # the last row id of a range may be the largest there is, so it is included
        bounds = (start, min(start + width - 1, high))
        return (f"SELECT {selected} FROM {source} WHERE {key} BETWEEN ? AND ?{f' ORDER BY {key}' if ordered else ''}", bounds)


def _row_id(connection, table: str) -> str | None:
    """A name of the row id that is not a column of the table; None if the table has no row ids or no name is left."""
    taken = {name.lower() for (name,) in connection.execute("SELECT name FROM pragma_table_xinfo(?)", (table,))}
    for name in ("rowid", "_rowid_", "oid"):
        if name not in taken:
            try:
                connection.execute(f"SELECT {name} FROM {_name(table)} LIMIT 0")
            except sqlite3.OperationalError:
                return None
            return name
    return None


def _cell_sql(name: str) -> str:
    """Two outputs: the value unless it is a blob, and the length of a blob."""
    col = _name(name)
    blob = f"typeof({col}) = 'blob'"
    return f"CASE WHEN NOT {blob} THEN {col} END, CASE WHEN {blob} THEN length({col}) END"


def _cell(value, blob_size):
    if blob_size is not None:
        return {"kind": "blob", "text": str(blob_size)}
    if value is None:
        return None
    if isinstance(value, str):
        return {"kind": "text", "text": value}
    return {"kind": "float" if isinstance(value, float) else "int", "text": repr(value)}


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, row_index: bool = False) -> DataFrame:
    """One table of one database, or of every database below a folder, with settled types.

    A column that holds several storage classes is text, one that holds nothing is text, a
    blob is its size. With `row_index` rows are numbered by file and row id.
    """
    spark.dataSource.register(SqliteTableSource)
    try:
        files = _files(path)
        if not files:
            raise TableReadError(f"{path} is not a SQLite database")
        # one table for all files: the one asked for, or the first one of the first file
        table, columns = _columns(files[0][0], table)
        options = {"table": table}
        cells = spark.read.format("sqlite_table").options(**options).load(path)
    except (ValueError, sqlite3.Error) as error:
        raise TableReadError(f"Cannot read SQLite database: {error}") from error
    types = cell_types(cells, columns)
    if row_index:
        if ROW_INDEX in columns:
            raise TableReadError(f"the table has a column of its own called {ROW_INDEX}: read it without row numbers")
        slices = sum(max(1, -(-size // SLICE_BYTES)) for _, size in files)
        counts = spark.read.format("sqlite_table").options(counts="true", **options).load(path)
        cells = _numbered(cells, counts, [p for p, _ in files], slices)
    typed = cast_cells(cells.drop(_FILE, _SLICE, _POSITION), types)
    return mark_numbered(typed) if row_index else typed


def _numbered(cells: DataFrame, counts: DataFrame, files: list[str], slices: int) -> DataFrame:
    """Row numbers from the counts per slice, which the databases make themselves."""
    if slices == 1:
        return cells.withColumn(ROW_INDEX, F.col(_POSITION) + 1)
    per_file = counts.groupBy(_FILE).agg(F.sum("rows").alias("rows"))
    earlier = Window.partitionBy(_FILE).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    in_file = counts.withColumn("__before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    step = max(4096, -(-len(files) // 512))
    ahead = running_offsets(per_file, sorted(files)[step::step]).drop("rows")
    starts = in_file.join(ahead, _FILE).select(_FILE, _SLICE, (F.col("__offset") + F.col("__before")).alias("__start"))
    joined = join_offsets(cells, starts, [_FILE, _SLICE], slices, max(map(len, files)) + 48)
    return joined.withColumn(ROW_INDEX, F.col("__start") + F.col(_POSITION) + 1).drop("__start")


def _list_tables(batches):
    import pandas as pd

    for pdf in batches:
        rows = [(p, n, name) for p in pdf["path"] if is_sqlite(p) for n, name in enumerate(_tables(p))]
        yield pd.DataFrame(rows, columns=["path", "position", "name"]).astype({"position": "int64"})


def list_sqlite_tables(files: DataFrame) -> DataFrame:
    """`path, position, name` of the user tables of every database in a listing, by name."""
    return files.select("path").mapInPandas(_list_tables, "path string, position bigint, name string")


