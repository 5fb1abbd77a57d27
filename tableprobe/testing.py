"""Sample sources written by Spark from a table: databases and workbooks.

Files are named by the partition's number and counted in it, so that a range-partitioned frame
becomes files whose order by path is the order of the table. Rows are written as they come: no
task holds those of a partition or of a file. Used by the tests and by the registered queries
that read such sources.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# the functions below run inside tasks, where this package need not be installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a workbook. A worksheet holds 1,048,576, and one task decodes a workbook.
WORKBOOK_ROWS = 100_000


def _located(folder: str):
    import pyarrow.fs as fs

    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def _file_writer(folder: str, extension: str, build, most: int | None = None):
    """A `mapInPandas` function: the rows of a partition through `build` into a file, or files of `most` rows.

    `build` takes an iterator of frames and an output stream.
    """

    def cut(batches):
        """(file, rows), no piece across two files."""
        file = used = 0
        for rows in batches:
            while len(rows):
                piece = rows if most is None else rows[: most - used]
                yield file, piece
                rows, used = rows[len(piece) :], used + len(piece)
                if used == most:
                    file, used = file + 1, 0

    def write(batches):
        import itertools

        import pandas as pd
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        system, inner = _located(folder)
        for file, pieces in itertools.groupby(cut(batches), key=lambda piece: piece[0]):
            system.create_dir(inner, recursive=True)
            name = f"part-{number:05d}-{file:05d}.{extension}"
            total = 0

            def counted():
                nonlocal total
                for _, rows in pieces:
                    total += len(rows)
                    yield rows

            with system.open_output_stream(f"{inner}/{name}") as out:
                build(counted(), out)
            yield pd.DataFrame({"file": [name], "rows": [total]})

    return write


def write_databases(df: DataFrame, folder: str, table: str) -> int:
    """Each partition as a SQLite database with one table; returns the number of files."""

    def build(frames, out) -> None:
        import shutil
        import sqlite3
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".db") as file:
            connection = sqlite3.connect(file.name)
            for n, rows in enumerate(frames):
                if n == 0:
                    names = ", ".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
                    connection.execute(f'CREATE TABLE "{table}" ({names})')
                    marks = ", ".join("?" * len(rows.columns))
                values = rows.astype(object).where(rows.notna(), None).values.tolist()
                connection.executemany(f'INSERT INTO "{table}" VALUES ({marks})', values)
                connection.commit()
            connection.close()
            shutil.copyfileobj(file, out, 1 << 20)

    written = df.mapInPandas(_file_writer(folder, "db", build), "file string, rows bigint")
    return written.count()


def write_workbooks(df: DataFrame, folder: str, sheet: str) -> int:
    """Each partition as workbooks of one worksheet and at most `WORKBOOK_ROWS` rows; returns the number of files."""

    def build(frames, out) -> None:
        import datetime as dt
        import numbers
        import zipfile
        from xml.sax.saxutils import escape, quoteattr

        def cell(value) -> str:
            if value is None or value != value:
                return "<c/>"
            if isinstance(value, bool):
                return f'<c t="b"><v>{int(value)}</v></c>'
            if isinstance(value, numbers.Integral):
                return f"<c><v>{int(value)}</v></c>"
            if isinstance(value, numbers.Real):
                return f"<c><v>{float(value)!r}</v></c>"
            if isinstance(value, dt.datetime):
                days = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
                return f'<c s="1"><v>{days!r}</v></c>'
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        def row(values) -> str:
            return "<row>" + "".join(map(cell, values)) + "</row>"

        parts = {
            "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets>'
            f'<sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        }
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            for name, text in parts.items():
                package.writestr(name, text)
            with package.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
                part.write(f"<worksheet {main}><sheetData>".encode())
                for n, rows in enumerate(frames):
                    if n == 0:
                        part.write(row(rows.columns).encode())
                    part.write("".join(map(row, rows.astype(object).values.tolist())).encode())
                part.write(b"</sheetData></worksheet>")

    written = df.mapInPandas(_file_writer(folder, "xlsx", build, WORKBOOK_ROWS), "file string, rows bigint")
    return written.count()


def join_files(spark: SparkSession, parts: str, file: str) -> int:
    """The files that a query wrote into a folder, end to end by partition, as one file; returns its bytes.

    One file has one writer, so one task copies them, a block at a time.
    """

    def copy(batches):
        import posixpath
        import shutil

        import pandas as pd
        import pyarrow.fs as fs

        for _ in batches:
            system, inner = _located(parts)
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-"))
            target = _located(file)[1]
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as out:
                for name in names:
                    with system.open_input_stream(name) as stream:
                        shutil.copyfileobj(stream, out, 8 << 20)
                size = out.tell()
            yield pd.DataFrame({"bytes": [size]})

    return spark.range(1, numPartitions=1).mapInPandas(copy, "bytes bigint").first().bytes


def write_split(df: DataFrame, by: str, folder: str) -> None:
    """Parquet with one file for each value of a column.

    A task has a writer for each of its values; without that Spark sorts the rows of a task by the value first.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(setting)
    conf.set(setting, "64")
    try:
        df.repartition(by).write.partitionBy(by).parquet(folder)
    finally:
        conf.set(setting, before)
