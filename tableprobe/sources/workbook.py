"""Cells of .xlsx workbooks, one workbook per task.

A folder of workbooks becomes a table of spreadsheet rows, which `rows_to_table` types. Only
the package parts that hold cells are decoded: values as last calculated, shared strings, and
the number formats that tell a date from a number. Declared dimensions, defined tables,
charts and links are not looked at.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import sys
import zipfile
from xml.etree import ElementTree

from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import TableReadError
from ..operators.footers import reachable
from ..operators.row_index import source_files
from ..session import scratch_dir
from .classify import open_input
from .grid import rows_to_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH_CELLS = 50_000
_CELL = "struct<kind:string,text:string>"
# Built-in number formats that show a date or a time, and the one that shows
# an elapsed time.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])
_ELAPSED_FORMATS = frozenset([46])

ROW_COLUMNS = f"path string, sheet_no int, sheet string, row bigint, cells array<{_CELL}>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class _Workbook:
    """The parts of one workbook that are needed to read its cells."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream)
        root = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets: list[tuple[str, str]] = []
        self.epoch = dt.datetime(1899, 12, 30)
        for node in root.iter():
            if _local(node.tag) == "workbookPr" and node.get("date1904") in ("1", "true"):
                self.epoch = dt.datetime(1904, 1, 1)
            if _local(node.tag) == "sheet":
                link = links.get(next((v for k, v in node.attrib.items() if _local(k) == "id"), None))
                if link is not None and link.get("Type", "").endswith("/worksheet"):
                    self.sheets.append((node.get("name"), posixpath.join("/xl", link.get("Target")).lstrip("/")))

    def _xml(self, part: str):
        return ElementTree.fromstring(self.zip.read(part))

    def _elements(self, part: str, name: str):
        """The elements of one name; each is dropped after its use, so that a part of any size is never held whole."""
        above: list = []
        with self.zip.open(part) as stream:
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    above.append(node)
                    continue
                above.pop()
                if _local(node.tag) == name:
                    yield node
                    above[-1].clear()

    def load_values(self) -> None:
        """Shared strings, and per cell style whether it shows a date or an elapsed time."""
        parts = set(self.zip.namelist())
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in parts:
            self.strings = [_plain_text(item) for item in self._elements("xl/sharedStrings.xml", "si")]
        self.dates: list[str | None] = []
        if "xl/styles.xml" in parts:
            styles = self._xml("xl/styles.xml")
            codes = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter() if _local(n.tag) == "numFmt"}
            formats = next((n for n in styles if _local(n.tag) == "cellXfs"), [])
            self.dates = [_date_style(int(x.get("numFmtId", 0)), codes) for x in formats]

    def rows(self, part: str):
        """(row, cells) from row 1 to the last one with a value, blank rows included."""
        row = blank_from = 0
        for node in self._elements(part, "row"):
            row = int(node.get("r", row + 1))
            cells: list = []
            for cell in node:
                col = _column_number(cell.get("r")) if cell.get("r") else len(cells) + 1
                value = self._value(cell)
                cells += [None] * (col - len(cells))
                cells[col - 1] = value
            if any(value is not None for value in cells):
                for blank in range(blank_from + 1, row):
                    yield blank, []
                blank_from = row
                yield row, cells

    def _value(self, cell) -> dict | None:
        found = self._read(cell)
        return None if found is None else dict(zip(("kind", "text"), found))

    def _read(self, cell) -> tuple[str, str] | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return ("text", _plain_text(cell[0])) if len(cell) else None
        raw = next((n.text for n in cell if _local(n.tag) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return "text", self.strings[int(raw)]
        if kind in ("str", "e"):
            return "text", raw
        if kind == "b":
            return "bool", str(raw not in ("0", "false"))
        if kind == "d":
            return "datetime", str(dt.datetime.fromisoformat(raw))
        number = float(raw) if set(raw) & set(".eE") else int(raw)
        style = int(cell.get("s", 0))
        shown = self.dates[style] if style < len(self.dates) else None
        if shown:
            return self._moment(number, shown)
        return "float" if isinstance(number, float) else "int", repr(number)

    def _moment(self, days: float, shown: str) -> tuple[str, str]:
        """A day count as what its format shows: an elapsed time, a clock time or a date."""
        span = dt.timedelta(milliseconds=round(days * 86_400_000))
        if shown == "elapsed":
            return "timedelta", str(span)
        if 0 <= days < 1 and span.days == 0:
            return "time", str((dt.datetime.min + span).time())
        if 0 < days < 60 and self.epoch.year == 1899:
            span += dt.timedelta(days=1)  # this calendar has a 29 February 1900
        return "datetime", str(self.epoch + span)


def _plain_text(item) -> str:
    """All runs of a string, without its phonetic guide."""
    out = []
    for node in item:
        if _local(node.tag) == "t":
            out.append(node.text or "")
        elif _local(node.tag) == "r":
            out += [t.text or "" for t in node if _local(t.tag) == "t"]
    return "".join(out)


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter.upper()) - 64
    return number


def _date_style(format_id: int, codes: dict[int, str]) -> str | None:
    code = codes.get(format_id)
    if code is None:
        return ("elapsed" if format_id in _ELAPSED_FORMATS else "date") if format_id in _DATE_FORMATS else None
    shown = re.sub(r'"[^"]*"|\\.|_.', "", code.split(";")[0])
    if re.search(r"\[(h+|m+|s+)\]", shown, re.I):
        return "elapsed"
    return "date" if re.search("[dmhys]", re.sub(r"\[[^\]]*\]", "", shown), re.I) else None


def _stream(path: str, content: bytes | None):
    """A workbook that the task opens itself, or whose bytes came with the scan."""
    return open_input(path) if content is None else io.BytesIO(content)


def _row_batches(sheet: str | None, first: bool):
    def decode(batches):
        import pandas as pd

        names = ["path", "sheet_no", "sheet", "row", "cells"]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                book = _Workbook(_stream(path, content))
                # two sheets can share a title only in a hand-made file: the first one is meant
                chosen = [(n, s) for n, s in enumerate(book.sheets) if sheet is None or s[0] == sheet]
                if chosen:
                    book.load_values()
                for number, (title, part) in chosen[:1] if first or sheet is not None else chosen:
                    rows, size = [], 0
                    for row, cells in book.rows(part):
                        rows.append((path, number, title, row, cells))
                        size += len(cells) + 1
                        if size >= _BATCH_CELLS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return decode


def _sheet_batches(batches):
    import pandas as pd

    for pdf in batches:
        rows = [
            (path, n, title)
            for path, content in zip(pdf["path"], pdf["content"])
            for n, (title, _) in enumerate(_Workbook(_stream(path, content)).sheets)
        ]
        yield pd.DataFrame(rows, columns=["path", "position", "name"]).astype({"position": "int64"})


def _workbooks(spark: SparkSession, path) -> DataFrame:
    """`path, content` of the files; without their bytes where tasks can open them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = source_files(found)
    opened = bool(files) and reachable(files[0])
    return found.select("path", F.lit(None).cast("binary").alias("content") if opened else "content")


def read_rows(spark: SparkSession, path, sheet: str | None = None, first: bool = False) -> DataFrame:
    """`path, sheet_no, sheet, row, cells` of all worksheets, the one named `sheet`, or the first."""
    return _workbooks(spark, path).mapInPandas(_row_batches(sheet, first), ROW_COLUMNS)


def read_cells(spark: SparkSession, path, sheet: str | None = None) -> DataFrame:
    """`path, sheet_no, sheet, row, col, kind, text` of the cells that hold something."""
    cells = read_rows(spark, path, sheet).select(
        "path", "sheet_no", "sheet", "row", F.posexplode("cells").alias("col", "cell")
    )
    found = cells.filter("cell is not null")
    return found.select("path", "sheet_no", "sheet", "row", (F.col("col") + 1).alias("col"), "cell.kind", "cell.text")


def list_sheets(spark: SparkSession, path) -> DataFrame:
    """`path, position, name` of the worksheets, in workbook order, hidden ones included."""
    return _workbooks(spark, path).mapInPandas(_sheet_batches, "path string, position bigint, name string")


def _staged(rows: DataFrame) -> DataFrame:
    """The rows as a written table, so that several passes decode each workbook once."""
    spark = rows.sparkSession
    try:
        folder = scratch_dir(spark, "workbook-rows")
    except RuntimeError:  # no shared folder: every pass decodes
        return rows
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def read_workbook(spark: SparkSession, path, sheet: str | None = None, row_index: bool = False) -> DataFrame:
    """One worksheet of each workbook (the first by default) as one typed table."""
    try:
        sheets = list_sheets(spark, path)
        wanted = sheets.filter(F.col("position") == 0 if sheet is None else F.col("name") == sheet)
        missing = _workbooks(spark, path).select("path").join(wanted, "path", "left_anti").limit(1).collect()
        if missing:
            reason = "Workbook contains no worksheets" if sheet is None else f"Sheet not found: {sheet}"
            raise TableReadError(f"{reason}: {missing[0].path}")
        rows = read_rows(spark, path, sheet, first=True)
        return rows_to_table(_staged(rows.select("path", "row", "cells")), row_index)
    except PySparkException as error:
        raise TableReadError(f"cannot read workbook {path}: {error}") from error
