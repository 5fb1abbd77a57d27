import datetime as dt
import re
import gzip
import sqlite3
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableprobe import Explorer, Filter, TableReadError, read_table, table_metadata
from tableprobe.sources import (
    classify_files, column_metadata, grid_to_table, list_tables, read_cells, read_csv, read_sqlite, read_tsv,
    read_workbook, resolve_kinds, source_type, type_text_columns,
)
from tableprobe.testing import write_workbooks


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def shape(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def test_csv_types_come_from_every_row(spark, tmp_path):
    lines = ["id,val,flag,ratio,day,gone"] + [f"{i},{i},true,{i}.5,2024-01-01," for i in range(1, 201)] + ["201,ACCFS-108,FALSE,1e3,2024-01-02,NA"]
    df = read_csv(spark, put(tmp_path / "a.csv", "\n".join(lines)))
    assert shape(df) == [("id", "bigint"), ("val", "string"), ("flag", "boolean"), ("ratio", "double"), ("day", "string"), ("gone", "string")]
    assert df.count() == 201 and df.filter("gone is not null").count() == 0


def test_csv_markers_and_wide_integers(spark, tmp_path):
    df = read_csv(spark, put(tmp_path / "a.csv", "v,u,w,e,i\n10,9223372036854775808,18446744073709551616,#REF!,Inf\nNA,1,2,3,1\n30,,,,\n"))
    assert shape(df) == [("v", "bigint"), ("u", "decimal(20,0)"), ("w", "string"), ("e", "string"), ("i", "string")]
    assert [r.v for r in df.collect()] == [10, None, 30]
    assert df.first().u == Decimal(9223372036854775808) and df.first().w == "18446744073709551616"


def test_quotes_breaks_and_blank_lines(spark, tmp_path):
    df = read_csv(spark, put(tmp_path / "a.csv", 'id,t\n1,"a ""b"", c"\n\n2,"line\nbreak"\n3, padded \n4\n'), row_index=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a "b", c', 1), (2, "line\nbreak", 2), (3, " padded ", 3), (4, None, 4)]


def test_headers(spark, tmp_path):
    df = read_csv(spark, put(tmp_path / "a.csv", "﻿,a,a,ID,id\n1,2,3,4,5\n"))
    assert df.columns == ["Unnamed: 0", "a", "a.1", "ID", "id"] and df.first() == (1, 2, 3, 4, 5)


def test_latin1_beside_utf8(spark, tmp_path):
    put(tmp_path / "a.csv", "city,n\nZürich,1\n".encode("latin-1"))
    put(tmp_path / "b c.csv", "city,n\nŁódź,2\n")
    assert sorted(r.city for r in read_csv(spark, str(tmp_path)).collect()) == ["Zürich", "Łódź"]
    rows = read_csv(spark, str(tmp_path), row_index=True).collect()
    assert sorted((r.row_index, r.city) for r in rows) == [(1, "Zürich"), (2, "Łódź")]
    table = Explorer(spark, str(tmp_path), kind="csv")
    assert [r.city for r in table.page(sort_by="n", ascending=False, limit=1).collect()] == ["Łódź"]


@pytest.mark.parametrize("content", [b"", "a,b\n1,2,3,4,5\n", "a,b\n1,2\n".encode("utf-16")])
def test_unreadable_text_is_a_typed_error(spark, tmp_path, content):
    with pytest.raises(TableReadError):
        read_csv(spark, put(tmp_path / "a.csv", content))


def test_extra_fields_fail_also_with_given_types(spark, tmp_path):
    df = read_csv(spark, put(tmp_path / "a.csv", "a,b\n1,2\n1,2,3\n"), types={"a": "bigint", "b": "bigint"})
    with pytest.raises(PySparkException, match="more than the header's 2 fields"):
        df.collect()


@pytest.mark.parametrize("multi_line", [False, True])
@pytest.mark.parametrize("row", ["1,2,", "1,2,,x", "1,2,,,", ",,x", '1,"2,3",x', '"1","2\n3",,y'])
def test_rows_wider_than_the_header_are_refused(spark, tmp_path, row, multi_line):
    path = put(tmp_path / "a.csv", f"a,b\n1,2\n{row}\n")
    df = read_csv(spark, path, types={}, multi_line=multi_line or "\n" in row)
    with pytest.raises(PySparkException, match="more than the header's 2 fields"):
        df.count()
    with pytest.raises(PySparkException, match="more than the header's 2 fields"):
        df.select("b").collect()


@pytest.mark.parametrize("multi_line", [False, True])
def test_short_rows_are_filled(spark, tmp_path, multi_line):
    path = put(tmp_path / "a.csv", 'a,b,c\nx,y,z\nx\n"x,""1"\nx,y\n,y\n"x"')
    df = read_csv(spark, path, multi_line=multi_line)
    assert sorted(map(tuple, df.fillna("-").collect())) == sorted([("x", "y", "z"), ("x", "-", "-"), ('x,"1', "-", "-"), ("x", "y", "-"), ("-", "y", "-"), ("x", "-", "-")])
    assert df.count() == 6


def test_files_with_columns_in_another_order_are_read_by_name(spark, tmp_path):
    put(tmp_path / "1.csv", "a,b\n1,x\n")
    put(tmp_path / "2.csv", "\ufeffb,a\ny,2\n")
    put(tmp_path / "3.csv", '\na,b\n3,"z\nz"\n')
    put(tmp_path / "4.csv", "")
    put(tmp_path / "5.csv", "b,a\n\xfc,5\n".encode("latin-1"))
    df = read_csv(spark, str(tmp_path), row_index=True)
    assert shape(df)[:2] == [("a", "bigint"), ("b", "string")]
    assert sorted((r.row_index, r.a, r.b) for r in df.collect()) == [(1, 1, "x"), (2, 2, "y"), (3, 3, "z\nz"), (4, 5, "\xfc")]
    put(tmp_path / "6.csv", "a,b,c\n6,x,y\n")
    with pytest.raises(TableReadError, match="has the columns"):
        read_csv(spark, str(tmp_path))


def test_header_over_two_lines(spark, tmp_path):
    put(tmp_path / "1.csv", '"a\n1",b\n1,x\n')
    put(tmp_path / "2.csv", '"a\n1",b\n2,y\n')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "y")]
    put(tmp_path / "3.csv", '"a\n2",b\n3,z\n')
    with pytest.raises(TableReadError, match="has the columns"):
        read_csv(spark, str(tmp_path))


def test_a_quote_inside_a_field_or_in_another_file_leaves_files_split(spark, tmp_path):
    put(tmp_path / "1.csv", "a,b\n" + "".join(f"{i},row {i}\n" for i in range(2000)))
    put(tmp_path / "2.csv", 'a,b\n1,5" pipe\n2,"6"" pipe"\n')
    put(tmp_path / "3.csv", 'a,b\n3,"two\nlines"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv(spark, str(tmp_path))
        parts = {r.b: r.p for r in df.select("b", F.spark_partition_id().alias("p")).collect()}
        assert len({p for b, p in parts.items() if b.startswith("row")}) > 4
        assert {'5" pipe', '6" pipe', "two\nlines"} < set(parts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_only_and_tsv(spark, tmp_path):
    assert read_csv(spark, put(tmp_path / "a.csv", "a,b\n")).count() == 0
    df = read_tsv(spark, put(tmp_path / "a.tsv", "a\tb\n1\tx,y\n"))
    assert df.first() == (1, "x,y")
    assert read_table(spark, str(tmp_path / "a.tsv")).first() == (1, "x,y")


def test_missing_file(spark, tmp_path):
    for name in ("none.csv", "none.parquet", "none.xlsx"):
        with pytest.raises(TableReadError):
            read_table(spark, str(tmp_path / name))


def test_classification_goes_by_content_then_name(spark, tmp_path):
    sqlite3.connect(tmp_path / "real.txt").execute("CREATE TABLE t (a)")
    put(tmp_path / "text.db", "not a database")
    put(tmp_path / "zip.db", b"PK\x03\x04")
    put(tmp_path / "PAR1.csv", "PAR1,b\n1,2\n")
    put(tmp_path / "old name.XLS", b"x" * 1536)
    put(tmp_path / "plain", b"-")
    put(tmp_path / "empty.csv", b"")
    put(tmp_path / "odd [x] %25.xlsx", b"")
    empty = {r.path.rsplit("/", 1)[1]: r for r in classify_files(spark, str(tmp_path)).filter("size = 0").collect()}
    assert {n: (r.source_type, r.size_text) for n, r in empty.items()} == {"empty.csv": ("csv", "0 B"), "odd [x] %25.xlsx": ("excel", "0 B")}
    assert abs(empty["empty.csv"].modified.timestamp() - (tmp_path / "empty.csv").stat().st_mtime) < 90_000
    (tmp_path / "empty.csv").unlink()
    (tmp_path / "odd [x] %25.xlsx").unlink()
    got = {r.path.rsplit("/", 1)[1]: r for r in classify_files(spark, str(tmp_path)).collect()}
    assert {n: r.source_type for n, r in got.items()} == {"real.txt": "sqlite", "text.db": "unknown", "zip.db": "unknown", "PAR1.csv": "csv", "old name.XLS": "excel", "plain": "unknown"}
    assert got["old name.XLS"].size_text == "1.5 KB" and got["plain"].size_text == "1 B"
    assert source_type(str(tmp_path / "real.txt")) == "sqlite" and source_type("x/y.parquet") == "parquet"
    with pytest.raises(TableReadError, match="Unsupported"):
        read_table(spark, str(tmp_path / "zip.db"))
    assert read_table(spark, str(tmp_path / "PAR1.csv")).columns == ["PAR1", "b"]


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "shop.db"
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE zoo (id INTEGER PRIMARY KEY AUTOINCREMENT, n INT, "odd ""name\""" TEXT);
        CREATE TABLE sqliteX (a);
        CREATE TABLE mixed (id INT, m, half, blank, double_id INT GENERATED ALWAYS AS (id * 2) VIRTUAL, payload BLOB);
        CREATE TABLE keyed (k TEXT PRIMARY KEY, v REAL) WITHOUT ROWID;
        CREATE TABLE empty (a, b);
    """)
    con.executemany("INSERT INTO zoo VALUES (NULL, ?, ?)", [(i, f"x{i}") for i in range(50)])
    con.executemany("INSERT INTO mixed (id, m, half, payload) VALUES (?, ?, ?, ?)", [(1, 42, 1, None), (2, "n/a", 2.5, b""), (3, 17, 3, b"\x00" * 2048), (4, "1250", 4, "text"), (5, None, 5, 42)])
    con.executemany("INSERT INTO keyed VALUES (?, ?)", [("b", 2.0), ("a", 1.5)])
    con.commit()
    con.close()
    return str(path)


def test_sqlite_tables(spark, database):
    names = [r.name for r in list_tables(spark, database).orderBy("position").collect()]
    assert names == ["empty", "keyed", "mixed", "sqliteX", "zoo"]


def test_sqlite_types_are_settled_per_column(spark, database):
    df = read_sqlite(spark, database, "mixed", row_index=True)
    assert shape(df) == [("id", "bigint"), ("m", "string"), ("half", "double"), ("blank", "string"), ("double_id", "bigint"), ("payload", "string"), ("row_index", "bigint")]
    rows = df.orderBy("id").collect()
    assert [r.m for r in rows] == ["42", "n/a", "17", "1250", None]
    assert [r.payload for r in rows] == [None, "<BLOB 0 B>", "<BLOB 2 KB>", "text", "42"]
    assert [r.row_index for r in rows] == [1, 2, 3, 4, 5] and [r.double_id for r in rows] == [2, 4, 6, 8, 10]


@pytest.mark.parametrize("columns", ["rowid INT, v", "rowid TEXT, _ROWID_ INT, v", "rowid, _rowid_, oid, v", "oid, rowid INTEGER PRIMARY KEY, v"])
def test_sqlite_row_ids_beside_columns_of_that_name(spark, tmp_path, columns, monkeypatch):
    from tableprobe.sources import sqlite

    monkeypatch.setattr(sqlite, "SLICE_BYTES", 4096)
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute(f"CREATE TABLE t ({columns})")
    marks = [c.split()[0] for c in columns.split(", ")]
    con.executemany(f"INSERT INTO t ({marks[0]}, v) VALUES (?, ?)", [(None if i % 2 else "1", f"row {i}" * 20) for i in range(300)])
    con.commit()
    con.close()
    rows = read_sqlite(spark, str(tmp_path / "a.db"), "t", row_index=True).collect()
    assert sorted((r.row_index, r.v) for r in rows) == [(i + 1, f"row {i}" * 20) for i in range(300)]


def test_sqlite_slices_and_odd_tables(spark, database, monkeypatch):
    from tableprobe.sources import sqlite

    assert read_sqlite(spark, database, "zoo").columns == ["id", "n", 'odd "name"']
    assert [r.v for r in read_sqlite(spark, database, "keyed").collect()] == [1.5, 2.0]
    assert shape(read_sqlite(spark, database)) == [("a", "string"), ("b", "string")]
    monkeypatch.setattr(sqlite, "SLICE_BYTES", 4096)
    df = read_sqlite(spark, database, "zoo", row_index=True)
    assert df.rdd.getNumPartitions() > 1
    assert sorted((r.n, r.row_index) for r in df.collect()) == [(i, i + 1) for i in range(50)]


def test_sqlite_errors(spark, database, tmp_path):
    with pytest.raises(TableReadError, match="has no table"):
        read_sqlite(spark, database, "nope")
    corrupt = put(tmp_path / "bad.db", b"SQLite format 3\x00" + b"\x07" * 500)
    with pytest.raises(TableReadError):
        read_table(spark, corrupt)


def test_sqlite_is_not_changed_by_reading(spark, database):
    before = open(database, "rb").read()
    Explorer(spark, database, "zoo").page(sort_by="n", ascending=False).collect()
    assert open(database, "rb").read() == before


@pytest.fixture
def cells(spark):
    def build(*grid, path="p"):
        rows = [(path, r, c, *v) for r, line in enumerate(grid, 1) for c, v in enumerate(line, 1) if v is not None]
        return spark.createDataFrame(rows, "path string, row bigint, col int, kind string, text string")

    return build


def t(*texts):
    return [None if x is None else ("text", x) for x in texts]


def test_grid_header_is_row_one_whatever_it_holds(cells):
    df = grid_to_table(cells(t("a", None, "a"), [("int", "1"), ("int", "2"), ("float", "2.5"), ("bool", "True")]))
    assert shape(df) == [("a", "bigint"), ("Unnamed: 1", "bigint"), ("a.1", "double"), ("Unnamed: 3", "boolean")]


def test_grid_trailing_and_inner_blank_rows(cells):
    df = grid_to_table(cells(t("a", "b"), [("int", "1"), None], [None, None], t(None, " "), [None, None]), row_index=True)
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [(1, None, 1), (None, None, 2), (None, " ", 3)]


def test_grid_header_only_and_nothing(cells, spark):
    df = grid_to_table(cells(t("a", "b")))
    assert df.columns == ["a", "b"] and df.count() == 0
    assert grid_to_table(cells().filter("false")).columns == []


def test_grid_markers_and_errors_are_missing(cells):
    errors = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "NA", ""]
    df = grid_to_table(cells(t("amount"), [("int", "10")], *[t(e) for e in errors], [("int", "30")]))
    assert shape(df) == [("amount", "bigint")] and df.filter("amount is null").count() == 9


@pytest.mark.parametrize("values, expected", [
    ([("datetime", "2024-01-01 00:00:00"), ("time", "10:00:00")], "string"),
    ([("date", "2024-01-01"), ("datetime", "2024-01-01 10:00:00")], "timestamp_ntz"),
    ([("date", "2024-01-01")], "date"),
    ([("datetime", "2024-01-01 00:00:00"), ("timedelta", "1 day, 0:00:00")], "string"),
    ([("time", "10:00:00"), ("timedelta", "1:00:00")], "string"),
    ([("int", "5"), ("datetime", "2024-01-01 00:00:00")], "string"),
    ([("datetime", "2024-01-01 00:00:00"), ("text", "x")], "string"),
    ([("bool", "True"), ("int", "1")], "string"),
    ([("bool", "True"), None], "boolean"),
    ([("int", "1"), ("float", "2.5")], "double"),
    ([("int", "9223372036854775808"), ("int", "1")], "decimal(20,0)"),
    ([("int", "9223372036854775808"), ("int", "-1")], "string"),
    ([("int", str(2**130)), ("int", "1")], "string"),
    ([("blob", "2048"), ("text", "x")], "string"),
    ([None], "string"),
])
def test_kinds(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v struct<kind:string,text:string>")
    got = resolve_kinds(df, ["v"])
    assert shape(got) == [("v", expected)]
    assert got.filter("v is not null").count() == sum(v is not None for v in values)


def test_workbook(spark, tmp_path):
    rows = [(1, "a & <b>", 1.5, True, dt.datetime(2024, 5, 6, 7, 8, 9)), (2, None, 2.0, False, dt.datetime(2024, 5, 7))]
    df = spark.createDataFrame(rows, "id bigint, name string, x double, ok boolean, at timestamp_ntz").coalesce(1)
    write_workbooks(df, f"{tmp_path}/books", "Sales 2024")
    assert [(r.position, r.name) for r in list_tables(spark, f"{tmp_path}/books", "excel").collect()] == [(0, "Sales 2024")]
    got = read_workbook(spark, f"{tmp_path}/books", row_index=True)
    assert shape(got) == [("id", "bigint"), ("name", "string"), ("x", "double"), ("ok", "boolean"), ("at", "timestamp_ntz"), ("row_index", "bigint")]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(*r, i) for i, r in enumerate(rows, 1)]
    with pytest.raises(TableReadError, match="Sheet not found"):
        read_workbook(spark, f"{tmp_path}/books", "nope")
    assert read_cells(spark, f"{tmp_path}/books").filter("row = 1").count() == 5


def test_workbooks_with_unlike_headers(spark, tmp_path):
    """Columns are matched by name, in any order; a workbook with other columns is refused."""
    folder = f"{tmp_path}/books"
    write_workbooks(spark.createDataFrame([(1, "x")], "id bigint, name string").coalesce(1), f"{folder}/a", "S")
    write_workbooks(spark.createDataFrame([("y", 2)], "name string, id bigint").coalesce(1), f"{folder}/b", "S")
    got = read_workbook(spark, folder, row_index=True)
    assert shape(got) == [("id", "bigint"), ("name", "string"), ("row_index", "bigint")]
    assert sorted(map(tuple, got.collect())) == [(1, "x", 1), (2, "y", 2)]
    grid = grid_to_table(read_cells(spark, folder).select("path", "row", "col", "kind", "text"))
    assert sorted(map(tuple, grid.collect())) == [(1, "x"), (2, "y")]
    write_workbooks(spark.createDataFrame([(3, "z")], "id bigint, town string").coalesce(1), f"{folder}/c", "S")
    with pytest.raises(TableReadError, match="has the columns"):
        read_workbook(spark, folder)


def test_long_partitions_become_several_workbooks(spark, tmp_path, monkeypatch):
    """Rows beyond those of one workbook go to the next, and stay in the order of the table."""
    from tableprobe import testing

    monkeypatch.setattr(testing, "WORKBOOK_ROWS", 10)
    assert write_workbooks(spark.range(25).coalesce(1), f"{tmp_path}/books", "S") == 3
    got = read_workbook(spark, f"{tmp_path}/books", row_index=True)
    assert sorted(map(tuple, got.collect())) == [(i, i + 1) for i in range(25)]


def test_rows_of_a_partition_are_not_held(spark, tmp_path, monkeypatch):
    """A writer's memory is that of a batch of rows, however many a partition has."""
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def frames():
        for start in range(0, 60_000, 1_000):
            ids = range(start, start + 1_000)
            yield pd.DataFrame({"id": ids, "name": [f"name of row {i}" for i in ids]})

    def here(task, schema):
        """The task in this process, where its memory can be traced."""
        return SimpleNamespace(count=lambda: len(list(task(frames()))))

    tracemalloc.start()
    assert write_workbooks(SimpleNamespace(mapInPandas=here), f"{tmp_path}/books", "S") == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    assert read_workbook(spark, f"{tmp_path}/books").agg(F.count("name"), F.sum("id")).first()[:] == (60_000, sum(range(60_000)))


def test_unlike_workbooks_of_bounded_size_are_one_table(spark, sf, tmp_path, monkeypatch):
    """Many workbooks in two orders of columns, none with more rows than a workbook may have, lose and mix up nothing."""
    import __spark_entry__ as catalog
    from tableprobe import testing

    monkeypatch.setattr(testing, "WORKBOOK_ROWS", 100)
    monkeypatch.setattr(catalog, "scratch_dir", lambda spark, label: f"{tmp_path}/{label}")
    got = catalog.queries()["workbook_ingest_unlike_files"](spark, sf).collect()
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("string")).collect()
    orders.sort(key=lambda r: (r.o_orderkey % 2, r.o_orderkey))
    assert sorted(map(tuple, got), key=lambda r: r[-1]) == [(*r, i) for i, r in enumerate(orders, 1)]
    books = read_cells(spark, f"{tmp_path}/workbooks").filter("row > 1").groupBy("path").agg(F.count_distinct("row").alias("rows")).collect()
    assert max(b.rows for b in books) <= 100 and sum(b.rows for b in books) == len(orders)


def test_rows_of_a_worksheet_are_not_held(tmp_path):
    import tracemalloc
    import zipfile

    from tableprobe.sources.workbook import _Workbook

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("xl/workbook.xml", f"<workbook {main}/>")
        package.writestr("xl/_rels/workbook.xml.rels", "<Relationships/>")
        package.writestr("s.xml", f"<worksheet {main}><sheetData>" + "<row><c><v>1</v></c></row>" * 60_000 + "</sheetData></worksheet>")
    with open(tmp_path / "a.xlsx", "rb") as stream:
        book = _Workbook(stream)
        book.load_values()
        tracemalloc.start()
        assert sum(1 for _ in book.rows("s.xml")) == 60_000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 2_000_000


def test_workbook_parts(spark, tmp_path):
    """Shared strings, styles, formulas, errors and a chart sheet, in a hand-made package."""
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f"""<worksheet {main}><dimension ref="A1"/><sheetData>
      <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>when</t></is></c></row>
      <row r="3"><c r="A3"><v>7</v></c><c r="B3" t="str"><f>A1</f><v>calc</v></c><c r="C3" t="e"><v>#REF!</v></c><c r="D3" s="1"><v>45000.5</v></c></row>
      <row r="4"><c r="A4" t="b"><v>1</v></c><c r="D4" s="2"><v>1.5</v></c><c r="E4" s="1"><v>0.25</v></c></row>
    </sheetData></worksheet>"""
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="Chart" sheetId="1" r:id="r1"/><sheet name="Data" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/chartsheet" Target="chartsheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>key</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="[h]:mm"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet2.xml": sheet,
    }
    with zipfile.ZipFile(tmp_path / "b.xls", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    df = read_table(spark, str(tmp_path / "b.xls"), row_index=True)
    assert df.columns == ["key", "rich text", "Unnamed: 2", "when", "Unnamed: 4", "row_index"]
    rows = [tuple(r) for r in df.orderBy("row_index").collect()]
    assert rows == [(None, None, None, None, None, 1), ("7", "calc", None, "2023-03-15 12:00:00", None, 2), ("True", None, None, "1 day, 12:00:00", "06:00:00", 3)]


def test_all_null_and_metadata(spark, tmp_path):
    spark.range(3).withColumn("d", F.lit(1.5)).write.parquet(f"{tmp_path}/t.parquet")
    got = table_metadata(spark, f"{tmp_path}/t.parquet").orderBy("position").collect()
    assert [(r.position, r.name, r.type, r.total_rows, r.source_type) for r in got] == [(1, "id", "int", 3, "parquet"), (2, "d", "float", 3, "parquet")]
    assert got[0].file_size > 0
    void = spark.sql("SELECT NULL AS a")
    assert column_metadata(void).first().type == "string"


def test_text_columns_of_any_frame(spark):
    df = spark.createDataFrame([("1", "true", "x"), (None, "False", "NA")], "a string, b string, c string")
    got = type_text_columns(df)
    assert shape(got) == [("a", "bigint"), ("b", "boolean"), ("c", "string")] and got.collect()[1] == (None, False, None)


def test_explorer(spark, database, tmp_path):
    table = Explorer(spark, database, "zoo")
    assert table.kind == "sqlite" and table.tables().count() == 5
    rows = table.page({"n": {"type": "number", "value": "45", "operator": ">="}}, sort_by="n", ascending=False, max_cell_chars=1).collect()
    assert [r.row_index for r in rows] == [50, 49, 48, 47, 46] and rows[0]['odd "name"'] == "x..."
    assert table.totals([table.filter_entry("n", "< 10")]).first().total_rows == 10
    assert table.unique_values("n", 3).first().total_unique == 50
    assert table.column_stats("n").first().max_value == 49.0
    assert table.page_json(limit=1).first().json == '{"id":1,"n":0,"odd \\"name\\"":"x0"}'
    path = table.export(str(tmp_path), "csv", [Filter("n", "3", "number", "<")])
    assert path.endswith("/shop_zoo_filtered.csv") and read_csv(spark, path).count() == 3
    con = sqlite3.connect(database)
    con.execute("INSERT INTO zoo (n) VALUES (99)")
    con.commit()
    assert table.refresh().totals().first().total_rows == 51


def test_compressed_text(spark, tmp_path):
    put(tmp_path / "a.csv.gz", gzip.compress(b"a,b\n1,2\n"))
    assert read_csv(spark, str(tmp_path / "a.csv.gz")).first() == (1, 2)


def test_staged_table_pages_and_describes_the_same(spark, tmp_path):
    spark.range(3000).selectExpr("id", "concat('k', id % 7) AS k").repartition(5).write.csv(f"{tmp_path}/t.csv", header=True)
    table = Explorer(spark, f"{tmp_path}/t.csv")
    staged = table.stage(f"{tmp_path}/staged")
    for options in ({"offset": 1200, "limit": 40}, {"sort_by": "k", "offset": 500, "limit": 30}, {"filters": [Filter("k", "3")]}):
        assert staged.page(**options).collect() == table.page(**options).collect()
    assert staged.profile().collect() == table.profile().collect()
    assert "Join" not in table.df._jdf.queryExecution().optimizedPlan().toString()


def test_parquet_types_that_need_care(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    old = dt.datetime(1969, 12, 31, 23, 59, 59, 999999)
    columns = {
        "nothing": pa.nulls(2),
        "ns": pa.array([old, None], pa.timestamp("ns")),
        "u64": pa.array([2**64 - 1, 1], pa.uint64()),
        "time": pa.array([dt.time(1, 2, 3), None], pa.time64("us")),
        "dictionary": pa.array(["a", None]).dictionary_encode(),
        "view": pa.array(["a", None], pa.string_view()),
    }
    pq.write_table(pa.table(columns), tmp_path / "t.parquet")
    table = Explorer(spark, str(tmp_path / "t.parquet"))
    assert shape(table.df) == [("nothing", "string"), ("ns", "timestamp_ntz"), ("u64", "decimal(20,0)"), ("time", "time(6)"), ("dictionary", "string"), ("view", "string")]
    assert tuple(table.page().first()) == (None, "1969-12-31T23:59:59.999999", Decimal(2**64 - 1), "01:02:03", "a", "a", 1)
    assert [r.data_type for r in table.profile().collect()] == ["string", "datetime", "int", "time", "string", "string"]
    pq.write_table(pa.table({"wide": pa.array([Decimal("1.20")], pa.decimal256(40, 2))}), tmp_path / "w.parquet")
    with pytest.raises(TableReadError, match="precision"):
        Explorer(spark, str(tmp_path / "w.parquet"))


def test_databases_are_one_table(spark, tmp_path):
    """A later database is read for the same table, and may not have columns that the first one lacks."""
    for name, script in (
        ("a", "CREATE TABLE people (id INT, name TEXT); INSERT INTO people VALUES (1, 'x');"),
        ("b", "CREATE TABLE files (id INT); INSERT INTO files VALUES (9); CREATE TABLE people (name TEXT, id INT); INSERT INTO people VALUES ('y', 2);"),
    ):
        with sqlite3.connect(tmp_path / f"{name}.db") as connection:
            connection.executescript(script)
        connection.close()
    assert sorted((r.id, r.name) for r in read_sqlite(spark, str(tmp_path)).collect()) == [(1, "x"), (2, "y")]
    with sqlite3.connect(tmp_path / "c.db") as connection:
        connection.executescript("CREATE TABLE people (id INT, name TEXT, city TEXT); INSERT INTO people VALUES (3, 'z', 'q');")
    connection.close()
    with pytest.raises(Exception, match="city"):
        read_sqlite(spark, str(tmp_path)).collect()


def test_types_of_many_columns_take_one_job(spark):
    def jobs(number):
        group = f"types {number}"
        spark.sparkContext.setJobGroup(group, group)
        wide = spark.range(20).select(*[(F.col("id") + i).cast("string").alias(f"c{i}") for i in range(number)])
        assert dict(type_text_columns(wide).dtypes)[f"c{number - 1}"] == "bigint"
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(3), jobs(300)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many == few


def test_files_by_value_are_written_without_a_sort(spark, tmp_path):
    from tableprobe.testing import write_split

    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write_split(spark.range(1000).selectExpr("id % 7 AS k", "id"), "k", f"{tmp_path}/t")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plan = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    assert "InsertIntoHadoopFsRelation" in plan and "Sort" not in plan
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == setting
    got = spark.read.parquet(f"{tmp_path}/t")
    assert len(got.inputFiles()) == 7 and got.count() == 1000


def test_parts_become_one_file_in_their_order(spark, tmp_path):
    from tableprobe.testing import join_files

    spark.range(999, -1, -1).selectExpr("cast(id as string)", "id AS n").repartitionByRange(5, "n").sortWithinPartitions("n").select("id").write.text(f"{tmp_path}/parts")
    size = join_files(spark, f"{tmp_path}/parts", f"{tmp_path}/one/a.txt")
    assert (tmp_path / "one/a.txt").read_text() == "".join(f"{i}\n" for i in range(1000))
    assert size == (tmp_path / "one/a.txt").stat().st_size


def test_lines_are_not_sorted_to_find_headers(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id AS string) AS t").write.csv(f"{tmp_path}/c", header=True)
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsList().size()
    assert read_csv(spark, f"{tmp_path}/c").count() == 1000
    bus.waitUntilEmpty(30_000)
    found = store.executionsList()
    plans = [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]
    partial = r"\(\d+\) (\w+)[^\n]*\nInput[^\n]*\nKeys[^\n]*\nFunctions[^\n]*\[partial_min_by"
    assert {kind for plan in plans for kind in re.findall(partial, plan)} == {"ObjectHashAggregate"}


def test_query_of_files_names_tables_in_folders(spark, tmp_path):
    import __spark_entry__ as catalog

    spark.range(4).repartition(2).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "region.parquet")
    next((tmp_path / "parts").glob("_SUCCESS")).unlink()
    found = catalog.queries()["classified_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("orders", "parquet"), ("region", "parquet")]
