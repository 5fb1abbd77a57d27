"""Parquet folders: footers as a catalogue, layouts merged by column name, row numbers without reading rows."""

import datetime as dt
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tableprobe import Explorer, TableProbeError, page, with_row_index
from tableprobe.operators import row_index as ri
from tableprobe.sources import parquet_catalogue, read_parquet


@pytest.fixture
def folder(tmp_path):
    def make(**files):
        path = f"{tmp_path}/odd [a] b%c"
        os.makedirs(path, exist_ok=True)
        for name, columns in files.items():
            pq.write_table(pa.table(columns), f"{path}/{name}.parquet", row_group_size=2)
        return path

    return make


def escaped(path):
    return path.replace("[", "\\[").replace("]", "\\]")


def rows(df, order="a"):
    return [tuple(r) for r in df.orderBy(order).collect()]


def test_columns_of_all_files(spark, folder):
    path = escaped(folder(f1={"a": [1, 2]}, f2={"b": ["x"], "a": [3]}, f3={"a": [4], "c": [1.5]}))
    assert rows(read_parquet(spark, path)) == [(1, None, None), (2, None, None), (3, "x", None), (4, None, 1.5)]
    numbered = read_parquet(spark, path, row_index=True)
    assert [r.row_index for r in numbered.orderBy("a").collect()] == [1, 2, 3, 4]
    # one scan
    assert read_parquet(spark, path)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_null_and_narrower_columns_take_the_type_of_the_others(spark, folder):
    nanos = pa.array([1_000_000_001], pa.timestamp("ns"))
    path = escaped(
        folder(
            f1={"a": pa.array([1, 2], pa.int16()), "b": pa.array([None, None], pa.null()), "t": pa.array([dt.datetime(2020, 1, 1)] * 2)},
            f2={"a": pa.array([3], pa.int64()), "b": ["x"], "t": nanos},
            f3={"a": pa.array([4.5], pa.float32()), "b": pa.array([None], pa.null()), "t": nanos},
        )
    )
    got = read_parquet(spark, path, row_index=True)
    assert dict(got.dtypes)["b"] == "string" and dict(got.dtypes)["t"] == "timestamp_ntz" and dict(got.dtypes)["a"] in ("double", "float")
    assert [(float(r.a), r.b, r.row_index) for r in got.orderBy("a").collect()] == [(1, None, 1), (2, None, 2), (3, "x", 3), (4.5, None, 4)]
    assert [r.t for r in got.orderBy("a").collect()][2] == dt.datetime(1970, 1, 1, 0, 0, 1)
    table = Explorer(spark, path, kind="parquet")
    assert [r.row_index for r in table.page(sort_by="a", ascending=False, limit=2).collect()] == [4, 3]
    assert [r.row_index for r in table.page(offset=1, limit=2).collect()] == [2, 3]


def test_only_null_columns_are_text(spark, folder):
    path = escaped(folder(f1={"a": [1], "n": pa.array([None], pa.null())}, f2={"a": [2], "n": pa.array([None], pa.null()), "c": ["x"]}))
    got = read_parquet(spark, path)
    assert dict(got.dtypes)["n"] == "string" and rows(got) == [(1, None, None), (2, None, "x")]


def test_types_that_differ_are_refused(spark, folder):
    with pytest.raises(TableProbeError, match="a is bigint in .*f1.parquet and string in .*f2.parquet"):
        read_parquet(spark, escaped(folder(f1={"a": [1]}, f2={"a": ["x"]})))


def test_folder_names_stay_columns(spark, tmp_path):
    for k, columns in (("x", {"a": [1]}), ("y", {"a": [2], "n": pa.array([None], pa.null())})):
        os.makedirs(f"{tmp_path}/t/k={k}")
        pq.write_table(pa.table(columns), f"{tmp_path}/t/k={k}/f.parquet")
    assert rows(read_parquet(spark, f"{tmp_path}/t")) == [(1, None, "x"), (2, None, "y")]


def test_too_many_layouts(spark, folder, monkeypatch):
    from tableprobe.sources import tables

    monkeypatch.setattr(tables, "MAX_LAYOUTS", 2)
    with pytest.raises(TableProbeError, match="layouts"):
        read_parquet(spark, escaped(folder(f1={"a": [1]}, f2={"b": [1]}, f3={"c": [1]})))


def test_catalogue(spark, folder):
    path = folder(
        f1={"a": [3, 1, None, 7, None, None], "s": ["b", "é", "a", None, None, None], "d": [dt.date(2020, 1, d) for d in (1, 2, 3, 4, 5, 6)], "x": [{"y": i} for i in range(6)]},
        f2={"a": pa.array([], pa.int64())},
    )
    found = {os.path.basename(r.path): r for r in parquet_catalogue(spark, escaped(path)).collect()}
    assert [(found[f].rows, found[f].row_groups) for f in sorted(found)] == [(6, 3), (0, 1)]  # the writer gives an empty file one group
    columns = {c.name: (c.nulls, c.low, c.high) for c in found["f1.parquet"].columns}
    assert columns == {"a": (3, "1", "7"), "s": (3, "a", "é"), "d": (0, "2020-01-01", "2020-01-06"), "x.y": (0, "0", "5")}
    assert found["f1.parquet"].size == os.path.getsize(f"{path}/f1.parquet")


def test_row_offsets_come_from_footers(spark, saved, tmp_path):
    df = saved(spark.range(100), files=5)
    files = ri.source_files(df)
    plan = ri.file_offsets(spark, files)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "FileScan parquet" not in plan
    offsets = {r.__getitem__(0): (r.rows, r[2]) for r in ri.file_offsets(spark, files).collect()}
    assert sum(n for n, _ in offsets.values()) == 100 and len(offsets) == 5
    numbered = with_row_index(df.filter("id % 7 = 0"))
    assert numbered.count() == 15


def test_stores_without_footers_are_counted(spark, saved, monkeypatch):
    monkeypatch.setattr(ri, "reachable", lambda path: False)
    df = saved(spark.range(100), files=5)
    assert sorted(r.row_index for r in with_row_index(df).collect()) == list(range(1, 101))
    assert [r.row_index for r in page(df, offset=95, limit=10, whole_table=True).collect()] == list(range(96, 101))


def test_an_explorer_reads_the_footers_once(spark, saved, monkeypatch):
    df = saved(spark.range(1000).withColumn("v", F.col("id") % 3), files=6)
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    table = Explorer(spark, folder, kind="parquet")

    def never(*_):
        raise AssertionError("read again")

    monkeypatch.setattr(ri, "footers_of", never)
    assert table.catalogue().agg(F.sum("rows")).first()[0] == 1000
    assert [r.row_index for r in table.page(offset=995).collect()] == list(range(996, 1001))
    assert table.page(sort_by="v", ascending=False, limit=5).count() == 5
    assert table.totals().first().total_rows == 1000


@pytest.mark.parametrize("ascending", [True, False])
def test_pages_of_a_sorted_copy(spark, saved, monkeypatch, ascending):
    from tableprobe.plans import explore

    monkeypatch.setattr(explore, "SORTED_FILE_ROWS", 100)
    values = F.when(F.col("id") % 10 == 3, None).when(F.col("id") % 11 == 4, float("nan")).otherwise((F.col("id") * 7919 % 300).cast("double"))
    df = saved(spark.range(2000).select("id", values.alias("v"), F.lit("x").alias("__f")), files=3)
    table = Explorer(spark, df.inputFiles()[0].rsplit("/", 1)[0], kind="parquet")
    staged = table.stage(sort_by="v", ascending=ascending)
    for offset, limit in ((0, 7), (995, 10), (1500, 250), (1995, 10), (2000, 5)):
        plain = table.page(sort_by="v", ascending=ascending, offset=offset, limit=limit, position="p").collect()
        got = staged.page(sort_by="v", ascending=ascending, offset=offset, limit=limit, position="p").collect()
        assert [(r.id, r.row_index, r.p) for r in got] == [(r.id, r.row_index, r.p) for r in plain]
    assert [r.row_index for r in staged.page_json((), "v", ascending, 995, 3).collect()] == [r.row_index for r in table.page(sort_by="v", ascending=ascending, offset=995, limit=3).collect()]
    # at most two files of 100 rows hold a page, and no others are opened
    rows = staged.page(sort_by="v", ascending=ascending, offset=995, limit=50)
    named = set(re.findall(r"part-[0-9]+[^ ,)]*parquet", rows._jdf.queryExecution().optimizedPlan().toString()))
    assert 1 <= len(named) <= 2 and len(staged._orders["v", ascending][0].inputFiles()) > 19
    # other orders, filters and plain pages are served as before
    assert staged.page(sort_by="v", ascending=not ascending, limit=5).count() == 5
    assert [r.id for r in staged.page({"id": {"type": "number", "value": "77"}}, sort_by="v").collect()] == [77]
    assert [r.row_index for r in staged.page(offset=10, limit=3).collect()] == [11, 12, 13]
    with pytest.raises(TableProbeError):
        table.stage(sort_by="nope")
