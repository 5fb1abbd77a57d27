import datetime as dt
import json
import math
import sys

import pytest
from pyspark.sql import functions as F

from tableprobe import ExportError, Filter, SheetLimitError, export
from tableprobe.operators import sheet
from tableprobe.plans import count_export, output_name, resolve_format, write_table
from tableprobe.sources import read_csv, read_tsv
from tableprobe.streaming import keep_current, latest, live_profile, live_value_counts, read_arriving


def lines(path, spark):
    return [r[0] for r in spark.read.text(path).collect()]


@pytest.fixture
def table(spark, saved):
    rows = [
        (1, "a,b", 1.5, True, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2), b"\xff\x00", [1, 2]),
        (2, " x ", math.inf, False, None, None, None, None),
        (None, None, None, None, dt.datetime(2024, 1, 1), None, b"", []),
    ]
    return saved(spark.createDataFrame(rows, "i bigint, s string, f double, o boolean, t timestamp_ntz, d date, b binary, l array<int>"))


def test_csv(spark, table, tmp_path):
    got = lines(export(table, f"{tmp_path}/o", "csv"), spark)
    assert got == [
        "i,s,f,o,t,d,b,l",
        '1,"a,b",1.5,true,2024-01-02T03:04:05.000000,2024-01-02,ff00,"[1,2]"',
        "2, x ,inf,false,,,,",
        ",,,,2024-01-01T00:00:00.000000,,,[]",
    ]


def test_tsv_and_quotes_come_back(spark, tmp_path):
    texts = ['say "hi"', "tab\there", "line\nbreak", "back\\slash", "comma,", "#hash", "'", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for fmt, read in (("csv", read_csv), ("tsv", read_tsv)):
        path = export(df, f"{tmp_path}/{fmt}", fmt)
        assert [r.t for r in read(spark, path).orderBy("i").collect()] == texts
        assert count_export(spark, path, fmt).first().rows == len(texts)


def test_single_column_keeps_its_blank_rows(spark, tmp_path):
    path = export(spark.createDataFrame([("a",), (None,), ("b",)], "t string").coalesce(1), f"{tmp_path}/o", "csv")
    assert lines(path, spark) == ["t", "a", '""', "b"]
    assert count_export(spark, path, "csv").first().rows == 3


def test_jsonl(spark, table, tmp_path):
    got = [json.loads(x) for x in lines(export(table, f"{tmp_path}/o", "jsonl"), spark)]
    assert got[0] == {"i": 1, "s": "a,b", "f": 1.5, "o": True, "t": "2024-01-02 03:04:05.000000", "d": "2024-01-02", "b": "ff00", "l": [1, 2]}
    assert got[1]["f"] is None and list(got[1]) == list(got[0])


def test_parquet_keeps_types(spark, table, tmp_path):
    back = spark.read.parquet(export(table, f"{tmp_path}/o", "parquet"))
    assert back.schema == table.schema and back.count() == 3


def test_sorted_export_keeps_the_order_of_the_grid(spark, saved, tmp_path):
    df = saved(spark.range(500).select("id", (F.col("id") * 37 % 100).alias("k")), files=3)
    path = export(df, f"{tmp_path}/o", "parquet", sort_by="k", ascending=False)
    back = spark.read.parquet(path)
    assert back.columns == ["id", "k"]
    files = sorted(r[0] for r in back.select("_metadata.file_path").distinct().collect())
    got = [r.k for f in files for r in back.filter(F.col("_metadata.file_path") == f).orderBy("_metadata.row_index").collect()]
    assert got == sorted(got, reverse=True) and len(got) == 500


def test_filtered_export_covers_the_whole_table(spark, saved, tmp_path):
    df = saved(spark.range(2000))
    path = export(df, f"{tmp_path}/o", "jsonl", filters=[Filter("id", "1000", "number", ">=")])
    assert count_export(spark, path, "jsonl").first().rows == 1000


def test_sheet_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sys.modules["tableprobe.plans.export"], "MAX_ROWS", 101)
    monkeypatch.setattr(sheet, "MAX_ROWS", 101)
    df = spark.range(250).coalesce(1).select("id", F.col("id").alias("ID"))
    path = export(df, f"{tmp_path}/o", "xlsx")
    per_file = spark.read.csv(path, header=True).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in per_file) == [50, 100, 100]
    with pytest.raises(SheetLimitError):
        export(df, f"{tmp_path}/p", "xlsx", one_sheet=True)


def test_formats_and_names():
    assert resolve_format("original", "csv") == "csv"
    for fmt, source in (("original", "sqlite"), ("original", None), ("pdf", "csv")):
        with pytest.raises(ExportError):
            resolve_format(fmt, source)
    assert output_name("data.parquet", "csv") == "data.csv"
    assert output_name("data.parquet", "original", filtered=True) == "data_filtered.parquet"
    assert output_name("book.v2.xlsx", "xlsx", "Sales 2024") == "book.v2_sales_2024.xlsx"
    assert output_name("shop.db", "jsonl", "Zoo!", True) == "shop_zoo_filtered.jsonl"


def test_existing_folders_are_not_overwritten(spark, tmp_path):
    write_table(spark.range(1), f"{tmp_path}/o", "csv")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        write_table(spark.range(1), f"{tmp_path}/o", "csv")


def test_live_results_follow_arriving_files(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(rows):
        spark.createDataFrame(rows, "k string, x double").coalesce(1).write.mode("append").parquet(source)

    def settle(result, name):
        query = keep_current(result, f"{out}/{name}", f"{out}/{name}_checkpoint", available_now=True)
        query.awaitTermination()
        return latest(spark, f"{out}/{name}")

    arrive([("a", 1.0), ("b", 2.0), (None, float("nan"))])
    stream = read_arriving(spark, source, spark.read.parquet(source).schema)
    counts = lambda: {r.value: r["count"] for r in settle(live_value_counts(stream, "k"), "counts").collect()}
    assert counts() == {"a": 1, "b": 1, "(null)": 1}
    arrive([("a", 5.0)])
    assert counts() == {"a": 2, "b": 1, "(null)": 1}
    got = {r.column_name: r for r in settle(live_profile(stream), "profile").collect()}
    assert (got["x"].total_rows, got["x"].min_value, got["x"].max_value, got["x"].mean) == (4, 1.0, 5.0, None)
    assert (got["k"].null_count, got["k"].unique_estimate, got["k"].mean) == (1, 2, None)
