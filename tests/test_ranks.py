"""Deep pages: the row at a rank is that of the sorted table, for every type, direction and depth."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableprobe import Explorer, Filter, page
from tableprobe.operators import paging, ranks

NAN, INF = float("nan"), float("inf")


def texts(rnd):
    stem = "a long stem that all of them share, "
    pool = [stem + c for c in ["", "\0", "\0\0", "a", "a\0", "b" * 9, "ä", "日本", "𝄞", "z" * 40, "Z"]] + [stem + f"{rnd.randrange(10**9)}" for _ in range(60)] + ["", "b"]
    return lambda: rnd.choice(pool)


MAKERS = {
    "bigint": lambda rnd: lambda: rnd.choice([rnd.randrange(-(2**63), 2**63), rnd.randrange(50), 2**53 + rnd.randrange(9), -(2**63), 2**63 - 1]),
    "tinyint": lambda rnd: lambda: rnd.randrange(-128, 128),
    "double": lambda rnd: lambda: rnd.choice([rnd.uniform(-1, 1), rnd.uniform(-1, 1) * 10 ** rnd.randrange(-300, 300), 0.0, -0.0, INF, -INF, NAN, 5e-324, 1e-323, 1.7976931348623157e308]),
    "float": lambda rnd: lambda: rnd.choice([float(rnd.randrange(-9, 9)), 0.1, 3.4e38, INF, NAN]),
    "decimal(38,10)": lambda rnd: lambda: Decimal(rnd.randrange(-(10**28), 10**28)) / 10**rnd.randrange(11),
    "string": texts,
    "binary": lambda rnd: lambda: bytes(rnd.choice([0, 0, 1, 255]) for _ in range(rnd.randrange(9))),
    "boolean": lambda rnd: lambda: rnd.random() < 0.5,
    "date": lambda rnd: lambda: dt.date(1, 1, 1) + dt.timedelta(days=rnd.choice([rnd.randrange(3_000_000), 700_000 + rnd.randrange(4)])),
    "timestamp": lambda rnd: lambda: dt.datetime(2000, 1, 1) + dt.timedelta(microseconds=rnd.choice([rnd.randrange(10**16), rnd.randrange(5)])),
    "timestamp_ntz": lambda rnd: lambda: dt.datetime(1700, 1, 1) + dt.timedelta(microseconds=rnd.choice([rnd.randrange(10**16), rnd.randrange(5)])),
    "time": lambda rnd: lambda: dt.time(rnd.randrange(24), rnd.randrange(60), 0, rnd.choice([0, 1, 500_000])),
}


@pytest.mark.parametrize("kind", MAKERS)
def test_deep_pages_are_those_of_the_sorted_table(spark, saved, monkeypatch, kind):
    rnd = random.Random(kind)
    make = MAKERS[kind](rnd)
    df = saved(spark.createDataFrame([(i, None if rnd.random() < 0.1 else make()) for i in range(400)], f"id int, v {kind}"), files=3)
    for ascending in (True, False):
        monkeypatch.setattr(paging, "DEEP_ROWS", 10**9)
        order = [r.id for r in page(df, sort_by="v", ascending=ascending, limit=1000, text_numbers=None).collect()]
        assert len(order) == 400
        monkeypatch.setattr(paging, "DEEP_ROWS", 1)
        monkeypatch.setattr(ranks, "BUCKETS", 7)
        monkeypatch.setattr(ranks, "LISTED", 5)
        for offset in (1, 150, 399, 500):
            got = page(df, sort_by="v", ascending=ascending, offset=offset, limit=20, text_numbers=None, position="position").collect()
            assert [r.id for r in got] == order[offset : offset + 20], (kind, ascending, offset)
            assert [r.position for r in got] == list(range(offset + 1, offset + 1 + len(got)))


def test_every_rank_of_a_column_with_ties(spark, saved, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", 3)
    monkeypatch.setattr(ranks, "LISTED", 2)
    monkeypatch.setattr(paging, "DEEP_ROWS", 1)
    values = [1.0, 2.0, NAN, None, 2.0, 2.0, NAN, None, 1.0, 3.0, 2.0]
    df = saved(spark.createDataFrame(list(enumerate(values)), "id int, v double"))
    for ascending, order in ((True, [0, 8, 1, 4, 5, 10, 9, 2, 6, 3, 7]), (False, [9, 1, 4, 5, 10, 0, 8, 2, 6, 3, 7])):
        for offset in range(1, 12):
            assert [r.id for r in page(df, sort_by="v", ascending=ascending, offset=offset, limit=2).collect()] == order[offset : offset + 2]


def test_deep_pages_of_filtered_rows_and_of_numbers_as_text(spark, saved, monkeypatch):
    monkeypatch.setattr(ranks, "LISTED", 10)
    df = saved(spark.range(3000).select("id", (F.col("id") * 7919 % 1000).cast("string").alias("t")), files=4)
    wanted = [Filter("id", "2000", "number", "<")]
    for deep, results in ((10**9, []), (1, None)):
        monkeypatch.setattr(paging, "DEEP_ROWS", deep)
        by_file = [r.id for r in page(df, wanted, offset=1500, limit=30).collect()]
        by_text = [r.id for r in page(df, wanted, "t", offset=1500, limit=30).collect()]
        if results is not None:
            expected = (by_file, by_text)
    assert (by_file, by_text) == expected and len(by_file) == len(by_text) == 30


def test_keys_without_buckets_keep_the_plain_path(spark, saved, monkeypatch):
    monkeypatch.setattr(paging, "DEEP_ROWS", 1)
    df = saved(spark.range(20).select("id", F.array(F.lit(20) - F.col("id")).alias("a")))
    assert [r.id for r in page(df, sort_by="a", offset=3, limit=3).collect()] == [16, 15, 14]


def test_no_step_of_a_deep_page_keeps_the_rows_before_it(spark, sf):
    lines = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/lineitem.parquet")
    rows = page(lines, sort_by="l_partkey", offset=40_000, limit=50)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan) == ["50"]
    # the scan can skip what lies before the page
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(l_partkey", plan), plan


def test_explorers_page_deep(spark, sf):
    table = Explorer(spark, f"{sf.replace('0.001', '0.01')}/lineitem.parquet")
    deep = table.page(sort_by="l_partkey", offset=30_000, limit=3).collect()
    known = table.rows.orderBy("l_partkey", "row_index").offset(30_000).limit(3).collect()
    assert [r.row_index for r in deep] == [r.row_index for r in known]
