"""Profiles from sketches: exact where they are said to be, near elsewhere, in one scan, and the same from merged parts."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableprobe import profile
from tableprobe.operators.sketches import merge, sketch
from tableprobe.operators.stats import profile_of_parts

EXACT = ["data_type", "total_rows", "non_null_count", "null_count", "min_value", "max_value", "min_length", "max_length", "avg_length", "earliest_date", "latest_date", "date_range_days"]


def near(approximate, exact, rows):
    """Whether the figures agree: exact ones to the digit, ranks and distinct counts within their bounds."""
    for a, e in zip(approximate, exact):
        a, e = a.asDict(), e.asDict()
        assert {k: a[k] for k in EXACT} == {k: e[k] for k in EXACT}, a["column_name"]
        for key in ("mean", "std_dev"):
            assert a[key] == (None if e[key] is None else pytest.approx(e[key], rel=1e-6, abs=0.011)), (a["column_name"], key)
        assert abs(a["unique_count"] - e["unique_count"]) <= 0.04 * e["unique_count"] + 1, a["column_name"]
        if e["outlier_count"] is not None:
            assert abs(a["outlier_count"] - e["outlier_count"]) <= 0.04 * rows + 1


@pytest.fixture
def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (i, float(i) if i % 7 else nan, Decimal(i) / 100, str(i % 50), f"text {i % 11}" if i % 3 else None, dt.date(2020, 1, 1) + dt.timedelta(days=i % 40),
         dt.datetime(2020, 1, 1, 0, 0, i % 60), i % 2 == 0, None, [i % 3], f"{i}.5" if i % 2 else "-3", b"x")
        for i in range(500)
    ]
    return spark.createDataFrame(rows, "i long, x double, d decimal(12,2), n string, s string, day date, t timestamp_ntz, b boolean, v string, l array<int>, f string, raw binary")


def test_sketched_profile_is_near_the_exact_one(spark, odd):
    near(profile(odd, exact=False).collect(), profile(odd).collect(), 500)


def test_quartiles_by_rank(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"), (F.col("id") % 10).cast("string").alias("t"))
    got = profile(df, exact=False).collect()
    values = [r.x for r in df.select("x").collect()]
    assert abs(sum(v <= got[0].median for v in values) / 100_000 - 0.5) < 0.02
    assert got[1].median in (4.0, 5.0) and got[1].data_type == "string"


def test_one_scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert sketch(lines)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_parts_add_up_to_the_whole(spark, odd, saved, tmp_path):
    table = saved(odd.repartition(5), files=5)
    sketch(table, by=[F.col("_metadata.file_path").alias("file")]).write.parquet(f"{tmp_path}/parts")
    parts = spark.read.parquet(f"{tmp_path}/parts")
    assert parts.count() == 5
    merged = profile_of_parts(parts, table).collect()
    near(merged, profile(table).collect(), 500)
    # parts of merged parts
    twice = merge(parts, table.columns)
    near(profile_of_parts(twice, table).collect(), profile(table).collect(), 500)


def test_tables_without_values(spark):
    empty = spark.createDataFrame([], "a long, s string, d date")
    for r in profile(empty, exact=False).collect():
        assert (r.total_rows, r.unique_count, r.median, r.mean) == (0, 0, None, None)
    nulls = spark.createDataFrame([(None, None), (None, None)], "a double, s string")
    assert [(r.total_rows, r.null_count, r.unique_count) for r in profile(nulls, exact=False).collect()] == [(2, 2, 0)] * 2
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    assert profile(nan, exact=False).first().asDict() | {"unique_percentage": 0} == profile(nan).first().asDict() | {"unique_percentage": 0}
    infinite = spark.createDataFrame([(float("inf"),), (1.0,), (-float("inf"),)], "a double")
    assert profile(infinite, exact=False).first().total_rows == 3
