import datetime as dt
import importlib
import math
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe import ColumnNotFoundError, column_stats, profile, value_counts
from tableprobe.operators import quantiles, stats
from tableprobe.operators.melt import melt


def one(df, name, **options):
    return column_stats(df, name, **options).first()


def exact_ranks(df, name, ranks):
    groups = melt(df, {0: name})
    valid = df.filter(F.col(name).isNotNull() & ~F.coalesce(F.isnan(F.col(name).cast("double")), F.lit(False)))
    count, low, high = valid.agg(F.count(name), F.min(name), F.max(name)).first()
    return quantiles.order_statistics(df, groups, {0: (count, low, high)}, {0: ranks(count)})[0], count


SHAPES = {
    "uniform": lambda r: r.random() * 1e5,
    "normal": lambda r: r.gauss(0, 1),
    "heavy_tail": lambda r: math.exp(r.gauss(0, 60)) * r.choice((-1, 1)),
    "one_hot_value": lambda r: 7.25 if r.random() < 0.6 else r.random() * 1e9,
    "tiny_and_huge": lambda r: r.choice((1e-300, 1e300, -1e300, 0.0, 5e-324)) * r.random(),
    "far_from_zero": lambda r: 1e15 + r.random(),
    "infinite": lambda r: r.choice((math.inf, -math.inf, 0.0)) if r.random() < 0.2 else r.gauss(0, 1e6),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_order_statistics_of_floats(spark, saved, monkeypatch, shape):
    monkeypatch.setattr(quantiles, "LISTED_ROWS", 8)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    r = random.Random(7)
    values = [SHAPES[shape](r) for _ in range(600)]
    df = saved(spark.createDataFrame([(v,) for v in values + [None, math.nan]], "x double"))
    wanted = [0, 1, 149, 150, 299, 300, 450, 598, 599]
    found, _ = exact_ranks(df, "x", lambda n: wanted)
    ordered = sorted(values)
    assert found == {k: ordered[k] for k in wanted}


@pytest.mark.parametrize("values", [
    [2**63 - 1 - i * i for i in range(300)] + [-(2**63) + i for i in range(300)],
    [2**62 + i % 17 for i in range(600)],
    [i % 3 for i in range(600)],
])
def test_order_statistics_of_integers(spark, saved, monkeypatch, values):
    monkeypatch.setattr(quantiles, "LISTED_ROWS", 8)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    df = saved(spark.createDataFrame([(v,) for v in values], "x bigint"))
    wanted = [0, 100, 299, 300, 301, 599]
    found, _ = exact_ranks(df, "x", lambda n: wanted)
    assert found == {k: sorted(values)[k] for k in wanted}


def test_order_statistics_of_wide_decimals(spark, saved, monkeypatch):
    monkeypatch.setattr(quantiles, "LISTED_ROWS", 4)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    values = [Decimal(2**63 + i * 3) for i in range(100)]
    df = saved(spark.createDataFrame([(v,) for v in values], "x decimal(20,0)"))
    found, _ = exact_ranks(df, "x", lambda n: [0, 50, 99])
    assert found == {0: values[0], 50: values[50], 99: values[99]}


def test_numbers(spark, saved):
    r = random.Random(3)
    values = [round(r.gauss(50, 20), 3) for _ in range(500)] + [999.0, -999.0]
    df = saved(spark.createDataFrame([(v,) for v in values + [None] * 8], "x double"))
    s = one(df, "x")
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = sum(v < low or v > high for v in values)
    assert (s.data_type, s.total_rows, s.non_null_count, s.null_count) == ("float", 510, 502, 8)
    assert (s.null_percentage, s.non_null_percentage) == (1.6, 98.4)
    assert (s.min_value, s.max_value, s.mean) == (-999.0, 999.0, round(statistics.fmean(values), 2))
    assert (s.median, s.std_dev) == (round(q2, 2), round(statistics.pstdev(values), 2))
    assert (s.outlier_lower_bound, s.outlier_upper_bound) == (round(low, 2), round(high, 2))
    assert (s.outlier_count, s.outlier_percentage) == (outside, round(outside / 502 * 100, 1))
    assert s.unique_count == len(set(values)) and s.most_common_value is None


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,), (math.nan,)], "x double")
    s = one(df, "x")
    assert (s.min_value, s.max_value, s.median, s.mean, s.std_dev) == (1.0, 3.0, 2.0, None, None)
    assert (s.unique_count, s.non_null_count, s.outlier_count) == (3, 4, 0)
    s = one(spark.createDataFrame([(1.0,), (math.inf,)], "x double"), "x")
    assert (s.min_value, s.max_value, s.mean) == (1.0, None, None)


def test_single_value_and_all_nan(spark):
    s = one(spark.createDataFrame([(5,)], "x int"), "x")
    assert (s.std_dev, s.median, s.mean, s.outlier_count) == (0.0, 5.0, 5.0, 0)
    s = one(spark.createDataFrame([(math.nan,)], "x double"), "x")
    assert (s.min_value, s.median, s.unique_count) == (None, None, 1)


def test_numbers_written_as_text_stay_text(spark):
    df = spark.createDataFrame([("1", "00501", "Inf"), ("10", "01234", "1"), ("2", "90210", "2")], "qty string, zip string, v string")
    s = one(df, "qty")
    assert (s.data_type, s.min_value, s.max_value, s.mean, s.median) == ("string", 1.0, 10.0, 4.33, 2.0)
    assert (s.max_length, s.most_common_value) == (2, "1")
    assert one(df, "zip").min_value == 501.0
    s = one(df, "v")
    assert (s.data_type, s.min_value, s.max_value) == ("string", 1.0, None)


def test_texts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("żółw",), ("a",), ("b",), (None,)], "t string")
    s = one(df, "t")
    assert (s.most_common_value, s.most_common_count, s.unique_count, s.unique_percentage) == ("a", 2, 3, 50.0)
    assert (s.min_length, s.max_length, s.avg_length) == (1, 4, 1.6)


@pytest.mark.parametrize("texts", [
    ["x" * 500, "x" * 500, "a"],
    ["y" * 500, "b" * 300, "y" * 500, "b" * 300, "c"],
    ["z" * 400, "b" * 200],
    ["z" * 400, "z" * 400, "b", "b"],
])
def test_most_common_of_long_texts(spark, texts):
    s = one(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    top = max(texts.count(t) for t in texts)
    assert (s.most_common_value, s.most_common_count) == (min(t for t in texts if texts.count(t) == top), top)
    assert s.unique_count == len(set(texts))


def test_dates_span_whole_days(spark):
    late = dt.datetime(2024, 1, 1, 23, 30)
    df = spark.createDataFrame([(late, late.date()), (late + dt.timedelta(hours=23), dt.date(2024, 3, 1))], "t timestamp_ntz, d date")
    s = one(df, "t")
    assert (s.earliest_date, s.latest_date, s.date_range_days) == ("2024-01-01 23:30:00", "2024-01-02 22:30:00", 0)
    s = one(df, "d")
    assert (s.data_type, s.earliest_date, s.latest_date, s.date_range_days) == ("date", "2024-01-01", "2024-03-01", 60)


def test_other_types_have_basic_statistics(spark):
    df = spark.sql("SELECT * FROM VALUES (true, array(1,2), map('a',1), X'00', CAST(NULL AS VOID)), (false, array(1,2), NULL, X'01', NULL) t(b, l, m, x, n)")
    got = {r.column_name: r for r in profile(df).collect()}
    assert [(r.data_type, r.unique_count, r.null_count) for r in got.values()] == [("boolean", 2, 0), ("list", 1, 0), ("map<string,int>", 1, 1), ("binary", 2, 0), ("string", 0, 2)]
    assert got["b"].min_value is None and got["n"].max_length is None


def test_empty_table_and_unknown_column(spark):
    s = one(spark.createDataFrame([], "a int, b string"), "a")
    assert (s.total_rows, s.null_count, s.null_percentage, s.non_null_percentage, s.unique_count, s.mean) == (0, 0, 0.0, 0.0, 0, None)
    with pytest.raises(ColumnNotFoundError):
        column_stats(spark.range(1), "nope")


def test_profile_equals_single_columns(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    whole = profile(events).collect()
    assert [r.column_name for r in whole] == events.columns
    assert whole == [one(events, c) for c in events.columns]


def test_profile_in_chunks(spark, sf, monkeypatch):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    whole = profile(orders).collect()
    monkeypatch.setattr(stats, "COLUMNS_PER_JOB", 2)
    assert profile(orders).collect() == whole


def test_sketched_statistics_are_near(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact, near = one(lineitem, "l_extendedprice"), one(lineitem, "l_extendedprice", exact=False)
    assert abs(exact.median - near.median) < exact.median * 0.01 and exact.mean == near.mean
    assert abs(exact.unique_count - near.unique_count) < exact.unique_count * 0.05


def test_value_counts_merge_nulls_with_their_token(spark, saved):
    df = saved(spark.createDataFrame([("b",), (None,), ("a",), ("(null)",), ("a",), ("",)], "t string"))
    rows = value_counts(df, "t").collect()
    assert [(r.value, r["count"], r.pct, r.total_unique) for r in rows] == [("(null)", 2, 33.33, 4), ("a", 2, 33.33, 4), ("b", 1, 16.67, 4), ("", 1, 16.67, 4)]
    assert [r.value for r in value_counts(df, "t", 2, tie="value").collect()] == ["(null)", "a"]
    assert value_counts(df, "t", 0, display=True).collect()[-1].value == "(empty)"
    assert value_counts(df, "t", 1).first().total_unique == 4


def test_value_counts_of_numbers_are_texts(spark, saved):
    df = saved(spark.createDataFrame([(1.0,), (0.5,), (1.0,), (None,), (1e20,), (1e-7,), (math.nan,), (-math.inf,)], "x double"))
    assert [r.value for r in value_counts(df, "x").collect()] == ["1", "0.5", "(null)", "1e+20", "1e-7", "nan", "-inf"]
    assert sum(r["count"] for r in value_counts(df, "x", 0).collect()) == 8
    with pytest.raises(ColumnNotFoundError):
        value_counts(df, "nope")


def test_value_counts_of_long_texts(spark, saved):
    texts = ["x" * 300, "b", "x" * 300, None, "y" * 200, "b", "x" * 300, "(null)"]
    df = saved(spark.createDataFrame([(t,) for t in texts], "t string"), files=3)
    for limit in (0, 2, 100):
        assert value_counts(df, "t", limit, long_texts=True).collect() == value_counts(df, "t", limit).collect()


def test_hot_values_are_counted_before_the_shuffle(spark, saved):
    df = saved(spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('v', id)) AS t"))
    frame = value_counts(df, "t", 1)
    assert frame.collect()[0] == ("hot", 1000, 33.33, 2001)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "ReusedExchange" in plan


@pytest.mark.parametrize("tie", ["first_seen", "value"])
@pytest.mark.parametrize("buckets", [3, 64, 1 << 16])
def test_top_values_are_those_of_the_full_count(spark, saved, monkeypatch, tie, buckets):
    from tableprobe.operators import top_values, value_counts as vc

    monkeypatch.setattr(importlib.import_module("tableprobe.operators.value_counts"), "_BUCKETS", buckets)
    value = F.when(F.col("id") % 4 == 0, F.lit("hot")).when(F.col("id") % 9 == 1, None).when(F.col("id") % 50 < 9, (F.col("id") % 50).cast("string")).otherwise(F.col("id").cast("string"))
    df = saved(spark.range(2000).select("id", value.alias("v"), (F.col("id") * 31 % 700).alias("n"), F.lit(1.5).alias("one")))
    for name, limit in (("v", 1), ("v", 6), ("v", 40), ("n", 10), ("one", 3), ("id", 5)):
        full = [tuple(r)[:3] for r in vc(df, name, limit, tie=tie).collect()]
        assert [tuple(r) for r in top_values(df, name, limit, tie=tie).collect()] == full, (name, limit)
    assert top_values(df.limit(0) if tie == "value" else saved(df.filter("id < 0")), "v", 5, tie=tie).collect() == []


def test_only_values_of_full_buckets_are_counted(spark, saved):
    from tableprobe.operators import top_values

    value = F.when(F.col("id") % 3 == 0, F.col("id") % 15).otherwise(F.col("id"))
    df = saved(spark.range(200_000).select(value.alias("v")))
    top = top_values(df, "v", 5, tie="value")
    assert "LeftSemi" in top._jdf.queryExecution().optimizedPlan().toString()
    counted = df.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 16)).isin([r.b for r in df.filter("v < 15").select(F.pmod(F.xxhash64("v"), F.lit(1 << 16)).alias("b")).distinct().collect()]))
    assert counted.select("v").distinct().count() < 400 and [r["count"] for r in top.collect()][0] >= 13_333
