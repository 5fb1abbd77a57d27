import pytest
from pyspark.sql import functions as F

from tableprobe import Filter, TableProbeError, page, page_totals, with_row_index
from tableprobe.operators import row_index as ri


def order(df, **options):
    return [r.id for r in page(df, **options).collect()]


@pytest.fixture
def mixed(spark, saved):
    nan = float("nan")
    rows = [(1, 2.0, "10"), (2, nan, "9"), (3, None, None), (4, 5.0, "2"), (5, 2.0, "1"), (6, None, "10"), (7, nan, "-3")]
    return saved(spark.createDataFrame(rows, "id int, x double, t string"))


def test_nulls_are_last_behind_nan_in_both_directions(mixed):
    assert order(mixed, sort_by="x") == [1, 5, 4, 2, 7, 3, 6]
    assert order(mixed, sort_by="x", ascending=False) == [4, 1, 5, 2, 7, 3, 6]


def test_numbers_as_text_sort_as_numbers(mixed):
    assert order(mixed, sort_by="t") == [7, 5, 4, 2, 1, 6, 3]
    assert order(mixed, sort_by="t", text_numbers=None) == [7, 5, 1, 6, 4, 2, 3]


def test_one_word_makes_it_text(spark, saved):
    df = saved(spark.createDataFrame([(1, "10"), (2, "9"), (3, "x")], "id int, t string"))
    assert order(df, sort_by="t") == [1, 2, 3]


def test_floats_as_text(spark, saved):
    df = saved(spark.createDataFrame([(1, "1e1"), (2, "+9.5"), (3, "-inf"), (4, "nan"), (5, ".5")], "id int, t string"))
    assert order(df, sort_by="t") == [3, 5, 2, 1, 4]


def test_unknown_sort_column_is_ignored(mixed):
    assert order(mixed, sort_by="nope") == [1, 2, 3, 4, 5, 6, 7]


def test_pages_of_a_sorted_table_join_up(mixed):
    whole = order(mixed, sort_by="x")
    parts = [order(mixed, sort_by="x", offset=o, limit=2) for o in range(0, 8, 2)]
    assert [i for p in parts for i in p] == whole
    assert order(mixed, sort_by="x", offset=7) == [] and order(mixed, offset=100) == []


@pytest.mark.parametrize("ascending", [True, False])
def test_keyset_continues_after_any_row(mixed, ascending):
    rows = page(mixed, sort_by="x", ascending=ascending).collect()
    for n, row in enumerate(rows):
        rest = page(mixed, sort_by="x", ascending=ascending, after=(row.x, row.row_index)).collect()
        assert [r.id for r in rest] == [r.id for r in rows[n + 1 :]]


def test_row_index_survives_filter_and_sort(mixed):
    got = page(mixed, [Filter("x", "2", "number")], sort_by="id", ascending=False, position="position").collect()
    assert [(r.id, r.row_index, r.position) for r in got] == [(5, 5, 1), (1, 1, 2)]


def test_totals(mixed):
    got = page_totals(mixed, [Filter("x", "1", "number", ">")], offset=0, limit=2).first()
    assert (got.total_rows, got.has_more) == (3, True)
    assert not page_totals(mixed, offset=5, limit=2).first().has_more


def test_negative_window_is_refused(mixed):
    with pytest.raises(TableProbeError):
        page(mixed, offset=-1)


def test_many_files_are_numbered_by_path(spark, saved):
    df = saved(spark.range(1000).withColumn("v", F.col("id") % 7), files=5)
    expected = {}
    for file in sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect()):
        inside = df.filter(F.col("_metadata.file_path") == file).orderBy("_metadata.row_index").collect()
        expected |= {r.id: len(expected) + 1 + n for n, r in enumerate(inside)}
    assert {r.id: r.row_index for r in with_row_index(df).collect()} == expected
    filtered = with_row_index(df.filter("v = 3"))
    assert {r.id: r.row_index for r in filtered.collect()} == {i: n for i, n in expected.items() if i % 7 == 3}
    assert [r.row_index for r in page(df, offset=395, limit=10).collect()] == list(range(396, 406))
    assert [r.row_index for r in page(df, offset=395, limit=10, whole_table=True).collect()] == list(range(396, 406))


def test_offsets_by_ranges_of_files(spark, saved, monkeypatch):
    monkeypatch.setattr(ri, "_FILES_PER_WINDOW", 2)
    df = saved(spark.range(100), files=7)
    assert sorted(r.row_index for r in with_row_index(df).collect()) == list(range(1, 101))


def test_offsets_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, saved, monkeypatch):
    monkeypatch.setattr(ri, "BROADCAST_BYTES", 0)
    df = saved(spark.range(100), files=4)
    numbered = with_row_index(df)
    assert sorted(r.row_index for r in numbered.collect()) == list(range(1, 101))


def test_plain_page_reads_only_its_files(spark, saved):
    df = saved(spark.range(1000), files=5)
    rows = page(df, offset=0, limit=10, whole_table=True)
    rows.collect()
    assert rows.filter(F.lit(True)).rdd.getNumPartitions() <= 1
    assert "file_path" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_text_rows_are_numbered_across_splits(spark, tmp_path):
    spark.range(5000).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("k")).coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = spark.read.csv(f"{tmp_path}/c", header=True)
        assert df.rdd.getNumPartitions() > 5
        got = with_row_index(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5000 and all(int(r.k) + 1 == r.row_index for r in got)


def test_frames_without_files_have_no_positions(spark):
    with pytest.raises(TableProbeError):
        with_row_index(spark.range(3).groupBy("id").count())


def test_sorted_page_is_one_top_k(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = page(orders, [Filter("o_totalprice", "100", "number", ">")], "o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "GreaterThan(o_totalprice,100.0)" in plan


def test_a_column_called_like_the_row_numbers_is_not_taken_for_them(spark, saved, tmp_path):
    from tableprobe import export

    df = saved(spark.range(3).withColumnRenamed("id", "row_index"))
    with pytest.raises(TableProbeError, match="of its own"):
        page(df, sort_by="row_index")
    assert spark.read.parquet(export(df, f"{tmp_path}/o", "parquet")).columns == ["row_index"]
    numbered = saved(with_row_index(saved(spark.range(5)).filter("id > 2")))
    assert [r.row_index for r in page(numbered).collect()] == [4, 5]


def test_pages_of_a_part_of_a_table_count_its_rows(spark, saved):
    part = saved(spark.range(100)).filter("id % 10 = 0")
    assert [r.id for r in page(part, offset=2, limit=3).collect()] == [20, 30, 40]
    assert [r.row_index for r in page(with_row_index(part), offset=2, limit=3).collect()] == [21, 31, 41]
