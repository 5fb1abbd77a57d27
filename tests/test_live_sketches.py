"""A live profile kept as sketches: it is that of all arrivals, survives a batch run twice, and removes what it has merged."""

import os

import pytest
from pyspark.sql import functions as F

from tableprobe import TableProbeError, profile
from tableprobe.streaming import current_profile, keep_profile, live


def test_profile_of_arrivals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "MERGED_BATCHES", 3)
    table = spark.range(900).select("id", (F.col("id") * 7919 % 1000 / 4).alias("x"), F.concat(F.lit("t"), F.col("id") % 13).alias("t"))
    arriving, folder, checkpoint = (f"{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    with pytest.raises(TableProbeError, match="no complete batch"):
        current_profile(spark, folder, table.schema)

    def arrive(low, high):
        table.filter(f"id >= {low} AND id < {high}").coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        keep_profile(stream, folder, checkpoint, available_now=True).awaitTermination()

    for n in range(5):
        arrive(n * 180, n * 180 + 180)
    # three batches are merged and removed, two are left
    assert sorted(f for f in os.listdir(folder) if "=" in f) == ["batch=3", "batch=4", "upto=2"]
    got, exact = current_profile(spark, folder, table.schema).collect(), profile(table).collect()
    for a, e in zip(got, exact):
        for key in ("column_name", "data_type", "total_rows", "null_count", "min_value", "max_value", "mean", "max_length"):
            assert a[key] == e[key], key
        assert abs(a.unique_count - e.unique_count) <= 0.04 * e.unique_count + 1
    assert abs(got[1].median - exact[1].median) < 8

    # the last batch is run again, as after a failure between its result and its checkpoint
    commits = f"{checkpoint}/commits"
    for name in ("4", ".4.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.rename(f"{commits}/{name}", f"{tmp_path}/{name}.old")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    keep_profile(stream, folder, checkpoint, available_now=True).awaitTermination()
    assert current_profile(spark, folder, table.schema).first().total_rows == 900

    # a batch that did not finish does not count
    os.makedirs(f"{folder}/batch=99")
    assert current_profile(spark, folder, table.schema, ["t"]).first().total_rows == 900
