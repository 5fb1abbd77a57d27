import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tableprobe import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def saved(spark, tmp_path):
    """Write a frame to Parquet and read it back, as `files` files in the order given."""
    count = iter(range(1000))

    def save(df, files=1):
        folder = f"{tmp_path}/table{next(count)}"
        df.coalesce(1).write.parquet(folder) if files == 1 else df.repartition(files).write.parquet(folder)
        return spark.read.parquet(folder)

    return save
