"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Runtime SQL settings every operator here is written against.
RUNTIME_CONF = {
    # `ID` and `id` are two columns
    "spark.sql.caseSensitive": "true",
    # timestamps without a zone are printed as stored
    "spark.sql.session.timeZone": "UTC",
    # TIME columns would otherwise fail the analysis of the whole file
    "spark.sql.timeType.enabled": "true",
    # nanosecond timestamps are read as integers and then converted
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "tableprobe", **conf: str) -> SparkSession:
    """Get or create a session with the settings this package wants."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    It lies below ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, may fall back to the machine's own temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
