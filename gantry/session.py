"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"
RUNTIME = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "gantry", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that a session given by the caller needs as well; they stay set in it.

    Dates and hours are UTC everywhere. The JVM never compiles a method above 8000
    bytes of bytecode, so a wider generated stage is better split than interpreted.
    """
    for key, value in RUNTIME.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings (dots written as two underscores) for the actions inside; what was set before comes back."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's checkpoint folder, or, where none is named, below its warehouse.

    Both are on a file system that driver and executors share.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get(WAREHOUSE_DIR).rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
