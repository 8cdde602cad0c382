"""Helpers that several operators share."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.session import scratch_dir
from gantry.sources import files

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def reachable(spark: SparkSession) -> SparkSession:
    """Adds this package's folder to the workers' path, for sessions started elsewhere.

    It serves where workers see the driver's disk; on other clusters the package is sent along
    with the job (`--py-files`) and the entry does nothing.
    """
    folder, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, folder]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, purpose: str = "llm") -> DataFrame:
    """The same rows, written once to the cluster's shared folder and read from there.

    Later steps start from files that outlive any executor, and Spark knows their size,
    which it needs to broadcast only what is small.
    """
    release(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession, purpose)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of settled tables; only for those that no later step reads."""
    for table in tables:
        files.remove(table.sparkSession, table.settled_at)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's JVM has collected them, which with much memory to spare may be
    long after the disks of a many-step job are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def unit_hash(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the parts; null counts as a value."""
    texts = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def shards(spark: SparkSession) -> int:
    """Tasks of a shuffle by key, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most_bytes` of the given text column, so that memory follows bytes and not rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, most_bytes // mean)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
