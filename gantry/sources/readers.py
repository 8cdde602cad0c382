"""Message streams, the raw zone and the mart tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.schemas import RAW_DDL

# Replay from the start by default, and do not fail when retention removed messages.
KAFKA_DEFAULTS = {"startingOffsets": "earliest", "failOnDataLoss": "false"}


def read_messages(spark: SparkSession, options: Mapping[str, str], source: str = "kafka") -> DataFrame:
    """Streaming frame with a `value` column from any message source.

    For Kafka give `kafka.bootstrap.servers` and `subscribe`; its connector has to
    be on the class path. Bound a trigger with `maxOffsetsPerTrigger`.
    """
    defaults = KAFKA_DEFAULTS if source == "kafka" else {}
    return spark.readStream.format(source).options(**{**defaults, **options}).load()


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Stream the files of a Parquet table, or one file.

    The last letter is put in brackets: a streaming source takes a plain file name
    for a folder, but accepts a pattern that matches either.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def on_days(days: Iterable[date]) -> Column:
    """Raw-zone partitions of these days, a range for each run of days within a month.

    Compares numbers, so padding cannot matter.
    """
    runs: list[tuple[date, date]] = []
    for d in sorted(set(days)):
        if runs and d - runs[-1][1] == timedelta(days=1) and d.month == runs[-1][1].month:
            runs[-1] = (runs[-1][0], d)
        else:
            runs.append((d, d))
    wanted = [
        (F.col("year") == a.year) & (F.col("month") == a.month) & F.col("day").between(a.day, b.day) for a, b in runs
    ]
    return reduce(or_, wanted, F.lit(False))


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """Landed events by path. Where the zone is registered, `spark.table` spares the file listing."""
    return spark.read.schema(RAW_DDL).parquet(root)


def require_days(raw: DataFrame, days: Iterable[date]) -> None:
    """Raise unless every day has landed rows.

    One day is probed up to its first row; several are found in one pass over the
    partition columns.
    """
    wanted = sorted(set(days))
    rows = raw.where(on_days(wanted))
    if len(wanted) == 1:
        found = set() if rows.isEmpty() else set(wanted)
    else:
        found = {date(*row) for row in rows.select("year", "month", "day").distinct().collect()}
    missing = [d.isoformat() for d in wanted if d not in found]
    if missing:
        raise FileNotFoundError(f"no raw data for {', '.join(missing)}")
