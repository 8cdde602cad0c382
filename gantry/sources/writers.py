"""Mart tables on Parquet, JDBC append and outgoing messages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions.dates import day_key
from gantry.schemas import HOUR_COLUMNS, MART, RAW_DDL, RAW_PARTITIONS
from gantry.session import settings
from gantry.sources import files


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(MART[table].columns).parquet(table_path(root, table))


def as_table(df: DataFrame, table: str) -> DataFrame:
    """Columns of `table` in order and type."""
    fields = T.StructType.fromDDL(MART[table].columns).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """Rows distributed and sorted the way the table is stored.

    REBALANCE lets adaptive execution split a partition value that holds most of
    the data over several tasks and join small ones, so one busy day is neither
    one task nor a thousand tiny files.
    """
    spec = MART[table]
    if spec.partition_by:
        df = df.hint("rebalance", *spec.partition_by, *spec.sort_by[:1])
    return df.sortWithinPartitions(*spec.partition_by, *spec.sort_by) if spec.sort_by else df


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> int:
    """Write one mart table and return the number of rows written.

    On a partitioned table `overwrite` replaces only the partitions present in
    `df`, so loading a day again leaves one copy of it. Rows are counted while
    they are written.
    """
    counted = Observation(f"rows of {table}")
    _write(as_table(df, table).observe(counted, F.count(F.lit(1)).alias("n")), root, table, mode)
    return counted.get["n"]


def _write(shaped: DataFrame, root: str, table: str, mode: str) -> None:
    spec = MART[table]
    writer = laid_out(shaped, table).write.mode(mode).option("compression", "zstd")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    for column in spec.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if spec.partition_by:
        writer = writer.partitionBy(*spec.partition_by)
    writer.parquet(table_path(root, table))


def write_days(df: DataFrame, spark: SparkSession, root: str, table: str, days: Iterable[date]) -> dict[date, int]:
    """Put the rows of `df` in place of all rows of the days; the number of rows of each.

    Days that have rows are overwritten; of the others the old partition goes. Both are
    known from counts taken while writing.
    """
    keys = {day: day_key(day) for day in days}
    counted = Observation(f"days of {table}")
    counts = [F.count_if(F.col("date_id") == key).alias(str(key)) for key in keys.values()]
    _write(as_table(df, table).observe(counted, *counts), root, table, "overwrite")
    found = {day: counted.get[str(key)] for day, key in keys.items()}
    for day, n in found.items():
        if not n:
            files.remove(spark, f"{table_path(root, table)}/date_id={keys[day]}")
    return found


def raw_rows(events: DataFrame, load: str) -> DataFrame:
    """Stamped events with the raw zone's columns; those that a source does not send are null."""
    columns = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in T.StructType.fromDDL(RAW_DDL).fields if f.name != "load"
    ]
    return events.select(*columns).withColumn("load", F.lit(load))


def write_raw(events: DataFrame, root: str, load: str) -> None:
    """Write stamped events into the raw zone as one load; the same load written again replaces itself.

    One plan for a batch and for a stream's trigger: rows are gathered by hour, and adaptive
    execution splits a busy hour over several tasks and lets one task write several small ones.
    What takes time in small hours is making their files, so tasks are joined only while they
    are very small, and never to fewer than four for each core, so that none is left to run alone
    at the end; the number of files is that of the hours either way.
    """
    spark = events.sparkSession
    least = {"coalescePartitions__minPartitionSize": "16k", "coalescePartitions__minPartitionNum": str(4 * spark.sparkContext.defaultParallelism)}
    rows = raw_rows(events, load).hint("rebalance", *HOUR_COLUMNS)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    with settings(spark, **{f"spark__sql__adaptive__{name}": value for name, value in least.items()}):
        writer.partitionBy(*RAW_PARTITIONS).parquet(root)


def jdbc_writer(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None,
                mode: str = "append", connections: int | None = None) -> DataFrameWriter:
    """Writer for a warehouse table; `options` brings driver, user, password, staging folder.

    `connections`, if given, bounds how many tasks talk to the warehouse at once.
    """
    writer = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
    if connections:
        writer = writer.option("numPartitions", str(connections))
    return writer.option("batchsize", "10000").options(**(options or {}))


def write_jdbc(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None,
               mode: str = "append", connections: int | None = None) -> int:
    counted = Observation(f"rows to {table}")
    observed = df.observe(counted, F.count(F.lit(1)).alias("n"))
    jdbc_writer(observed, url, table, options, mode, connections).save()
    return counted.get["n"]


def write_messages(messages: DataFrame, options: Mapping[str, str], sink: str = "kafka") -> None:
    """Send encoded events (see `encode_events`) in one batch."""
    messages.write.format(sink).options(**options).mode("append").save()
