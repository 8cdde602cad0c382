"""Databases, tables and partitions in the session catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gantry.schemas import MART, RAW_DDL, RAW_PARTITIONS
from gantry.sources.writers import table_path


def table_ddl(database: str, table: str, root: str) -> str:
    spec = MART[table]
    parts = f" PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
    # Bloom filters are written by INSERT as well; its order of rows is up to the statement.
    options = {"compression": "zstd", **{f"parquet.bloom.filter.enabled#{column}": "true" for column in spec.bloom}}
    listed = ", ".join(f"'{key}' = '{value}'" for key, value in options.items())
    return (
        f"CREATE TABLE IF NOT EXISTS {database}.{table} ({spec.columns}) USING parquet"
        f" OPTIONS ({listed}){parts} LOCATION '{table_path(root, table)}'"
    )


def create_mart(spark: SparkSession, root: str, database: str = "mart") -> None:
    """Schema and tables over `root`; leaves what exists as it is."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table in MART:
        spark.sql(table_ddl(database, table, root))


def refresh_partitions(spark: SparkSession, table: str) -> None:
    """Register the partition folders that appeared since the last call."""
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def register_raw_zone(spark: SparkSession, root: str, table: str = "raw_events") -> None:
    """A table over the raw zone, with its hour folders as partitions."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({RAW_DDL}) USING parquet"
        f" PARTITIONED BY ({', '.join(RAW_PARTITIONS)}) LOCATION '{root}'"
    )
    refresh_partitions(spark, table)
