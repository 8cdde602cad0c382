"""Loads into a warehouse that may be repeated.

Rows go to a stage table of their own for each build. Then one transaction deletes the days from
the table, inserts them from the stage and notes which build each day is of. A load that is run
again, by a retry or a repair, puts the same days in place of themselves; a build that comes
late, when the warehouse has a newer one of a day, leaves that day as it is.

The statements are texts of plain SQL: `execute` runs one of them over whatever connection the
caller has. Nothing here opens one but `jdbc_transaction`, which uses the driver that Spark has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions.dates import day_key
from gantry.schemas import MART
from gantry.sources.writers import read_table

TABLES = ("fact_transaction", "agg_hourly_revenue")
LOG = "warehouse_build"
LOG_DDL = f"CREATE TABLE IF NOT EXISTS {LOG} (table_name VARCHAR(64) NOT NULL, date_id INTEGER NOT NULL, build BIGINT NOT NULL)"


def stage_name(table: str, build: int) -> str:
    return f"stage_{table}_{build}"


def _names(*names: str) -> None:
    for name in names:
        if not re.fullmatch(r"\w+(\.\w+)?", name):
            raise ValueError(f"{name!r} is no table name")


def replace_statements(table: str, stage: str, columns: Iterable[str], days: Iterable[date], build: int) -> list[str]:
    """What puts the rows of `stage` in place of the days in `table`, in order; to be run in one transaction."""
    _names(table, stage)
    keys = sorted({day_key(day) for day in days})
    if not keys:
        return []
    listed, names, build = ", ".join(map(str, keys)), ", ".join(columns), int(build)
    newer = f"SELECT date_id FROM {LOG} WHERE table_name = '{table}' AND build > {build}"
    given = " UNION ALL ".join(f"SELECT {key} AS date_id" for key in keys)
    return [
        f"DELETE FROM {table} WHERE date_id IN ({listed}) AND date_id NOT IN ({newer})",
        f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} WHERE date_id IN ({listed}) AND date_id NOT IN ({newer})",
        f"DELETE FROM {LOG} WHERE table_name = '{table}' AND date_id IN ({listed}) AND build <= {build}",
        f"INSERT INTO {LOG} (table_name, date_id, build)"
        f" SELECT '{table}', date_id, {build} FROM ({given}) AS loaded WHERE date_id NOT IN ({newer})",
    ]


def send_days(
    spark: SparkSession, mart_root: str, days: Iterable[date], build: int,
    write_stage: Callable[[DataFrame, str], None], transaction: Callable[[list[str]], None],
) -> None:
    """Put the days of the stored mart into the warehouse's tables of the same names.

    `write_stage` writes a frame as a new table of the given name, over one that a load which
    stopped has left; `transaction` runs statements, all or none. A stage is dropped once its rows
    are in place, so what a load that stopped leaves is a stage, and the days as they were.
    """
    keys = sorted({day_key(day) for day in days})
    if not keys:
        return
    transaction([LOG_DDL])
    for table in TABLES:
        stage = stage_name(table, build)
        write_stage(read_table(spark, mart_root, table).where(F.col("date_id").isin(keys)), stage)
        columns = T.StructType.fromDDL(MART[table].columns).fieldNames()
        transaction(replace_statements(table, stage, columns, days, build))
        transaction([f"DROP TABLE {stage}"])


@contextmanager
def _connection(spark: SparkSession, url: str, options: Mapping[str, str]) -> Iterator:
    jvm = spark._jvm
    if options.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    properties = jvm.java.util.Properties()
    for key, value in options.items():
        properties.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        yield connection
    finally:
        connection.close()


def jdbc_transaction(spark: SparkSession, url: str, options: Mapping[str, str]) -> Callable[[list[str]], None]:
    """Runs statements over a JDBC connection of the driver process, committed together."""

    def run(statements: list[str]) -> None:
        with _connection(spark, url, options) as connection:
            connection.setAutoCommit(False)
            try:
                for text in statements:
                    statement = connection.createStatement()
                    statement.execute(text)
                    statement.close()
                connection.commit()
            except Exception:
                connection.rollback()
                raise

    return run
