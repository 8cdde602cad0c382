"""Load whole days into the mart, and load again the days that late rows changed.

    python -m gantry.plans.nightly --raw <raw zone> --mart <mart root> [--date YYYY-MM-DD | --repair | --compact]

With `--jdbc-url` the loaded days also take the place of themselves in a warehouse.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions.dates import day_key, key_day, parse_day, yesterday_utc
from gantry.operators import bitmaps, dims, ledger, quality
from gantry.operators.facts import conform, processing_times, revenue_facts
from gantry.plans.mart import current_vehicles, hourly_from_facts, publish_vehicles
from gantry.schemas import HOUR_COLUMNS, MART
from gantry.session import build_session, prepare, scratch_dir, settings
from gantry.sources import files, warehouse
from gantry.sources.readers import on_days, read_raw, require_days
from gantry.sources.writers import read_table, table_path, jdbc_writer, write_days, write_raw, write_table


#: How often days may bring in further days. Each turn takes days whose own rows have changed since they were loaded.
MOST_TURNS = 10


def folder_day() -> Column:
    """yyyymmdd of a raw-zone folder."""
    return F.expr("year * 10000 + month * 100 + day")


@dataclass(frozen=True)
class Loaded:
    days: tuple[date, ...]
    facts: int
    hourly: int
    checks: tuple
    build: int


def load_days(spark: SparkSession, raw: DataFrame, mart_root: str, days: Iterable[date]) -> Loaded:
    """Load days of the raw zone into the mart; loading a day again replaces it.

    A transaction is a fact on the first of its days only. Days beside the given ones that
    lose one to them, or get one back, are loaded with them (`claim_days`). `raw` is the whole zone, read by path or from the catalog; the days are
    partition filters on it. Dimensions come before facts, so no fact is ever
    without its date. The fact partitions are read back for the aggregate and the
    checks: a written table cuts the lineage, and nothing is worked out twice.
    Raises DataQualityError, with the data in place, when a check fails; the days
    then count as not built, and readers keep the vehicles they had. The ledger is written
    last but for the log of builds, so a job that stops before finds the same days to load.
    """
    prepare(spark)
    started, build = datetime.now(timezone.utc), time.time_ns()
    work = scratch_dir(spark, "claims")
    days, claims, elsewhere = claim_days(spark, raw, mart_root, days, work)

    events = raw.where(on_days(days))
    vehicles = load_dimensions(spark, mart_root, days, events, build, work)

    payment = read_table(spark, mart_root, "dim_payment")
    once = ledger.on_first_day(events, elsewhere)
    facts = write_days(conform(once, payment), spark, mart_root, "fact_transaction", days)

    loaded = read_table(spark, mart_root, "fact_transaction").where(
        F.col("date_id").isin([day_key(d) for d in days])
    )
    hourly = hourly_from_facts(revenue_facts(loaded)).withColumn("loaded_at", F.lit(started).cast("timestamp"))
    hours = write_days(hourly, spark, mart_root, "agg_hourly_revenue", days)

    write_days(processing_times(revenue_facts(loaded)), spark, mart_root, "agg_processing", days)
    write_days(bitmaps.vehicle_bits(revenue_facts(loaded), vehicles), spark, mart_root, "agg_vehicle_bits", days)

    plaza = read_table(spark, mart_root, "dim_plaza")
    checks = quality.gate(loaded, plaza, days, vehicles)
    publish_vehicles(spark, mart_root, build)
    write_days(claims, spark, mart_root, "tx_ledger", days)
    log_build(spark, events, mart_root, facts, started, build)
    files.remove(spark, work)
    return Loaded(days, sum(facts.values()), sum(hours.values()), tuple(checks), build)


def claim_days(spark: SparkSession, raw: DataFrame, root: str, days: Iterable[date], work: str) -> tuple:
    """(days, their claims, first claims of other days): the given days and those that have to be loaded with them.

    Both frames are tables in the folder `work`. Of the ledger's other days only the parts are
    read that the days' transactions fall into. It ends, since days only join. Before the first
    load no other day claims anything: the second frame is empty and known to be.
    """
    days = tuple(sorted(set(days)))
    started = files.exists(spark, table_path(root, "tx_ledger"))
    known = existing(spark, root, "tx_ledger")
    for turn in range(1 + MOST_TURNS):
        require_days(raw, days)
        keys = [day_key(d) for d in days]
        now = _written(ledger.claims(raw.where(on_days(days))), f"{work}/{turn}/now")
        if not started:
            return days, now, ledger.first_elsewhere(known, now)
        before = known.where(F.col("date_id").isin(keys))
        touched = now.select("bucket", "transaction_id").unionByName(before.select("bucket", "transaction_id"))
        parts = [row["bucket"] for row in touched.select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS
        others = known.where(~F.col("date_id").isin(keys) & F.col("bucket").isin(parts))
        elsewhere = _written(ledger.first_elsewhere(others, touched), f"{work}/{turn}/elsewhere")
        moved = {key_day(row["date_id"]) for row in ledger.moved_days(before, now, elsewhere).collect()}
        if moved <= set(days):
            return days, now, elsewhere
        days = tuple(sorted({*days, *moved}))
    raise RuntimeError(f"days that depend on each other were still found after {MOST_TURNS} turns")


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ledger_from_facts(spark: SparkSession, root: str) -> int:
    """Write the ledger of a mart that was loaded before it had one; the number of claims."""
    facts = read_table(spark, root, "fact_transaction")
    return write_table(facts.select("transaction_id", ledger.bucket().alias("bucket"), "date_id").distinct(), root, "tx_ledger")


def log_build(spark: SparkSession, events: DataFrame, root: str, facts: dict[date, int], started: datetime, build: int) -> None:
    """Which loads of each day the build has read.

    `events` lists the zone's files as they were when it was opened, which is what the
    facts were made of; only partition columns are read. A row per load, not per event.
    """
    counts = spark.createDataFrame([(day_key(d), n) for d, n in facts.items()], "date_id INT, facts BIGINT")
    loads = events.select(folder_day().alias("date_id"), "load").distinct()
    rows = counts.join(loads, "date_id").withColumns({"loaded_at": F.lit(started).cast("timestamp"), "build": F.lit(build)})
    write_table(rows, root, "build_log")


def builds(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest build of each day."""
    log = existing(spark, root, "build_log")
    newest = log.groupBy("date_id").agg(F.max("build").alias("build"))
    return log.join(newest, ["date_id", "build"])


def existing(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table, or an empty frame of its shape before the first load."""
    if files.exists(spark, table_path(root, table)):
        return read_table(spark, root, table)
    return no_rows(spark, MART[table].columns)


def no_rows(spark: SparkSession, ddl: str) -> DataFrame:
    """An empty frame that the optimizer knows to be empty, so that joins with it fall away."""
    typed = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in T.StructType.fromDDL(ddl).fields)
    return spark.sql(f"SELECT {typed} WHERE false")


def load_dimensions(spark: SparkSession, root: str, days: Sequence[date], events: DataFrame, build: int, work: str) -> DataFrame:
    """Adds what the days need to the dimensions; the new vehicles, which no reader sees until they are published."""
    seeds = {
        "dim_payment": dims.payment_seed(spark),
        "dim_class": dims.class_seed(spark),
        "dim_plaza": dims.plaza_seed(spark),
        "dim_date": dims.date_rows(spark.createDataFrame([(d,) for d in days], "date DATE")),
    }
    for table, rows in seeds.items():
        new = dims.absent_rows(rows, existing(spark, root, table), MART[table].key)
        if not new.isEmpty():
            write_table(new, root, table, mode="append")

    known = current_vehicles(spark, root)
    if known is None:
        merged, last = dims.vehicles(events).withColumn("number", F.lit(None).cast("bigint")), 0
    else:
        merged = dims.merge_vehicles(known, dims.vehicles(events)).join(known.select("vehicle_id", "number"), "vehicle_id", "left")
        last = known.agg(F.max("number")).first()[0] or 0
    numbered = bitmaps.number_vehicles(_written(merged, f"{work}/vehicles"), last)
    write_table(numbered.withColumn("snapshot", F.lit(build)), root, "dim_vehicle")
    return read_table(spark, root, "dim_vehicle").where(F.col("snapshot") == build)


PLACE = ("year", "month", "day", "load")


def unread_loads(raw: DataFrame, built: DataFrame) -> DataFrame:
    """(year, month, day, load) of the zone's loads that the newest build of their day has not read.

    `built` has (date_id, load). Loads are folders, so what was read is known without clocks.
    """
    there = raw.select(*PLACE).distinct()
    return there.join(built.select("date_id", "load"), (folder_day() == F.col("date_id")) & (there["load"] == built["load"]), "left_anti")


def unread_days(raw: DataFrame, built: DataFrame) -> list[date]:
    """Days with such loads, one value each. From the names of the zone's folders or partitions: no file of the zone is opened."""
    with settings(raw.sparkSession, spark__sql__optimizer__metadataOnly="true"):
        return sorted(date(*row) for row in unread_loads(raw, built).select(*PLACE[:3]).distinct().collect())


def late_days(raw: DataFrame, built: DataFrame) -> DataFrame:
    """Event days with loads that their newest build has not read, or that were never built.

    The days are known before the plan is made, so that only their files are read.
    """
    late = raw.where(on_days(unread_days(raw, built)))
    return (
        late.join(unread_loads(late, built), list(PLACE))
        .groupBy(folder_day().alias("date_id"))
        .agg(F.count("*").alias("late_rows"), F.max("ingested_at").alias("last_arrival"))
    )


def repair_late(spark: SparkSession, raw: DataFrame, mart_root: str) -> Loaded | None:
    """Load every late day again, all in one job; None when there is none."""
    prepare(spark)
    late = late_days(raw, builds(spark, mart_root))
    # One row per day, not per event, comes to the driver.
    days = [key_day(row["date_id"]) for row in late.select("date_id").collect()]
    return load_days(spark, raw, mart_root, days) if days else None


def compact_raw(spark: SparkSession, raw_root: str, mart_root: str, day: date) -> int:
    """Merge the loads of a day that its newest build has read into one; the number of folders that went.

    The merged rows are written and logged as read before the old folders go. A job that
    stops in between leaves rows twice, which the load of a day drops like any copies.
    """
    key, build = day_key(day), time.time_ns()
    newest = builds(spark, mart_root).where(F.col("date_id") == key)
    read = {row["load"] for row in newest.select("load").collect()}  # a name for each load of one day
    if len(read) < 2:
        return 0
    load = f"compact-{build}"
    rows = read_raw(spark, raw_root).where(on_days([day]) & F.col("load").isin(sorted(read)))
    write_raw(rows, raw_root, load)
    merged = newest.select("date_id", F.lit(load).alias("load"), "facts", "loaded_at", F.lit(build).alias("build")).distinct()
    write_table(newest.withColumn("build", F.lit(build)).select(*merged.columns).unionByName(merged), mart_root, "build_log")
    removed = 0
    above = "/".join(f"{c}={v}" for c, v in zip(HOUR_COLUMNS, (day.year, day.month, day.day)))
    for hour in files.children(spark, f"{raw_root}/{above}"):
        for name in files.children(spark, f"{raw_root}/{above}/{hour}"):
            if name.removeprefix("load=") in read:
                files.remove(spark, f"{raw_root}/{above}/{hour}/{name}")
                removed += 1
    return removed


def send_to_warehouse(spark: SparkSession, mart_root: str, days: Sequence[date], build: int, url: str, options: dict[str, str]) -> None:
    """Put the facts and hourly totals of the days in place of themselves in the warehouse's tables of the same names."""

    def write_stage(rows: DataFrame, name: str) -> None:
        jdbc_writer(rows, url, name, options, mode="overwrite").save()

    warehouse.send_days(spark, mart_root, days, build, write_stage, warehouse.jdbc_transaction(spark, url, options))


def main(argv: Sequence[str] | None = None) -> None:
    arguments = argparse.ArgumentParser()
    arguments.add_argument("--raw", required=True)
    arguments.add_argument("--mart", required=True)
    arguments.add_argument("--date", type=parse_day, default=None, help="YYYY-MM-DD; yesterday (UTC) if not given")
    arguments.add_argument("--repair", action="store_true", help="load the days that late rows changed instead")
    arguments.add_argument("--compact", action="store_true", help="merge the raw folders of the day instead")
    arguments.add_argument("--jdbc-url", default=None, help="warehouse that gets the loaded days")
    arguments.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE")
    given = arguments.parse_args(argv)
    spark = build_session("gantry-nightly")
    day = given.date or yesterday_utc()
    if given.compact:
        compact_raw(spark, given.raw, given.mart, day)
        return
    raw = read_raw(spark, given.raw)
    loaded = repair_late(spark, raw, given.mart) if given.repair else load_days(spark, raw, given.mart, [day])
    if loaded and given.jdbc_url:
        options = dict(option.split("=", 1) for option in given.jdbc_option)
        send_to_warehouse(spark, given.mart, loaded.days, loaded.build, given.jdbc_url, options)


if __name__ == "__main__":
    main()
