"""Dimension rows: seeds, calendar, vehicles, and the two ways to add to a table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions.charges import vehicle_key
from gantry.functions.dates import date_id, is_weekend
from gantry.schemas import CLASS_SEED, MART, PAYMENT_SEED, PLAZA_SEED

UNKNOWN_PLATE = "UNKNOWN"


def _seed(spark: SparkSession, table: str, rows: str) -> DataFrame:
    """Inline rows with the table's types. Stays a local relation of known size."""
    fields = T.StructType.fromDDL(MART[table].columns).fields
    typed = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in fields)
    names = ", ".join(f.name for f in fields)
    return spark.sql(f"SELECT {typed} FROM VALUES {rows} AS seed({names})")


def payment_seed(spark: SparkSession) -> DataFrame:
    return _seed(spark, "dim_payment", PAYMENT_SEED)


def class_seed(spark: SparkSession) -> DataFrame:
    return _seed(spark, "dim_class", CLASS_SEED)


def plaza_seed(spark: SparkSession) -> DataFrame:
    return _seed(spark, "dim_plaza", PLAZA_SEED)


def date_rows(days: DataFrame) -> DataFrame:
    """Calendar attributes of a frame with one DATE column `date`."""
    return days.select(
        date_id("date").alias("date_id"),
        "date",
        F.expr("CAST(year(date) AS SMALLINT) AS year"),
        F.expr("CAST(month(date) AS SMALLINT) AS month"),
        F.expr("CAST(dayofmonth(date) AS SMALLINT) AS day"),
        F.expr("date_format(date, 'EEEE') AS day_of_week"),
        is_weekend("date").alias("is_weekend"),
    )


def days_of(rows: DataFrame, key: str = "date_id") -> DataFrame:
    """Calendar attributes of the days that `rows` have, whichever they are."""
    day = F.make_date(F.floor(F.col(key) / 10000), F.floor(F.col(key) / 100) % 100, F.col(key) % 100)
    return date_rows(rows.select(key).distinct().select(day.alias("date")))


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every day from first to last; its size is the number of days asked for."""
    return date_rows(spark.sql("SELECT explode(sequence(:first, :last)) AS date", {"first": first, "last": last}))


def vehicles(events: DataFrame) -> DataFrame:
    """One row per tag with the plate seen last.

    Grouping by (tag, plate) first keeps the wide pass a hash aggregate with a
    map-side combine; what is left for the second step is one row per plate a tag
    ever had. Tags seen only without a plate are kept.
    """
    plates = events.groupBy("tag_id", "vehicle_no").agg(
        F.max("event_ts").alias("plate_seen_at"), F.min("event_ts").alias("created_at")
    )
    return _latest_plate(plates)


def _latest_plate(plates: DataFrame) -> DataFrame:
    # Rows without a plate never win over rows with one; equal times fall back to
    # the plate itself, which makes the choice total.
    latest = plates.groupBy("tag_id").agg(
        F.expr(
            "max_by(struct(vehicle_no, plate_seen_at), struct(vehicle_no IS NOT NULL, plate_seen_at, vehicle_no)) AS plate"
        ),
        F.min("created_at").alias("created_at"),
    )
    return latest.select(
        vehicle_key("tag_id").alias("vehicle_id"),
        "tag_id",
        F.expr(f"coalesce(plate.vehicle_no, '{UNKNOWN_PLATE}') AS vehicle_no"),
        F.expr("CAST(NULL AS STRING) AS owner_name"),
        F.expr("substring(plate.vehicle_no, 1, 2) AS registered_state"),
        F.expr("CAST(1 AS SMALLINT) AS active"),
        "created_at",
        F.expr("plate.plate_seen_at"),
    )


def merge_vehicles(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known and newly seen vehicles in one table.

    The latest plate wins whichever side it is on, so merging a day twice, or an
    old day after a new one, changes nothing.
    """
    plates = [
        side.select(
            "tag_id",
            F.expr(f"nullif(vehicle_no, '{UNKNOWN_PLATE}') AS vehicle_no"),
            "plate_seen_at",
            "created_at",
        )
        for side in (known, seen)
    ]
    return _latest_plate(plates[0].unionByName(plates[1]))


def repeated_vehicle_ids(dim_vehicle: DataFrame) -> DataFrame:
    """Surrogate keys that two tags share; has to be empty."""
    return dim_vehicle.groupBy("vehicle_id").agg(F.count("*").alias("tags")).where("tags > 1")


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key `existing` does not have: append them to insert-if-absent."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`existing` with the rows of `new` put in place of those with the same key."""
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new)
