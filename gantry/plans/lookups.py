"""Point reads for applications."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.functions.charges import FLAGGED, vehicle_key
from gantry.functions.dates import day_key, parse_day
from gantry.functions.measures import count_where, total_or_zero
from gantry.plans.mart import Mart

MAX_HISTORY = 100


def active_plazas(mart: Mart) -> DataFrame:
    return mart.dim_plaza.where(F.col("active") == 1).orderBy("plaza_id")


def day_summary(mart: Mart, day: str | date) -> DataFrame:
    """Totals of one day; zeros for a day without transactions. ValueError on a bad date."""
    day = parse_day(day) if isinstance(day, str) else day
    payment = mart.dim_payment.select("payment_id", "status")
    return (
        mart.revenue.where(F.col("date_id") == day_key(day))
        .join(payment, "payment_id")
        .agg(
            total_or_zero().alias("total_revenue"),
            F.count("*").alias("tx_count"),
            F.count_distinct("vehicle_id").alias("unique_vehicles"),
            count_where(F.col("status") == FLAGGED).alias("flagged_count"),
        )
        .select(F.lit(day.isoformat()).alias("date"), "*")
    )


def vehicle_history(mart: Mart, tag_id: str, limit: int = 20) -> DataFrame:
    """Latest trips of a tag; empty when the tag is unknown.

    The tag's surrogate key is a literal, so the fact scan gets an equality filter
    that Parquet statistics and Bloom filters answer. The tag is known by one row of
    the vehicle table, cut to one and broadcast: a tag with a third of all trips is
    cut to its latest ones where they are read.
    """
    if not 1 <= limit <= MAX_HISTORY:
        raise ValueError(f"limit must be between 1 and {MAX_HISTORY}")
    key = vehicle_key(F.lit(tag_id))
    vehicle = mart.dim_vehicle.where((F.col("tag_id") == tag_id) & (F.col("vehicle_id") == key)).select("vehicle_id").limit(1)
    plaza = mart.dim_plaza.select("plaza_id", F.col("name").alias("plaza"), "highway")
    classes = mart.dim_class.select("class_id", F.col("name").alias("vehicle_class"))
    return (
        mart.revenue.where(F.col("vehicle_id") == key)
        .join(F.broadcast(vehicle), "vehicle_id")
        .join(plaza, "plaza_id")
        .join(classes, "class_id")
        .join(mart.dim_payment.select("payment_id", "status"), "payment_id")
        .select("transaction_id", "entry_time", "plaza", "highway", "vehicle_class", "amount", "status")
        .orderBy(F.desc("entry_time"), "transaction_id")
        .limit(limit)
    )
