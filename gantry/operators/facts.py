"""Fact rows and the hourly aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.functions.charges import FLAGGED, LOW_BALANCE, vehicle_key
from gantry.functions.dates import date_id, seconds_between
from gantry.functions.measures import count_where, mean_money, total
from gantry.schemas import LOW_BALANCE_PAYMENT, TAG_METHOD

# Columns a fact takes over from its event beside the times.
_FACT_COLUMNS = ("amount", "status", "plaza_id", "tag_id", "class_id", "lane", "exit_time")


def first_copy(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the earliest by event time, then by ingest time.

    Copies equal in both are told apart by a fingerprint of what a fact keeps, so
    reruns choose the same row while the shuffle carries eight bytes, not every
    column. `row_number() = 1` lets Spark place a group limit before the shuffle:
    each input task sends at most one copy per key however many copies there are.
    """
    times = [f"{c} ASC NULLS LAST" for c in ("event_ts", "ingested_at") if c in events.columns]
    kept = [c for c in _FACT_COLUMNS if c in events.columns]
    order = ", ".join([*times, f"xxhash64({', '.join(kept)})"])
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})")
    return events.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def clean_events(valid: DataFrame) -> DataFrame:
    """Valid events with copies removed inside each event day.

    The day is part of the key because the job that loads the mart works a day at
    a time; a filter on `date_id` can then be applied before the shuffle.
    """
    dated = valid.withColumn("date_id", date_id("event_ts"))
    return first_copy(dated, ["date_id", "transaction_id"])


def fact_transactions(events: DataFrame) -> DataFrame:
    """Charged transactions: project, drop failed deductions, then drop copies.

    A null status is dropped with the failed ones: `<>` is not true for it.
    """
    rows = events.select(
        "transaction_id", "plaza_id", "tag_id", "class_id", "amount", "status", "event_ts", "ingested_at",
        F.expr("to_date(event_ts) AS date"),
        date_id("event_ts").alias("date_id"),
    )
    return first_copy(rows.where(f"status <> '{LOW_BALANCE}'"), ["transaction_id"])


def conform(clean: DataFrame, dim_payment: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Clean events in the shape of the fact table, all statuses kept, and the event's columns in `carry`.

    The payment row is chosen by status *and* method: status alone matches several
    rows and would multiply the facts. Three seed rows remain, so the join is a
    size-checked broadcast; an unknown status keeps its row with no payment.
    """
    payment = dim_payment.where(f"method = '{TAG_METHOD}'").select("status", "payment_id")
    exit_time = "exit_time" if "exit_time" in clean.columns else "CAST(NULL AS TIMESTAMP) AS exit_time"
    return clean.join(payment, "status", "left").select(
        "transaction_id",
        "plaza_id",
        vehicle_key("tag_id").alias("vehicle_id"),
        "class_id",
        "payment_id",
        "amount",
        F.expr("event_ts AS entry_time"),
        F.expr(exit_time),
        F.expr("CAST(lane AS SMALLINT) AS lane"),
        "ingested_at",
        "date_id",
        *carry,
    )


def revenue_facts(facts: DataFrame) -> DataFrame:
    """Facts without failed deductions, which stay only in the full table.

    A status that no payment row has leaves a null key; such a fact is revenue like
    any other that is not low balance.
    """
    return facts.where(f"NOT (payment_id <=> {LOW_BALANCE_PAYMENT})")


def processing_times(facts: DataFrame) -> DataFrame:
    """Histogram of the seconds between entry and exit by plaza and day, for percentiles over any days and plazas."""
    seconds = seconds_between("entry_time", "exit_time").alias("seconds")
    timed = facts.where("exit_time IS NOT NULL").select("plaza_id", "date_id", seconds)
    return timed.groupBy("plaza_id", "date_id", "seconds").agg(F.count("*").alias("n"))


def hourly_revenue(
    rows: DataFrame,
    ts: str = "event_ts",
    vehicle: str = "tag_id",
    flagged: Column | None = None,
) -> DataFrame:
    """Plaza x day x hour totals over any frame of events or facts.

    The exact distinct count shuffles on (group, vehicle) after a map-side
    combine, so a busy plaza's hour is spread over tasks by vehicle.
    """
    is_flagged = F.col("status") == FLAGGED if flagged is None else flagged
    return rows.groupBy("plaza_id", date_id(ts).alias("date_id"), F.hour(ts).cast("smallint").alias("hour")).agg(
        F.count("transaction_id").cast("int").alias("tx_count"),
        total().cast("decimal(14,2)").alias("total_revenue"),
        F.count_distinct(vehicle).cast("int").alias("unique_vehicles"),
        mean_money().cast("decimal(8,2)").alias("avg_toll"),
        count_where(is_flagged).cast("int").alias("flagged_count"),
    )
