"""The ten KPI queries. `as_of` stands for today and is always given.

Joins to the calendar, plazas, classes and payments carry no hint: those tables
are small files or inline rows, and Spark broadcasts them after looking at their
size. Where the vehicle table is joined, facts are first brought down to what one
vehicle contributes, so neither a busy tag nor the table's size matters.
"Last n days" means from n days before `as_of` on, with no upper end. A bound on the
entry time is given on the day as well, which a stored mart's folders answer.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gantry.functions.charges import FLAGGED, LOW_BALANCE
from gantry.functions.dates import day_key, days_before, seconds_between
from gantry.functions.measures import mean_money, percent, total, total_or_zero
from gantry.operators.bitmaps import count_vehicles
from gantry.operators.facts import revenue_facts
from gantry.operators.percentiles import mean_and_percentile, of_histogram
from gantry.plans.mart import Mart
from gantry.sources import colocated


def _since(mart: Mart, as_of: date, days: int) -> DataFrame:
    return mart.dim_date.where(F.col("date") >= days_before(as_of, days))


def revenue_today(mart: Mart, as_of: date) -> DataFrame:
    today = mart.dim_date.where(F.col("date") == F.lit(as_of)).select("date_id")
    return mart.revenue.join(today, "date_id").agg(
        total_or_zero().alias("total_revenue_today"), F.count("*").alias("total_transactions")
    )


def plaza_revenue(mart: Mart, as_of: date, days: int = 7) -> DataFrame:
    plaza = mart.dim_plaza.select("plaza_id", F.col("name").alias("plaza_name"), "highway")
    return (
        mart.revenue.join(_since(mart, as_of, days).select("date_id"), "date_id")
        .join(plaza, "plaza_id")
        .groupBy("plaza_name", "highway")
        .agg(total().alias("total_revenue"), F.count("*").alias("tx_count"), mean_money().alias("avg_toll"))
        .orderBy(F.desc("total_revenue"), "plaza_name")
    )


def hourly_heatmap(mart: Mart, as_of: date, days: int = 1) -> DataFrame:
    plaza = mart.dim_plaza.select("plaza_id", F.col("name").alias("plaza_name"))
    return (
        mart.hourly.join(_since(mart, as_of, days).select("date_id", "date"), "date_id")
        .join(plaza, "plaza_id")
        .select("date", "hour", "plaza_id", "plaza_name", "tx_count", "total_revenue", "flagged_count")
        .orderBy("date", "hour", "plaza_id")
    )


def class_share(mart: Mart, as_of: date) -> DataFrame:
    month = mart.dim_date.where((F.col("year") == as_of.year) & (F.col("month") == as_of.month))
    classes = mart.dim_class.select("class_id", F.col("name").alias("vehicle_class"))
    per_class = (
        mart.revenue.join(month.select("date_id"), "date_id")
        .join(classes, "class_id")
        .groupBy("vehicle_class")
        .agg(F.count("*").alias("tx_count"), total().alias("revenue"))
    )
    # One row per class is left: a window over all of them is a handful of rows.
    whole = F.sum("tx_count").over(Window.partitionBy())
    return per_class.withColumn("pct_share", percent(F.col("tx_count"), whole)).orderBy(
        F.desc("revenue"), "vehicle_class"
    )


def top_vehicles(mart: Mart, k: int = 10) -> DataFrame:
    return _busiest(mart.revenue, mart.dim_vehicle, ["vehicle_id"], k)


def top_vehicles_colocated(facts: DataFrame, vehicles: DataFrame, k: int = 10) -> DataFrame:
    """`top_vehicles` over the tables of `sources.colocated`: trips and vehicles meet where they are stored."""
    return _busiest(revenue_facts(facts), vehicles, list(colocated.KEYS), k)


def _busiest(revenue: DataFrame, vehicles: DataFrame, keys: list[str], k: int) -> DataFrame:
    per_vehicle = revenue.groupBy(*keys).agg(F.count("*").alias("trips"), total().alias("paid"))
    return (
        per_vehicle.join(vehicles, keys)
        .groupBy("tag_id", "vehicle_no", "registered_state")
        .agg(F.sum("trips").alias("total_trips"), F.sum("paid").alias("total_paid"))
        .orderBy(F.desc("total_trips"), "tag_id", "vehicle_no")
        .limit(k)
    )


def flagged_report(mart: Mart, k: int = 100) -> DataFrame:
    """Latest k flagged transactions.

    Flagged rows gather on few tags. No row outside a vehicle's own latest k can
    be among the latest k of all, so each vehicle is cut to k before its shuffle;
    that changes no result, and the join then reuses the same partitioning.
    """
    payment = mart.dim_payment.where(F.col("status") == FLAGGED).select("payment_id", "status")
    plaza = mart.dim_plaza.select("plaza_id", F.col("name").alias("plaza"))
    latest = [F.desc("entry_time"), F.asc("transaction_id")]
    rank = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(*latest))
    flagged = (
        mart.revenue.join(payment, "payment_id")
        .join(plaza, "plaza_id")
        .select("transaction_id", "entry_time", "vehicle_id", "plaza", "amount", "status")
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= k)
    )
    return (
        flagged.join(mart.dim_vehicle.select("vehicle_id", "tag_id", "vehicle_no"), "vehicle_id")
        .select("transaction_id", "entry_time", "tag_id", "vehicle_no", "plaza", "amount", "status")
        .orderBy(*latest)
        .limit(k)
    )


def weekend_weekday(mart: Mart, as_of: date, days: int = 30) -> DataFrame:
    day_type = F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday").alias("day_type")
    dates = _since(mart, as_of, days).select("date_id", day_type)
    return (
        mart.revenue.join(dates, "date_id")
        .groupBy("day_type")
        .agg(F.count("*").alias("tx_count"), total().alias("total_revenue"), mean_money().alias("avg_toll"))
    )


def monthly_trend(facts: DataFrame, dim_date: DataFrame | None = None) -> DataFrame:
    """Monthly revenue, running total of the year, previous month present, growth.

    A row for each day meets the calendar; without one the day's key tells its month.
    """
    per_day = facts.groupBy("date_id").agg(total().alias("amount"))
    if dim_date is None:
        dated = per_day.selectExpr("CAST(date_id div 10000 AS SMALLINT) AS year", "CAST(date_id div 100 % 100 AS SMALLINT) AS month", "amount")
    else:
        dated = per_day.join(dim_date.select("date_id", "year", "month"), "date_id")
    monthly = dated.groupBy("year", "month").agg(total().alias("monthly_revenue"))
    # Twelve rows a year from here on.
    in_order = Window.orderBy("year", "month")
    this_year = Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.col("prev_month_revenue")
    return (
        monthly.withColumns({
            "cumulative_revenue": F.sum("monthly_revenue").over(this_year),
            "prev_month_revenue": F.lag("monthly_revenue").over(in_order),
        })
        .withColumn("mom_growth_pct", percent(F.col("monthly_revenue") - previous, previous))
        .orderBy("year", "month")
    )


def low_balance(mart: Mart, now: datetime, hours: int = 24) -> DataFrame:
    """Vehicles short of balance lately; `last_toll_amount` is the smallest charge, not the last."""
    payment = mart.dim_payment.where(F.col("status") == LOW_BALANCE).select("payment_id")
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    per_vehicle = (
        mart.facts.where((F.col("date_id") >= day_key((now - timedelta(hours=hours)).date())) & (F.col("entry_time") >= start))
        .join(payment, "payment_id")
        .groupBy("vehicle_id")
        .agg(F.max("entry_time").alias("seen"), F.min("amount").alias("smallest"))
    )
    return (
        per_vehicle.join(mart.dim_vehicle, "vehicle_id")
        .groupBy("tag_id", "vehicle_no", "owner_name", "registered_state")
        .agg(F.max("seen").alias("last_seen"), F.min("smallest").alias("last_toll_amount"))
        .orderBy(F.desc("last_seen"), "tag_id")
    )


def highway_sla(mart: Mart, as_of: date, days: int = 7, q: float = 0.95) -> DataFrame:
    plaza = mart.dim_plaza.select("plaza_id", "highway")
    timed = (
        mart.revenue.where(F.col("exit_time").isNotNull())
        .where(F.col("date_id") >= day_key(as_of - timedelta(days=days)))
        .join(plaza, "plaza_id")
        .select("highway", seconds_between("entry_time", "exit_time").alias("seconds"))
    )
    return _sla(mean_and_percentile(timed, ["highway"], "seconds", q))


def highway_sla_stored(mart: Mart, as_of: date, days: int = 7, q: float = 0.95) -> DataFrame:
    """The same report from the stored histograms of each day: facts are not read."""
    plaza = mart.dim_plaza.select("plaza_id", "highway")
    recent = mart.table("agg_processing").where(F.col("date_id") >= day_key(as_of - timedelta(days=days)))
    added = recent.join(plaza, "plaza_id").groupBy("highway", "seconds").agg(F.sum("n").alias("n"))
    return _sla(of_histogram(added, ["highway"], "seconds", q))


def _sla(measured: DataFrame) -> DataFrame:
    return (
        measured.select(
            "highway",
            F.col("n").alias("tx_count"),
            F.col("mean").alias("avg_processing_sec"),
            F.col("pct").alias("p95_processing_sec"),
        )
        .orderBy(F.desc("avg_processing_sec"), "highway")
    )


def distinct_vehicles(mart: Mart) -> DataFrame:
    """(level, item, vehicles): exact distinct vehicles of each day, week and highway, from the stored bitmaps."""
    bits = mart.table("agg_vehicle_bits").join(mart.dim_plaza.select("plaza_id", "highway"), "plaza_id")
    day = F.make_date(F.floor(F.col("date_id") / 10000), F.floor(F.col("date_id") / 100) % 100, F.col("date_id") % 100)
    levels = {"day": day.cast("string"), "week": F.date_trunc("week", day).cast("date").cast("string"), "highway": F.col("highway")}
    parts = F.array(*[F.struct(F.lit(name).alias("level"), item.alias("item")) for name, item in levels.items()])
    return count_vehicles(bits.select(F.explode(parts).alias("_l"), "bucket", "bits").select("_l.*", "bucket", "bits"), ["level", "item"])
