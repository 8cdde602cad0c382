"""Registered queries: every operator over the given tables, with its SQL twin in `duckdb_sql.py`."""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date, datetime, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from gantry.functions.charges import charge  # noqa: E402
from gantry.operators import dims, drift, events as ev, facts as fa, offsets, quality  # noqa: E402
from gantry.plans import kpis, lookups  # noqa: E402
from gantry.plans.mart import Mart, mart_from_events, read_mart  # noqa: E402
from gantry.plans.nightly import builds, late_days, load_days  # noqa: E402
from gantry.schemas import EXTRA  # noqa: E402
from gantry.session import prepare, scratch_dir  # noqa: E402
from gantry.sources import colocated, testdata  # noqa: E402
from gantry.sources.readers import read_raw  # noqa: E402
from gantry.sources.writers import write_raw, write_table  # noqa: E402
from gantry.streaming import landing, progress  # noqa: E402
import duckdb_sql  # noqa: E402

try:
    import corpus_pipeline
    from gantry.llm import queries as llm_queries
except ModuleNotFoundError as missing:  # both may be left out together; anything else that is missing is a fault
    if missing.name != "corpus_pipeline" and not (missing.name or "").startswith("gantry.llm"):
        raise
    llm_queries = None

AS_OF = date(2024, 1, 30)
NOW = datetime(2024, 1, 31)
TAG = "TAG-00042"

EVENT_COLUMNS = [
    "transaction_id", "plaza_id", "plaza_name", "highway", "tag_id", "vehicle_no", "class_id", "class_name",
    "amount", "balance_before", "balance_after", "status", "lane", "event_ts",
]
HOUR_COLUMNS = ["year", "month", "day", "hour"]

#: Days that a query over facts in memory goes back from AS_OF; the scan is narrowed by the same number.
DAYS = {"revenue_today": 0, "heatmap": 1, "class_share": AS_OF.day - 1, "weekend": 30}


def _portable(df: DataFrame) -> DataFrame:
    """Money as DOUBLE in the result only, so that any client compares it alike."""
    decimals = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.select(*[F.col(c).cast("double").alias(c) if c in decimals else F.col(c) for c in df.columns])


def _raw(spark: SparkSession, sf_dir: str, since: date | None = None, before: date | None = None) -> DataFrame:
    return testdata.raw_events(prepare(spark), sf_dir, since, before)


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.validate_and_enrich(_raw(spark, sf_dir))


def _valid_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `_valid`, for the raw zone, which takes every column."""
    return ev.validate_and_enrich(_raw_whole(spark, sf_dir))


def _raw_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.worked_out(testdata.raw_events(prepare(spark), sf_dir, dealt=True))


def _mart(spark: SparkSession, sf_dir: str, days: int | None = None) -> Mart:
    """The mart over the events; `days` repeats the query's own date range for the scan."""
    return mart_from_events(spark, _raw(spark, sf_dir, None if days is None else AS_OF - timedelta(days=days)))


def _whole_vehicles(mart: Mart, spark: SparkSession, sf_dir: str) -> Mart:
    """A date-limited mart with the vehicles of all events: a plate may have been seen earlier."""
    return mart.with_tables(dim_vehicle=lambda: dims.vehicles(ev.valid_events(_raw(spark, sf_dir))))


def _low_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.low_balance(_whole_vehicles(_mart(spark, sf_dir, days=0), spark, sf_dir), NOW)


def _sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = kpis.highway_sla(_stored_mart(spark, sf_dir), AS_OF)
    return report.withColumns({c: F.round(c, 6) for c in ("avg_processing_sec", "p95_processing_sec")})


def _sla_from_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = kpis.highway_sla_stored(_stored_mart(spark, sf_dir), AS_OF)
    return report.withColumns({c: F.round(c, 6) for c in ("avg_processing_sec", "p95_processing_sec")})


def _all_plazas(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The seeds and, inactive, the plazas that only the events know."""
    found = events.groupBy("plaza_id").agg(F.max("highway").alias("highway")).select(
        "plaza_id", F.concat(F.lit("Plaza "), "plaza_id").alias("name"), "highway", F.lit(0).cast("smallint").alias("active"))
    seeds = dims.plaza_seed(spark)
    return seeds.unionByName(dims.absent_rows(found, seeds, ["plaza_id"]), allowMissingColumns=True)


def _active_plazas(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _valid(spark, sf_dir)
    return lookups.active_plazas(Mart(dim_plaza=lambda: _all_plazas(spark, valid)))


def _day_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked rows of the day under test: the faults are what the checks look for."""
    raw = _raw(spark, sf_dir, AS_OF, AS_OF + timedelta(days=1))
    return raw.withColumn("date_id", fa.date_id("event_ts"))


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts beside the tag that their surrogate key was made of."""
    return fa.conform(fa.clean_events(_valid(spark, sf_dir)), dims.payment_seed(spark), carry=["tag_id"]).select(
        "transaction_id", "plaza_id", "tag_id", "date_id", "class_id", "payment_id", "amount", "entry_time",
        "exit_time", "lane",
    )


def _all_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark, sf_dir)
    return (
        mart.facts.join(mart.dim_payment.select("payment_id", "status"), "payment_id", "left")
        .groupBy("status", "date_id")
        .agg(F.count("*").alias("tx_count"), F.sum("amount").alias("amount"))
    )


def _trend(facts: DataFrame) -> DataFrame:
    return kpis.monthly_trend(facts)


def _flag_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blacklist is a table worked out from the data: tags that ever sent a negative charge."""
    raw = _raw(spark, sf_dir)
    return ev.flag_from_table(raw, raw.where("amount < 0")).select("event_id", "transaction_id", "tag_id", "status")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.as_messages(_raw(spark, sf_dir))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select(F.col("value").cast("string").alias("value"))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_events(_messages(spark, sf_dir), keep=[ev.PAYLOAD])
    return ev.quarantine(parsed).select("payload", "transaction_id", "tag_id", "amount", "status", "event_ts", "reason")


def _stream(spark: SparkSession, sf_dir: str, work: str) -> DataFrame:
    """Events as a stream of JSON messages in order of time and in several triggers, parsed and validated."""
    landing.keep_state_on_disk(spark)
    messages = testdata.as_messages(testdata.stream_in_order_of_time(prepare(spark), sf_dir, f"{work}/feed"))
    return ev.validate_and_enrich(ev.parse_events(messages, keep=["offset"]))


def _load_all(spark: SparkSession, sf_dir: str) -> str:
    """The nightly job over every day: raw zone, load, gate; the mart's root."""
    work = scratch_dir(spark, "nightly")
    write_raw(_valid_whole(spark, sf_dir), f"{work}/raw", "backfill")
    raw = read_raw(spark, f"{work}/raw")
    # The gate opens only when every plaza is known, so the unseeded ones are added first.
    write_table(_all_plazas(spark, raw), f"{work}/mart", "dim_plaza")
    load_days(spark, raw, f"{work}/mart", _landed_days(raw))
    return f"{work}/mart"


def _fact_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of events that were partly sent again a week later, whichever days are loaded first."""
    work = scratch_dir(spark, "unique")
    root = f"{work}/mart"
    write_raw(ev.validate_and_enrich(testdata.sent_again(_raw_whole(spark, sf_dir))), f"{work}/raw", "all")
    raw = read_raw(spark, f"{work}/raw")
    write_table(_all_plazas(spark, raw), root, "dim_plaza")
    days = _landed_days(raw)
    load_days(spark, raw, root, days[len(days) // 2:])
    # These take transactions back from days of the other half, which are loaded once more with them.
    load_days(spark, raw, root, days[:len(days) // 2])
    return read_mart(spark, root).facts.select("transaction_id", "date_id", "plaza_id", "class_id", "payment_id", "amount", "entry_time")


def _landed_days(raw: DataFrame) -> list[date]:
    """Days of the zone, from its folders: no row is read for them."""
    return sorted(date(*row) for row in raw.select("year", "month", "day").distinct().collect())


def _nightly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals as the nightly job leaves them."""
    return read_mart(spark, _load_all(spark, sf_dir)).hourly.drop("loaded_at")


_STORED: dict[tuple[str, str, str], str] = {}


def _stored_root(spark: SparkSession, sf_dir: str) -> str:
    """A mart on disk, loaded once for a session and a state of the events' files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamps = events.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, sf_dir, str(sorted(map(tuple, stamps))))
    if key not in _STORED:
        _STORED[key] = _load_all(spark, sf_dir)
    return _STORED[key]


def _stored_mart(spark: SparkSession, sf_dir: str) -> Mart:
    """What applications read."""
    return read_mart(prepare(spark), _stored_root(spark, sf_dir))


def _colocated(spark: SparkSession, sf_dir: str) -> str:
    """The stored mart's facts and vehicles once more by vehicle, in two loads; the database."""
    root = _stored_root(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, f"by vehicle: {root}")
    if key not in _STORED:
        mart = read_mart(prepare(spark), root)
        place = scratch_dir(spark, "colocated")
        database = place.rsplit("/", 1)[1].replace("-", "_")
        colocated.create(spark, place, database, buckets=8)
        for half in ("date_id % 2 = 0", "date_id % 2 = 1"):
            colocated.store(mart.facts.where(half), mart.dim_vehicle, database, hot=25, slots=4)
        _STORED[key] = database
    return _STORED[key]


def _top_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _colocated(spark, sf_dir)
    return kpis.top_vehicles_colocated(colocated.facts_by_vehicle(spark, database), colocated.vehicles_by_id(spark, database))


def _stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "landing")
    query = landing.land_raw(_stream(spark, sf_dir, work).drop("offset"), f"{work}/raw", f"{work}/checkpoint", interval=None)
    landing.wait_all([query])
    return read_raw(spark, f"{work}/raw").select(*EVENT_COLUMNS, *HOUR_COLUMNS)


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "summary")
    query = landing.publish_summary(_stream(spark, sf_dir, work), f"{work}/summary", f"{work}/checkpoint", interval=None)
    landing.wait_all([query])
    return landing.read_summary(spark, f"{work}/summary")


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "dedup")
    once = landing.first_seen(_stream(spark, sf_dir, work), position="offset").drop("offset")
    query = landing.land_rows(once, f"{work}/once", f"{work}/checkpoint", interval=None)
    landing.wait_all([query])
    return spark.read.parquet(f"{work}/once").select(*EVENT_COLUMNS)


def _stream_one_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary from the totals that one read of the stream left beside the raw zone and the quarantine."""
    work = scratch_dir(spark, "one")
    messages = testdata.as_messages(testdata.stream_in_order_of_time(prepare(spark), sf_dir, f"{work}/feed"))
    landing.wait_all([landing.land_all(messages, work, f"{work}/checkpoint", interval=None)])
    landing.merge_totals(spark, f"{work}/totals", keep=2)
    return landing.read_totals(spark, f"{work}/totals")


def _ingest_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one read of the stream landed and rejected, and how many triggers' sinks hold something else."""
    work = scratch_dir(spark, "balance")
    messages = testdata.as_messages(testdata.stream_in_order_of_time(prepare(spark), sf_dir, f"{work}/feed", parts=3))
    landing.wait_all([landing.land_all(messages, work, f"{work}/checkpoint", interval=None)])
    sums = [F.sum(c).alias(c) for c in ("messages", "landed", "rejected", "raw_rows", "rejected_rows")]
    return progress.ingest_balance(spark, work).agg(*sums, F.count_if(~F.col("balanced")).alias("unbalanced"))


def _offset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost and repeated offsets, from the ranges that each day's load kept."""
    kept = f"{scratch_dir(spark, 'offsets')}/ranges"
    came = testdata.delivered(prepare(spark).read.parquet(f"{sf_dir}/events.parquet"))
    offsets.offset_ranges(came, (*offsets.SOURCE, "day")).write.parquet(kept)
    return offsets.audit(spark.read.parquet(kept))


def _landed_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the event schema does not know, as the raw zone keeps them."""
    work = scratch_dir(spark, "extra")
    messages = testdata.with_new_fields(testdata.raw_events(prepare(spark), sf_dir, dealt=True))
    write_raw(ev.validate_and_enrich(ev.parse_events(messages, keep=[EXTRA])), f"{work}/raw", "all")
    return read_raw(spark, f"{work}/raw").where(F.col(EXTRA).isNotNull()).select("transaction_id", "event_ts", "lane", EXTRA)


def _event_days(valid: DataFrame) -> DataFrame:
    return dims.date_rows(valid.select(F.to_date("event_ts").alias("date")).distinct())


def _absent_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event days that a date table loaded up to the middle of the month lacks."""
    valid = _valid(spark, sf_dir)
    existing = _event_days(valid.where("day <= 15"))
    return dims.absent_rows(_event_days(valid), existing, ["date_id"]).select("date_id", "date")


def _vehicle_columns(vehicles: DataFrame) -> DataFrame:
    return vehicles.select("tag_id", "vehicle_no", "owner_name", "registered_state", "active")


def _merged_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles of the first half of the month merged with those of the second, newest first."""
    valid = _valid(spark, sf_dir)
    early, late = valid.where("day <= 15"), valid.where("day > 15")
    return _vehicle_columns(dims.merge_vehicles(dims.vehicles(late), dims.vehicles(early)))


def _upserted_plazas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plazas that sent events without a name replace, or join, the known ones."""
    per_plaza = _valid(spark, sf_dir).groupBy("plaza_id").agg(
        F.max("highway").alias("highway"), F.count_if(F.col("plaza_name").isNull()).alias("nameless")
    )
    new = per_plaza.where("nameless > 0").select(
        "plaza_id", F.concat(F.lit("Plaza "), "plaza_id").alias("name"), "highway"
    )
    return dims.upsert(dims.plaza_seed(spark).select("plaza_id", "name", "highway"), new, ["plaza_id"])


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to load again: rows that came in after one o'clock the night after are landed when all days but the last are built."""
    work = scratch_dir(spark, "late")
    valid = _valid_whole(spark, sf_dir)
    on_time = F.col("ingested_at") <= F.date_trunc("DAY", "event_ts") + F.expr("INTERVAL 25 HOURS")
    write_raw(valid.where(on_time), f"{work}/raw", "first")
    write_table(_all_plazas(spark, _valid(spark, sf_dir)), f"{work}/mart", "dim_plaza")
    first = read_raw(spark, f"{work}/raw")
    days = sorted(row["date"] for row in _event_days(first).collect())
    load_days(spark, first, f"{work}/mart", days[:-1])
    write_raw(valid.where(~on_time), f"{work}/raw", "second")
    return late_days(read_raw(spark, f"{work}/raw"), builds(spark, f"{work}/mart"))


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List price of as many trips as the lane has, by class."""
    priced = _valid(spark, sf_dir).join(dims.class_seed(spark).select("class_id", "base_rate"), "class_id")
    return priced.select("event_id", "transaction_id", "class_id", "lane", charge("base_rate", "lane").alias("charge"))


def entry(spark: SparkSession) -> DataFrame:
    """Revenue per plaza over the last seven days, straight from the events."""
    return _portable(kpis.plaza_revenue(_mart(spark, "/root/testdata/sf0.001", days=7), AS_OF))


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that need no other subpackage, with the types they have in the library."""
    return {
        "kpi_revenue_today": lambda s, d: kpis.revenue_today(_mart(s, d, DAYS["revenue_today"]), AS_OF),
        "kpi_plaza_revenue_7d": lambda s, d: kpis.plaza_revenue(_stored_mart(s, d), AS_OF),
        "kpi_hourly_heatmap": lambda s, d: kpis.hourly_heatmap(_mart(s, d, DAYS["heatmap"]), AS_OF, DAYS["heatmap"]),
        "kpi_class_share": lambda s, d: kpis.class_share(_mart(s, d, DAYS["class_share"]), AS_OF),
        "kpi_top_vehicles": lambda s, d: kpis.top_vehicles(_stored_mart(s, d)),
        "top_vehicles_colocated": _top_colocated,
        "kpi_flagged_report": lambda s, d: kpis.flagged_report(_stored_mart(s, d)),
        "kpi_weekend_weekday": lambda s, d: kpis.weekend_weekday(_mart(s, d, DAYS["weekend"]), AS_OF, DAYS["weekend"]),
        "kpi_monthly_trend": lambda s, d: _trend(_mart(s, d).revenue),
        "kpi_monthly_trend_lineitem": lambda s, d: _trend(testdata.lineitem_facts(prepare(s), d)),
        "kpi_low_balance_24h": _low_balance,
        "kpi_highway_sla": _sla,
        "sla_from_histogram": _sla_from_histogram,
        "distinct_vehicles": lambda s, d: kpis.distinct_vehicles(_stored_mart(s, d)),
        "api_active_plazas": _active_plazas,
        "api_day_summary": lambda s, d: lookups.day_summary(
            mart_from_events(s, _raw(s, d, AS_OF, AS_OF + timedelta(days=1))), AS_OF),
        "api_vehicle_history": lambda s, d: lookups.vehicle_history(_stored_mart(s, d), TAG),
        "fact_transactions": lambda s, d: fa.fact_transactions(_valid(s, d)).drop("ingested_at"),
        "hourly_revenue": lambda s, d: _mart(s, d).hourly,
        "hourly_revenue_raw": lambda s, d: fa.hourly_revenue(_valid(s, d)),
        "parse_events": lambda s, d: ev.parse_events(_messages(s, d)),
        "validate_enrich": lambda s, d: _valid(s, d).select(*EVENT_COLUMNS, *HOUR_COLUMNS),
        "quarantine": lambda s, d: ev.quarantine(_raw(s, d)).select(
            "event_id", "transaction_id", "tag_id", "amount", "event_ts", "reason"),
        "quarantine_messages": _rejected,
        "flag_from_table": _flag_from_table,
        "encode_events": _encoded,
        "stream_raw_landing": _stream_landing,
        "stream_live_summary": _stream_summary,
        "stream_dedup": _stream_dedup,
        "stream_one_read": _stream_one_read,
        "ingest_balance": _ingest_balance,
        "offset_audit": _offset_audit,
        "schema_drift": lambda s, d: drift.drift_report(testdata.with_new_fields(_raw(s, d))).where("NOT known OR n_lost > 0"),
        "extra_fields_landed": _landed_extra,
        "dq_report": lambda s, d: quality.report(_day_facts(s, d), dims.plaza_seed(s), AS_OF),
        "dq_row_count": lambda s, d: quality.row_count(_day_facts(s, d), AS_OF),
        "dq_null_ids": lambda s, d: quality.null_ids(_day_facts(s, d), AS_OF),
        "dq_amount_range": lambda s, d: quality.amount_range(_day_facts(s, d), AS_OF),
        "dq_duplicates": lambda s, d: quality.duplicates(_day_facts(s, d), AS_OF),
        "dq_orphan_plazas": lambda s, d: quality.orphan_plazas(_day_facts(s, d), dims.plaza_seed(s), AS_OF),
        "dim_date": lambda s, d: _event_days(_valid(s, d)),
        "dim_date_absent": _absent_dates,
        "dim_vehicle": lambda s, d: _vehicle_columns(dims.vehicles(_valid(s, d))),
        "dim_vehicle_merge": _merged_vehicles,
        "plaza_upsert": _upserted_plazas,
        "fact_conformed": _conformed,
        "enrich_class_rate": lambda s, d: ev.with_class_rate(_valid(s, d), dims.class_seed(s)).select(
            "event_id", "transaction_id", "class_id", "amount", "expected_amount", "trips"),
        "charge_rule": _charges,
        "classify_status": lambda s, d: ev.classify_status(_raw(s, d)).select(
            "event_id", "transaction_id", "tag_id", "balance_before", "amount", "status"),
        "fact_all_statuses": _all_statuses,
        "fact_unique": _fact_unique,
        "late_repair": _late,
        "nightly_load": _nightly,
    }


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, plan=plan: _portable(plan(s, d))) for name, plan in plans().items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | (llm_queries.queries() | {"pipeline": corpus_pipeline.run} if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    return duckdb_sql.all_sql() | (llm_queries.oracle_sql() if llm_queries else {})
