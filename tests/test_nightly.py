"""Loading days into a mart on disk, reading it, loading again."""

import shutil
from datetime import date, datetime

import pytest
from compare import duck_rows, plan_text, spark_rows
from pyspark.sql import functions as F

from __spark_entry__ import AS_OF, NOW, TAG, _portable, oracle_sql
from gantry.operators import dims, quality
from gantry.operators.events import validate_and_enrich
from gantry.plans import kpis, lookups, nightly
from gantry.plans.mart import read_mart
from gantry.plans.nightly import builds, compact_raw, late_days, load_days, repair_late
from gantry.session import scratch_dir, settings
from gantry.sources import files
from gantry.sources.catalog import register_raw_zone
from gantry.sources.readers import on_days, read_raw
from gantry.sources.testdata import raw_events
from gantry.sources.writers import read_table, write_raw, write_table

DAYS = [date(2024, 1, d) for d in range(1, 31)]


def land(events, root, load="first"):
    write_raw(events, root, load)


def all_plazas(spark):
    """The seeds and the plaza the data has beside them, so that the gate opens."""
    extra = dims.plaza_seed(spark).where("plaza_id = 'PL001'").withColumns(
        {"plaza_id": F.lit("PL006"), "name": F.lit("Sixth"), "highway": F.lit("NH-0"), "active": F.lit(0).cast("smallint")})
    return dims.plaza_seed(spark).unionByName(extra)


@pytest.fixture(scope="module")
def zone(spark, sf):
    """A raw zone with every day, and a mart loaded from it in two runs."""
    root = scratch_dir(spark, "zone")
    events = validate_and_enrich(raw_events(spark, sf)).withColumn("hour", F.expr("hour DIV 12"))
    land(events, f"{root}/raw")
    write_table(all_plazas(spark), f"{root}/mart", "dim_plaza")
    raw = read_raw(spark, f"{root}/raw")
    first = load_days(spark, raw, f"{root}/mart", DAYS[15:])
    second = load_days(spark, raw, f"{root}/mart", DAYS[:15])
    return raw, f"{root}/mart", first, second


def test_run_report(zone):
    _, _, first, second = zone
    assert first.facts + second.facts == 953
    # Five checks a day, and one of the vehicles.
    assert len(first.checks) == 5 * 15 + 1 and all(c["passed"] for c in first.checks + second.checks)


def tables(spark, root):
    drop = {"agg_hourly_revenue": ["loaded_at"], "dim_vehicle": []}
    mart = read_mart(spark, root)
    names = ("fact_transaction", "agg_hourly_revenue", "dim_vehicle", "dim_date", "dim_plaza", "dim_class", "dim_payment")
    return {n: spark_rows(mart.table(n).drop(*drop.get(n, []))) for n in names}


def test_mart_answers_the_queries(spark, sf, zone):
    mart = read_mart(spark, zone[1])
    seeds = dims.plaza_seed(spark)
    known = mart.with_tables(dim_plaza=lambda: mart.table("dim_plaza").join(seeds.select("plaza_id"), "plaza_id"))
    whole = mart.with_tables(dim_plaza=lambda: mart.table("dim_plaza").withColumns({
        "name": F.when(F.col("plaza_id") == "PL006", "Plaza PL006").otherwise(F.col("name")),
        "highway": F.when(F.col("plaza_id") != "PL006", F.col("highway"))}))
    answers = {
        "kpi_revenue_today": kpis.revenue_today(known, AS_OF),
        "kpi_plaza_revenue_7d": kpis.plaza_revenue(whole, AS_OF),
        "kpi_hourly_heatmap": kpis.hourly_heatmap(known, AS_OF),
        "kpi_class_share": kpis.class_share(known, AS_OF),
        "kpi_top_vehicles": kpis.top_vehicles(known),
        "kpi_flagged_report": kpis.flagged_report(whole),
        "kpi_weekend_weekday": kpis.weekend_weekday(known, AS_OF),
        "kpi_monthly_trend": kpis.monthly_trend(known.revenue, known.dim_date),
        "kpi_low_balance_24h": kpis.low_balance(known, NOW),
        "kpi_highway_sla": kpis.highway_sla(whole, AS_OF).withColumns(
            {c: F.round(c, 6) for c in ("avg_processing_sec", "p95_processing_sec")}),
        "api_day_summary": lookups.day_summary(known, "2024-01-30"),
        "api_vehicle_history": lookups.vehicle_history(known, TAG),
    }
    assert not answers["kpi_highway_sla"].isEmpty()  # exit times come through the raw zone
    for name, answer in answers.items():
        assert spark_rows(_portable(answer)) == duck_rows(oracle_sql()[name], sf)[1], name


def test_loading_again_changes_nothing(spark, zone):
    raw, root, _, _ = zone
    before = tables(spark, root)
    load_days(spark, raw, root, [DAYS[3], DAYS[20]])
    assert tables(spark, root) == before


def test_dates_are_loaded_before_facts(spark, zone):
    mart = read_mart(spark, zone[1])
    assert mart.facts.join(mart.dim_date, "date_id", "left_anti").isEmpty()
    assert mart.dim_date.count() == 30


def test_vehicle_keys_are_unique_and_complete(spark, zone):
    mart = read_mart(spark, zone[1])
    assert dims.repeated_vehicle_ids(mart.dim_vehicle).isEmpty()
    assert mart.facts.join(mart.dim_vehicle, "vehicle_id", "left_anti").isEmpty()


def test_days_prune_partitions(spark, zone):
    raw, root, _, _ = zone
    day = raw.where(on_days([date(2024, 1, 5)]))
    assert "PartitionFilters: [isnotnull(year" in plan_text(day)
    assert {r[0] for r in day.select(F.to_date("event_ts")).distinct().collect()} == {date(2024, 1, 5)}


def test_date_filter_reaches_fact_partitions(spark, zone):
    plan = plan_text(kpis.plaza_revenue(read_mart(spark, zone[1]), AS_OF))
    assert "dynamicpruning" in plan
    assert "SortMergeJoin" not in plan


def test_history_filter_reaches_the_fact_scan(spark, zone):
    plan = plan_text(lookups.vehicle_history(read_mart(spark, zone[1]), TAG))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "transaction_id" in line)
    assert "EqualTo(vehicle_id," in scan


def test_missing_day_stops_before_anything_is_written(spark, zone):
    raw, root, _, _ = zone
    empty = scratch_dir(spark, "empty")
    with pytest.raises(FileNotFoundError, match="2024-02-01"):
        load_days(spark, raw, empty, [DAYS[0], date(2024, 2, 1)])
    with pytest.raises(Exception):
        read_table(spark, empty, "dim_date")


def test_gate_stops_on_unknown_plaza(spark, zone):
    raw, _, _, _ = zone
    other = scratch_dir(spark, "gate")
    with pytest.raises(quality.DataQualityError, match="valid_plaza_ids"):
        load_days(spark, raw, other, [DAYS[0]])
    assert read_table(spark, other, "fact_transaction").count() > 0


def test_late_rows_are_repaired(spark, sf):
    root = scratch_dir(spark, "late")
    events = validate_and_enrich(raw_events(spark, sf)).where("day <= 3").withColumn("hour", F.lit(0))
    on_time = events.withColumn("ingested_at", F.lit(datetime(2024, 1, 5)))
    # Stamped before the build that will not have seen them.
    late = on_time.withColumn("ingested_at", F.lit(datetime(2024, 1, 4))).where("day = 2").limit(3)
    late = late.withColumn("transaction_id", F.concat(F.lit("late-"), "transaction_id"))
    write_table(all_plazas(spark), f"{root}/mart", "dim_plaza")
    land(on_time, f"{root}/raw")
    raw = read_raw(spark, f"{root}/raw")
    loaded = load_days(spark, raw, f"{root}/mart", DAYS[:3])
    assert repair_late(spark, raw, f"{root}/mart") is None

    land(late, f"{root}/raw", "second")
    raw = read_raw(spark, f"{root}/raw")
    found = late_days(raw, builds(spark, f"{root}/mart")).collect()
    assert [(r["date_id"], r["late_rows"]) for r in found] == [(20240102, 3)]
    repaired = repair_late(spark, raw, f"{root}/mart")
    assert repaired.days == (DAYS[1],)
    assert read_table(spark, f"{root}/mart", "fact_transaction").count() == loaded.facts + 3
    assert repair_late(spark, read_raw(spark, f"{root}/raw"), f"{root}/mart") is None

    # Merging the folders changes no rows, and nothing is late for it.
    before = spark_rows(read_raw(spark, f"{root}/raw").drop("load"))
    assert compact_raw(spark, f"{root}/raw", f"{root}/mart", DAYS[1]) == 2
    assert spark_rows(read_raw(spark, f"{root}/raw").drop("load")) == before
    assert {r["load"].split("-")[0] for r in read_raw(spark, f"{root}/raw").where("day = 2").select("load").distinct().collect()} == {"compact"}
    assert repair_late(spark, read_raw(spark, f"{root}/raw"), f"{root}/mart") is None
    assert compact_raw(spark, f"{root}/raw", f"{root}/mart", DAYS[0]) == 0


def test_a_day_without_revenue_is_built_once_and_leaves_no_old_hours(spark, sf):
    root = scratch_dir(spark, "failed")
    day = validate_and_enrich(raw_events(spark, sf)).where("day = 4").withColumn("hour", F.lit(0))
    write_table(all_plazas(spark), f"{root}/mart", "dim_plaza")
    land(day.withColumn("status", F.lit("SUCCESS")), f"{root}/raw")
    assert load_days(spark, read_raw(spark, f"{root}/raw"), f"{root}/mart", [DAYS[3]]).hourly > 0

    land(day.withColumn("status", F.lit("LOW_BALANCE")), f"{root}/raw")  # the same load again, all deductions failed
    raw = read_raw(spark, f"{root}/raw")
    again = load_days(spark, raw, f"{root}/mart", [DAYS[3]])
    assert again.facts > 0 and again.hourly == 0
    mart = read_mart(spark, f"{root}/mart")
    assert mart.revenue.isEmpty() and not files.exists(spark, f"{root}/mart/agg_hourly_revenue/date_id=20240104")
    assert repair_late(spark, raw, f"{root}/mart") is None


def test_a_failed_gate_leaves_the_day_unbuilt(spark, sf):
    root = scratch_dir(spark, "unbuilt")
    land(validate_and_enrich(raw_events(spark, sf)).where("day = 5").withColumn("hour", F.lit(0)), f"{root}/raw")
    raw = read_raw(spark, f"{root}/raw")
    with pytest.raises(quality.DataQualityError):
        load_days(spark, raw, f"{root}/mart", [DAYS[4]])
    assert [r["date_id"] for r in late_days(raw, builds(spark, f"{root}/mart")).collect()] == [20240105]


def test_vehicle_snapshots_do_not_pile_up(spark, zone):
    raw, root, _, _ = zone
    for _ in range(3):
        load_days(spark, raw, root, [DAYS[0]])
    assert len([n for n in files.children(spark, f"{root}/dim_vehicle") if n.startswith("snapshot=")]) == 2


def test_a_stop_while_publishing_leaves_a_pointer(spark, zone, monkeypatch):
    raw, root, _, _ = zone
    vehicles = read_mart(spark, root).dim_vehicle.count()

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("create_text", "remove"):  # before the new pointer is there, and before older ones go
        with monkeypatch.context() as patched:
            patched.setattr(files, step, stop)
            with pytest.raises(KeyboardInterrupt):
                load_days(spark, raw, root, [DAYS[0]])
        assert read_mart(spark, root).dim_vehicle.count() == vehicles
    load_days(spark, raw, root, [DAYS[0]])
    names = files.children(spark, f"{root}/dim_vehicle")
    assert read_mart(spark, root).dim_vehicle.count() == vehicles
    assert len([n for n in names if n.startswith("_current-")]) == 2


def test_lost_pointers_are_an_error_and_no_new_start(spark, zone, tmp_path):
    shutil.copytree(zone[1].removeprefix("file:"), f"{tmp_path}/mart")
    for name in files.children(spark, f"{tmp_path}/mart/dim_vehicle"):
        if name.startswith("_current-"):
            files.remove(spark, f"{tmp_path}/mart/dim_vehicle/{name}")
    with pytest.raises(FileNotFoundError, match="no published vehicles"):
        load_days(spark, zone[0], f"{tmp_path}/mart", [DAYS[0]])
    with pytest.raises(FileNotFoundError, match="no published vehicles yet"):
        read_mart(spark, f"{tmp_path}/none").dim_vehicle


@pytest.mark.parametrize("kpi,first", [
    (lambda m: kpis.low_balance(m, NOW), 20240130), (lambda m: kpis.highway_sla(m, AS_OF), 20240123)])
def test_bounds_on_time_reach_the_folders(spark, zone, kpi, first):
    scans = [line for line in plan_text(kpi(read_mart(spark, zone[1]))).splitlines() if "FileScan" in line and "entry_time" in line]
    assert scans and all(f"(date_id" in s and f">= {first})" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)


def test_the_trend_reads_its_facts_once(spark, zone):
    plan = plan_text(kpis.monthly_trend(read_mart(spark, zone[1]).facts)).split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_two_tags_with_one_key_stop_the_gate(spark):
    twice = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "vehicle_id BIGINT, tag_id STRING")
    facts = spark.createDataFrame([("T", "PL001", 1.0, 20240101)], "transaction_id STRING, plaza_id STRING, amount DOUBLE, date_id INT")
    with pytest.raises(quality.DataQualityError, match="unique_vehicle_keys: expected 0, observed 1"):
        quality.gate(facts, dims.plaza_seed(spark), [DAYS[0]], twice)


def test_history_limits(spark, zone):
    mart = read_mart(spark, zone[1])
    for bad in (0, 101):
        with pytest.raises(ValueError):
            lookups.vehicle_history(mart, TAG, bad)
    assert lookups.vehicle_history(mart, "TAG-NONE").isEmpty()


def test_summary_of_an_empty_day_is_zero(spark, zone):
    mart = read_mart(spark, zone[1])
    row = lookups.day_summary(mart, "2031-01-01").first()
    assert (float(row["total_revenue"]), row["tx_count"], row["unique_vehicles"], row["flagged_count"]) == (0.0, 0, 0, 0)
    assert kpis.revenue_today(mart, date(2031, 1, 1)).first()["total_transactions"] == 0
    with pytest.raises(ValueError):
        lookups.day_summary(mart, "30.01.2024")


def test_late_days_are_known_before_a_file_is_opened(spark, sf):
    work = scratch_dir(spark, "unread")
    rows = validate_and_enrich(raw_events(spark, sf)).where("hour BETWEEN 5 AND 9")
    write_raw(rows.where("day BETWEEN 3 AND 6"), f"{work}/raw", "a+b %c")
    write_raw(rows.where("day IN (4, 20)"), f"{work}/raw", "late")
    register_raw_zone(spark, f"{work}/raw", "unread_zone")
    read = spark.createDataFrame([(20240100 + d, "a+b %c") for d in (3, 4, 5, 6)], "date_id INT, load STRING")
    for raw in (read_raw(spark, f"{work}/raw"), spark.table("unread_zone")):
        with settings(spark, spark__sql__optimizer__metadataOnly="true"):
            known = nightly.unread_loads(raw, read).select("year", "month", "day").distinct()
            assert "FileScan" not in known._jdf.queryExecution().executedPlan().toString()
        assert nightly.unread_days(raw, read) == [date(2024, 1, 4), date(2024, 1, 20)]
        late = nightly.late_days(raw, read)
        scans = [line for line in late._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
        assert scans and all("PartitionFilters: []" not in line for line in scans)
        want = rows.where("day IN (4, 20)").groupBy("day").count().collect()
        assert {(r["date_id"], r["late_rows"]) for r in late.collect()} == {(20240100 + r["day"], r["count"]) for r in want}
    assert nightly.late_days(raw, nightly.unread_loads(raw, read.limit(0)).select(nightly.folder_day().alias("date_id"), "load")).count() == 0
