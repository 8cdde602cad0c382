"""Hot keys, brute force on small fixtures, and what the plans must look like."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from compare import duck_rows, plan_text, spark_rows
from pyspark.sql import functions as F

import duckdb_sql
from __spark_entry__ import _mart
from __spark_entry__ import own_queries as queries
from gantry.operators import dims
from gantry.operators.events import validate_and_enrich
from gantry.operators.facts import first_copy
from gantry.operators.percentiles import mean_and_percentile
from gantry.plans import kpis
from gantry.session import scratch_dir
from gantry.sources import catalog
from gantry.sources.testdata import raw_events
from gantry.sources.writers import jdbc_writer, write_raw

EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

STORED = ["kpi_plaza_revenue_7d", "kpi_top_vehicles", "kpi_flagged_report", "kpi_highway_sla", "api_vehicle_history"]
BATCH = sorted(name for name in queries() if not name.startswith("stream_") and not name.endswith("_lineitem")
               and name not in ("nightly_load", "late_repair"))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows from one tag, and copies of single events in their dozens."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        user = 42 if i % 3 == 0 else rng.randrange(400)
        ts = start + timedelta(seconds=rng.randrange(30 * 86400), microseconds=rng.randrange(10**6))
        rows.append((i, ts, user, rng.choice(["view", "error", "click"]), round(rng.uniform(0, 430), 2),
                     '{"k": %d}' % rng.randrange(100)))
    rows += [rows[30]] * 700 + [rows[77]] * 300
    root = scratch_dir(spark, "skewed")
    spark.createDataFrame(rows, EVENTS_DDL).repartition(8).write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", BATCH)
def test_skewed_data_gives_the_same(spark, skewed, name):
    columns, want = duck_rows(duckdb_sql.all_sql()[name], "/root/testdata/sf0.001", events=f"{skewed}/events.parquet/*.parquet")
    result = queries()[name](spark, skewed)
    assert sorted(result.columns) == columns
    assert spark_rows(result) == want


def test_copies_are_cut_before_the_shuffle(spark, sf):
    lines = plan_text(first_copy(raw_events(spark, sf), ["transaction_id"])).split("== Physical Plan ==")[1].splitlines()
    where = [i for i, line in enumerate(lines) if "Exchange" in line or "WindowGroupLimit" in line]
    kinds = ["Partial" if "Partial" in lines[i] else "Final" if "Final" in lines[i] else "Exchange" for i in where]
    assert kinds == ["Final", "Exchange", "Partial"]


@pytest.mark.parametrize("name", ["kpi_revenue_today", "kpi_class_share", "kpi_weekend_weekday", "dq_report", "api_day_summary"])
def test_date_range_reaches_the_scan(spark, sf, name):
    assert "GreaterThanOrEqual(ts," in plan_text(queries()[name](spark, sf))


@pytest.mark.parametrize("name", BATCH)
def test_plans_have_no_cross_join_and_no_python(spark, sf, name):
    plan = plan_text(queries()[name](spark, sf)).split("== Physical Plan ==")[1]
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "InPandas"):
        assert word not in plan


def fact_scans(df):
    """Scans of the stored facts in a plan: no other table has money or times of passage."""
    lines = plan_text(df).split("== Physical Plan ==")[1].splitlines()
    return [line for line in lines if "FileScan" in line and ("amount" in line or "entry_time" in line)]


@pytest.mark.parametrize("name", STORED)
def test_stored_facts_are_read_by_the_columns_needed(spark, sf, name):
    scans = fact_scans(queries()[name](spark, sf))
    assert scans and all("ingested_at" not in line.split("ReadSchema: ")[1] for line in scans)


def test_stored_days_and_vehicles_prune(spark, sf):
    assert "dynamicpruning" in plan_text(queries()["kpi_plaza_revenue_7d"](spark, sf))
    assert any("EqualTo(vehicle_id," in line for line in fact_scans(queries()["api_vehicle_history"](spark, sf)))


@pytest.mark.parametrize("name", ["quarantine", "dim_date", "dim_vehicle", "dq_row_count"])
def test_only_needed_columns_are_read(spark, sf, name):
    scan = plan_text(queries()[name](spark, sf)).split("ReadSchema: ")[1].splitlines()[0]
    assert "props" not in scan


def test_vehicles_are_joined_after_aggregation(spark, sf):
    plan = plan_text(queries()["kpi_top_vehicles"](spark, sf)).split("== Physical Plan ==")[1]
    assert "TakeOrderedAndProject" in plan
    join = plan.index("Join [vehicle_id")
    assert plan.index("partial_sum(amount", join) > join


@pytest.mark.parametrize("seed", range(5))
def test_percentile_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.choice([None, 0, 1, rng.randrange(50), rng.randrange(10**9)])) for _ in range(200)]
    rows += [("hot", 5)] * 300 + [("one", 9)]
    q = [0.0, 0.5, 0.9, 0.95, 1.0][seed]
    got = {r["k"]: r for r in mean_and_percentile(spark.createDataFrame(rows, "k STRING, v BIGINT"), ["k"], "v", q).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        place = q * (len(values) - 1)
        low, high = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
        assert got[key]["n"] == len(values)
        assert got[key]["mean"] == pytest.approx(sum(values) / len(values))
        assert got[key]["pct"] == pytest.approx(low + (place - int(place)) * (high - low))


def test_sums_of_money_are_exact(spark):
    from gantry.functions.measures import mean_money, total

    rows = [(Decimal("0.01"),)] * 3 + [(Decimal("0.02"),)] * 3
    row = spark.createDataFrame(rows, "amount DECIMAL(10,2)").agg(total().alias("t"), mean_money().alias("m")).first()
    assert row["t"] == Decimal("0.09") and row["m"] == Decimal("0.02")


def test_catalog(spark, sf):
    root = scratch_dir(spark, "catalog")
    catalog.create_mart(spark, root, "mart_test")
    catalog.create_mart(spark, root, "mart_test")
    assert len(spark.catalog.listTables("mart_test")) == 8
    _mart(spark, sf).facts.limit(5).createOrReplaceTempView("some_facts")
    spark.sql("""INSERT INTO mart_test.fact_transaction SELECT transaction_id, plaza_id, vehicle_id, class_id, payment_id,
        amount, entry_time, exit_time, lane, ingested_at, date_id FROM some_facts""")
    assert spark.table("mart_test.fact_transaction").count() == 5

    raw = validate_and_enrich(raw_events(spark, sf)).limit(40).withColumn("hour", F.lit(0))
    write_raw(raw, f"{root}/raw", "one")
    catalog.register_raw_zone(spark, f"{root}/raw", "raw_test")
    assert spark.table("raw_test").count() == 40
    assert "PartitionFilters: [isnotnull(day" in plan_text(spark.table("raw_test").where("day = 1"))


def test_jdbc_options_reach_the_driver(spark):
    writer = jdbc_writer(spark.range(1), "jdbc:none:x", "mart.t", {"driver": "no.such.Driver", "user": "u"})
    with pytest.raises(Exception, match="no.such.Driver"):
        writer.save()


@pytest.mark.parametrize("settings, base", [
    ({"spark.checkpoint.dir": "hdfs://a/shared/", "spark.sql.warehouse.dir": "hdfs://a/w"}, "hdfs://a/shared/x-"),
    ({"spark.sql.warehouse.dir": "hdfs://a/w"}, "hdfs://a/w/scratch/x-"),
])
def test_scratch_is_on_a_shared_file_system(settings, base):
    class Session:
        conf = settings

    assert scratch_dir(Session, "x").startswith(base)


def test_a_busy_hour_is_split_and_small_ones_are_not(spark):
    """Nine rows in ten of one hour: several tasks write it; hours that do not share its shuffle partition have a file each."""
    hours = spark.range(200_000).select(
        F.lit(2024).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("day"),
        F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 24).cast("int").alias("hour"),
        F.concat(F.lit("T"), F.sha2(F.col("id").cast("string"), 256)).alias("transaction_id"))
    root = scratch_dir(spark, "busy")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_raw(hours, root, "one")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [f.split("/")[-3] for f in spark.read.parquet(root).inputFiles()]
    assert files.count("hour=7") > 2
    others = set(files) - {"hour=7"}
    assert len(others) == 12 and sum(files.count(h) == 1 for h in others) > 6


def test_a_trend_has_the_months_of_the_facts_whenever_they_are(spark):
    facts = spark.createDataFrame([(19890501, Decimal(1)), (20240615, Decimal(2)), (20500101, Decimal(4))], "date_id INT, amount DECIMAL(10,2)")
    rows = kpis.monthly_trend(facts, dims.days_of(facts)).collect()
    assert [(r["year"], r["month"], r["prev_month_revenue"]) for r in rows] == [
        (1989, 5, None), (2024, 6, Decimal(1)), (2050, 1, Decimal(2))]
