"""What the load of the mart and of the raw zone costs for a row: by plans, and by what is handed over."""

import __spark_entry__ as entry
from compare import plan_text, spark_rows
from pyspark.sql import functions as F

from gantry.plans import nightly
from gantry.session import scratch_dir
from gantry.sources import testdata
from gantry.sources.writers import write_raw


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_landed_column_is_worked_out_once(spark, sf):
    """conditions on the charge are not put below the row that has it."""
    assert optimized(entry._valid_whole(spark, sf)).count("* 12) - 5)") == 1
    assert spark_rows(entry._valid_whole(spark, sf)) == spark_rows(entry._valid(spark, sf))


def test_one_row_group_is_shaped_by_many_tasks(spark, sf):
    """the table is one file of one row group."""
    assert testdata.scan_tasks(spark.read.parquet(f"{sf}/events.parquet")) == 1
    shaped = testdata.raw_events(spark, sf, dealt=True)
    sizes = [r["count"] for r in shaped.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * min(sizes)
    assert spark_rows(shaped) == spark_rows(testdata.raw_events(spark, sf))


def test_raw_files_are_written_by_more_tasks_than_cores(spark, sf):
    """no core writes alone at the end; the setting is gone afterwards."""
    seen, key = [], "spark.sql.adaptive.coalescePartitions.minPartitionNum"
    rows = entry._valid(spark, sf)

    class Writer:
        def __getattr__(self, _):
            return lambda *args: seen.append(spark.conf.get(key, None)) or self

    class Rows:
        sparkSession, columns = spark, rows.columns
        write = Writer()

        def __getattr__(self, _):
            return lambda *args: self

    write_raw(Rows(), scratch_dir(spark, "tasks"), "one")
    assert seen[-1] == str(4 * spark.sparkContext.defaultParallelism)
    assert spark.conf.get(key, None) is None


def test_the_first_load_reads_no_ledger(spark, sf):
    """F8: nothing is claimed elsewhere, which the plan knows, so no join is made."""
    work = scratch_dir(spark, "first")
    write_raw(entry._valid(spark, sf).where("day = 3"), f"{work}/raw", "one")
    raw = nightly.read_raw(spark, f"{work}/raw")
    days, now, elsewhere = nightly.claim_days(spark, raw, f"{work}/mart", [entry._landed_days(raw)[0]], f"{work}/claims")
    assert now.count() and elsewhere.columns == ["transaction_id", "elsewhere"] and elsewhere.isEmpty()
    assert "LocalRelation <empty>" in optimized(elsewhere)
    assert "Join" not in optimized(nightly.ledger.on_first_day(raw, elsewhere))


def test_loads_of_unique_facts_read_a_zone(spark, sf, monkeypatch):
    """days are folders, and events are shaped once for all passes over them."""
    plans, load = [], nightly.load_days
    monkeypatch.setattr(entry, "load_days", lambda s, raw, *rest: plans.append(plan_text(raw.where("day = 3"))) or load(s, raw, *rest))
    entry._fact_unique(spark, sf)
    assert len(plans) == 2 and all("PartitionFilters: [isnotnull(day" in p and "Generate" not in p for p in plans)


def test_messages_with_new_fields_are_made_and_read_by_many_tasks(spark, sf, monkeypatch):
    """also where the table is one row group."""
    tasks, made = [], testdata.with_new_fields
    monkeypatch.setattr(testdata, "with_new_fields", lambda events: tasks.append(events.rdd.getNumPartitions()) or made(events))
    entry._landed_extra(spark, sf)
    assert tasks == [4 * spark.sparkContext.defaultParallelism]
