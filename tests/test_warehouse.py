"""Repeatable loads into a warehouse: the statements as text, and run by DuckDB in this process."""

import re
from datetime import date

import duckdb
import pytest
from test_ledger import DAYS, SENT, events

from gantry.plans.nightly import load_days
from gantry.session import scratch_dir
from gantry.sources import warehouse
from gantry.sources.writers import raw_rows, read_table


def test_statements_of_one_load():
    texts = warehouse.replace_statements("fact", "stage_fact_9", ["a", "date_id"], [date(2024, 5, 2), date(2024, 5, 1), date(2024, 5, 2)], 9)
    newer = "SELECT date_id FROM warehouse_build WHERE table_name = 'fact' AND build > 9"
    assert texts == [
        f"DELETE FROM fact WHERE date_id IN (20240501, 20240502) AND date_id NOT IN ({newer})",
        f"INSERT INTO fact (a, date_id) SELECT a, date_id FROM stage_fact_9 WHERE date_id IN (20240501, 20240502) AND date_id NOT IN ({newer})",
        "DELETE FROM warehouse_build WHERE table_name = 'fact' AND date_id IN (20240501, 20240502) AND build <= 9",
        "INSERT INTO warehouse_build (table_name, date_id, build) SELECT 'fact', date_id, 9 FROM "
        f"(SELECT 20240501 AS date_id UNION ALL SELECT 20240502 AS date_id) AS loaded WHERE date_id NOT IN ({newer})",
    ]
    assert warehouse.replace_statements("fact", "s", ["a"], [], 9) == []
    with pytest.raises(ValueError):
        warehouse.replace_statements("fact; DROP TABLE x", "s", ["a"], DAYS, 9)


class Warehouse:
    """The caller's side: a connection, stages from written files, transactions."""

    def __init__(self, spark):
        self.spark, self.con, self.fail = spark, duckdb.connect(), None
        # Integers as the warehouse has them; nothing else of its types matters here.
        self.con.execute("CREATE TABLE fact_transaction (transaction_id VARCHAR, plaza_id VARCHAR, vehicle_id BIGINT, class_id VARCHAR,"
                         " payment_id SMALLINT, amount DECIMAL(10,2), entry_time TIMESTAMPTZ, exit_time TIMESTAMPTZ, lane SMALLINT,"
                         " ingested_at TIMESTAMPTZ, date_id INTEGER)")
        self.con.execute("CREATE TABLE agg_hourly_revenue (plaza_id VARCHAR, hour SMALLINT, tx_count INTEGER, total_revenue DECIMAL(14,2),"
                         " unique_vehicles INTEGER, avg_toll DECIMAL(8,2), flagged_count INTEGER, loaded_at TIMESTAMPTZ, date_id INTEGER)")

    def write_stage(self, rows, name):
        folder = scratch_dir(self.spark, "stage").removeprefix("file:")
        rows.write.parquet(folder)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM read_parquet('{folder}/*.parquet')")

    def transaction(self, statements):
        self.con.execute("BEGIN")
        try:
            for text in statements:
                if self.fail and re.match(self.fail, text):
                    raise ConnectionError(text)
                self.con.execute(text)
            self.con.execute("COMMIT")
        except Exception:
            self.con.execute("ROLLBACK")
            raise

    def send(self, root, days, build):
        warehouse.send_days(self.spark, root, days, build, self.write_stage, self.transaction)

    def rows(self, table="fact_transaction", columns="transaction_id, date_id"):
        return sorted(self.con.execute(f"SELECT {columns} FROM {table}").fetchall())


@pytest.fixture(scope="module")
def mart(spark):
    root = f"{scratch_dir(spark, 'warehouse')}/mart"
    raw = raw_rows(events(spark, SENT), "first")
    return root, raw, load_days(spark, raw, root, DAYS)


def stored(spark, root):
    return sorted((r["transaction_id"], r["date_id"]) for r in read_table(spark, root, "fact_transaction").collect())


def test_a_load_that_is_repeated_leaves_one_copy(spark, mart):
    root, _, loaded = mart
    there = Warehouse(spark)
    for days in (DAYS[:2], DAYS[1:], DAYS):
        there.send(root, days, loaded.build)
    assert there.rows() == stored(spark, root)
    assert sum(n for n, in there.rows("agg_hourly_revenue", "tx_count")) == len(SENT)
    assert there.rows("warehouse_build", "table_name, date_id, build") == sorted(
        (t, 20240530 + i if i < 2 else 20240599 + i, loaded.build) for t in warehouse.TABLES for i in range(4))
    assert not [t for t, in there.con.execute("SELECT table_name FROM duckdb_tables()").fetchall() if t.startswith("stage_")]


def test_a_repair_replaces_its_days_and_an_older_build_does_not(spark, mart):
    _, _, loaded = mart
    root = f"{scratch_dir(spark, 'repair')}/mart"
    there = Warehouse(spark)
    old = load_days(spark, raw_rows(events(spark, SENT | {"late": [3]}), "first"), root, DAYS)
    there.send(root, old.days, old.build)
    before = there.rows()
    new = load_days(spark, raw_rows(events(spark, SENT | {"late": [1]}), "first"), root, [DAYS[1]])
    there.send(root, new.days, new.build)
    assert there.rows() == stored(spark, root) != before
    # The older build's load comes once more, after it: nothing changes.
    there.send(root, old.days[:2], old.build)
    assert there.rows() == stored(spark, root)


@pytest.mark.parametrize("step", ["DELETE FROM fact", "INSERT INTO fact", "INSERT INTO warehouse_build", "DROP"])
def test_a_load_that_stops_leaves_the_days_as_they_were(spark, mart, step):
    root, _, loaded = mart
    there = Warehouse(spark)
    there.send(root, DAYS[:2], loaded.build)
    before = there.rows()
    there.fail = step
    with pytest.raises(ConnectionError):
        there.send(root, DAYS, loaded.build + 1)
    assert there.rows() == (stored(spark, root) if step == "DROP" else before)
    there.fail = None
    there.send(root, DAYS, loaded.build + 1)
    assert there.rows() == stored(spark, root)


def test_no_days_no_statements(spark, mart):
    there = Warehouse(spark)
    there.fail = ".*"
    there.send(mart[0], [], 1)
