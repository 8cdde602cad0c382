"""Transactions that were sent on several days, loaded in any order."""

from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from compare import plan_text

from gantry.operators import dims, ledger
from gantry.plans.nightly import ledger_from_facts, load_days, repair_late
from gantry.schemas import MART
from gantry.session import scratch_dir
from gantry.sources import files
from gantry.sources.readers import read_raw
from gantry.sources.writers import raw_rows, read_table, write_raw, write_table

FIRST = date(2024, 5, 30)
DAYS = [FIRST + timedelta(days=i) for i in range(4)]  # over the end of a month


def events(spark, sent):
    """Events from (transaction, numbers of its days)."""
    rows = [
        (t, "PL001", "C1", f"TAG-{hash_of(t)}", 10 + day, datetime(2024, 5, 30, 8, minute) + timedelta(days=day))
        for minute, (t, days) in enumerate(sent.items()) for day in days
    ]
    frame = spark.createDataFrame(rows, "transaction_id STRING, plaza_id STRING, class_id STRING, tag_id STRING, amount INT, event_ts TIMESTAMP")
    return frame.selectExpr(
        "* EXCEPT (amount)", "CAST(amount AS DECIMAL(10,2)) AS amount", "'SUCCESS' AS status", "1 AS lane", "CAST(NULL AS STRING) AS vehicle_no",
        "event_ts + INTERVAL 5 SECONDS AS ingested_at", "year(event_ts) AS year", "month(event_ts) AS month", "day(event_ts) AS day",
        "hour(event_ts) AS hour")


def hash_of(t):
    return sum(map(ord, t)) % 7


SENT = {"a": [0], "b": [0, 1], "c": [1, 3], "d": [3], "e": [0, 2, 3], "f": [2, 2, 3], "g": [1, 1], "h": [0, 1, 2, 3]}


def expected(sent):
    return Counter((t, 20240530 if min(days) == 0 else 20240531 if min(days) == 1 else 20240600 + min(days) - 1) for t, days in sent.items())


def facts(spark, root):
    return Counter((r["transaction_id"], r["date_id"]) for r in read_table(spark, root, "fact_transaction").collect())


def hours(spark, root):
    return sum(r["tx_count"] for r in read_table(spark, root, "agg_hourly_revenue").collect())


@pytest.mark.parametrize("order", [(3, 2, 1, 0), (2, 0, 3, 1)])
def test_one_fact_in_any_order_of_days(spark, order):
    root = f"{scratch_dir(spark, 'order')}/mart"
    raw = raw_rows(events(spark, SENT), "first")
    for day in order:
        load_days(spark, raw, root, [DAYS[day]])
    assert facts(spark, root) == expected(SENT) and hours(spark, root) == len(SENT)
    claims = Counter((r["transaction_id"], r["date_id"]) for r in read_table(spark, root, "tx_ledger").collect())
    assert set(claims.values()) == {1} and len(claims) == sum(len(set(days)) for days in SENT.values())
    load_days(spark, raw, root, [DAYS[order[0]], DAYS[order[2]]])  # and again
    assert facts(spark, root) == expected(SENT)


def test_a_day_gives_back_what_it_no_longer_has(spark):
    root = f"{scratch_dir(spark, 'back')}/mart"
    load_days(spark, raw_rows(events(spark, SENT), "first"), root, DAYS)
    less = {t: [d for d in days if d != 0] for t, days in SENT.items()} | {"a": [0]}
    loaded = load_days(spark, raw_rows(events(spark, less), "first"), root, [DAYS[0]])
    assert loaded.days == (DAYS[0], DAYS[1], DAYS[2])  # b and h are now the second day's, e the third's
    assert facts(spark, root) == expected(less) and hours(spark, root) == len(less)
    assert load_days(spark, raw_rows(events(spark, SENT), "first"), root, [DAYS[0]]).days == (DAYS[0], DAYS[1], DAYS[2])
    assert facts(spark, root) == expected(SENT)


def test_late_rows_take_a_transaction_to_an_earlier_day(spark):
    root = scratch_dir(spark, "late")
    write_raw(events(spark, {"x": [2], "w": [2], "y": [1], "z": [3]}), f"{root}/raw", "first")
    load_days(spark, read_raw(spark, f"{root}/raw"), f"{root}/mart", DAYS[1:])
    write_raw(events(spark, {"x": [1], "z": [3]}), f"{root}/raw", "second")
    repaired = repair_late(spark, read_raw(spark, f"{root}/raw"), f"{root}/mart")
    assert repaired.days == (DAYS[1], DAYS[2], DAYS[3])
    assert facts(spark, f"{root}/mart") == expected({"x": [1], "w": [2], "y": [1], "z": [3]})
    assert repair_late(spark, read_raw(spark, f"{root}/raw"), f"{root}/mart") is None


def test_a_stop_before_the_ledger_is_made_good(spark, monkeypatch):
    from gantry.plans import nightly

    root = f"{scratch_dir(spark, 'stop')}/mart"
    raw = raw_rows(events(spark, SENT), "first")
    load_days(spark, raw, root, DAYS[1:])
    write = nightly.write_days

    def stop(rows, spark, root, table, days):
        if table == "tx_ledger":
            raise KeyboardInterrupt
        return write(rows, spark, root, table, days)

    with monkeypatch.context() as patched:
        patched.setattr(nightly, "write_days", stop)
        with pytest.raises(KeyboardInterrupt):
            load_days(spark, raw, root, [DAYS[0]])
    load_days(spark, raw, root, [DAYS[0]])
    assert facts(spark, root) == expected(SENT)


def test_a_mart_without_a_ledger_gets_one(spark):
    root = f"{scratch_dir(spark, 'old')}/mart"
    raw = raw_rows(events(spark, SENT), "first")
    load_days(spark, raw, root, DAYS[:2])
    files.remove(spark, f"{root}/tx_ledger")
    assert ledger_from_facts(spark, root) == 6
    load_days(spark, raw, root, DAYS[2:])
    assert facts(spark, root) == expected(SENT)


def test_the_ledger_is_read_by_part_and_before_it_is_shuffled(spark):
    root = scratch_dir(spark, "plan")
    rows = spark.range(20000).selectExpr("CAST(id AS STRING) AS transaction_id", "20240501 AS date_id").withColumn("bucket", ledger.bucket())
    write_table(rows, root, "tx_ledger")
    touched = spark.createDataFrame([("77",), ("78",)], "transaction_id STRING").withColumn("bucket", ledger.bucket())
    touched.write.parquet(f"{root}/touched")  # as a load writes its claims
    touched = spark.read.parquet(f"{root}/touched")
    parts = [r["bucket"] for r in touched.collect()]
    known = read_table(spark, root, "tx_ledger").where(f"bucket IN ({parts[0]}, {parts[1]})")
    found = ledger.first_elsewhere(known, touched)
    plan = plan_text(found).split("== Physical Plan ==")[1]
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "In(bucket," in scan and "Python" not in plan
    # The few touched ids are broadcast; the ledger is narrowed where it lies.
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert [tuple(r) for r in found.orderBy("transaction_id").collect()] == [("77", 20240501), ("78", 20240501)]


def test_moved_days_of_empty_frames(spark):
    empty = spark.createDataFrame([], MART["tx_ledger"].columns)
    elsewhere = spark.createDataFrame([], "transaction_id STRING, elsewhere INT")
    assert ledger.moved_days(empty, empty, elsewhere).isEmpty()
    assert dims.absent_rows(empty, empty, ["transaction_id"]).isEmpty()
