"""Small cases with known answers for each row rule."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gantry.functions import charges, dates
from gantry.operators import dims, events as ev, facts

EVENT = (
    "transaction_id STRING, tag_id STRING, plaza_id STRING, class_id STRING, status STRING, "
    "amount DECIMAL(10,2), event_ts TIMESTAMP"
)


def frame(spark, *rows, ddl=EVENT):
    def row(r):
        base = dict(transaction_id="T1", tag_id="TAG-00001", plaza_id="PL001", class_id="C1", status="SUCCESS",
                    amount=Decimal("75.00"), event_ts=datetime(2025, 7, 15, 14, 30))
        return {**base, **r}

    return spark.createDataFrame([row(r) for r in rows], ddl)


def test_amount_range_keeps_both_ends(spark):
    amounts = ["75.00", "-10.00", "6000.00", "215.00", "0.00", "5000.00", "5000.01", "-0.01"]
    df = frame(spark, *[{"amount": Decimal(a)} for a in amounts])
    kept = {r["amount"] for r in ev.valid_events(df).collect()}
    assert kept == {Decimal(a) for a in ("75.00", "215.00", "0.00", "5000.00")}


def test_blacklist_overrides_status(spark):
    df = frame(spark, *[{"tag_id": t} for t in ("TAG-00042", "TAG-00099", "TAG-99999", None)])
    statuses = [r["status"] for r in ev.flag_blacklisted(df).collect()]
    assert sorted(statuses) == ["FLAGGED", "FLAGGED", "SUCCESS", "SUCCESS"]


def test_blacklist_from_table_gives_the_same(spark):
    df = frame(spark, *[{"transaction_id": str(i), "tag_id": t} for i, t in
                        enumerate(("TAG-00042", "TAG-00099", "TAG-99999", None))])
    listed = spark.createDataFrame([(t,) for t in charges.BLACKLISTED_TAGS] * 2, "tag_id STRING")
    by_list = {(r["transaction_id"], r["status"]) for r in ev.flag_blacklisted(df).collect()}
    rows = ev.flag_from_table(df, listed).collect()
    assert len(rows) == 4 and {(r["transaction_id"], r["status"]) for r in rows} == by_list


@pytest.mark.parametrize("field", ["transaction_id", "tag_id", "amount", "event_ts", "status"])
def test_rows_without_a_key_field_are_quarantined(spark, field):
    df = frame(spark, {"transaction_id": "T1"}, {"transaction_id": "T2", field: None}, {"transaction_id": "T3"})
    assert ev.valid_events(df).count() == 2
    assert ev.quarantine(df).count() == 1


def test_quarantine_is_the_complement(spark):
    df = frame(spark, {}, {"amount": None}, {"amount": Decimal("-1")}, {"event_ts": None, "tag_id": None})
    reasons = sorted(r["reason"] for r in ev.quarantine(df).collect())
    assert reasons == ["amount out of range", "missing amount", "missing tag_id"]
    assert ev.valid_events(df).count() + len(reasons) == df.count()


def test_copies_are_dropped_and_the_earliest_stays(spark):
    early, late = datetime(2025, 7, 15, 1), datetime(2025, 7, 15, 2)
    df = frame(spark, {"event_ts": late}, {"event_ts": early}, {"transaction_id": "T2"}).withColumn(
        "ingested_at", F.col("event_ts"))
    rows = {r["transaction_id"]: r["event_ts"] for r in facts.fact_transactions(df).collect()}
    assert rows == {"T1": early, "T2": datetime(2025, 7, 15, 14, 30)}


def test_failed_deductions_are_dropped_before_copies(spark):
    # Were copies dropped first, the earlier failed attempt could hide the later success.
    df = frame(spark, {"status": "LOW_BALANCE", "event_ts": datetime(2025, 7, 15, 1)}, {}, {"status": None}).withColumn(
        "ingested_at", F.col("event_ts"))
    assert [r["status"] for r in facts.fact_transactions(df).collect()] == ["SUCCESS"]


def test_revenue_keeps_unknown_statuses(spark):
    df = frame(spark, {}, {"transaction_id": "T2", "status": "FAILED"}, {"transaction_id": "T3", "status": "LOW_BALANCE"}).withColumns(
        {"ingested_at": F.col("event_ts"), "lane": F.lit(1)})
    earned = facts.revenue_facts(facts.conform(facts.clean_events(df), dims.payment_seed(spark)))
    charged = facts.fact_transactions(df)
    for rows in (earned, charged):
        assert {r["transaction_id"] for r in rows.select("transaction_id", "date_id").collect()} == {"T1", "T2"}


def test_revenue_and_charged_transactions_agree(spark, sf):
    from __spark_entry__ import _mart, _valid

    earned = _mart(spark, sf).revenue.select("date_id", "transaction_id")
    charged = facts.fact_transactions(_valid(spark, sf)).select("date_id", "transaction_id")
    assert earned.count() == charged.count() > 0
    assert earned.exceptAll(charged).isEmpty()


def test_hourly_aggregate(spark):
    rows = [("T1", "PL001", "75", 8, 10), ("T2", "PL001", "215", 8, 45), ("T3", "PL001", "35", 9, 5), ("T4", "PL002", "120", 8, 20)]
    df = frame(spark, *[
        {"transaction_id": t, "plaza_id": p, "amount": Decimal(a), "event_ts": datetime(2025, 7, 15, h, m)}
        for t, p, a, h, m in rows])
    got = {(r["plaza_id"], r["hour"]): r for r in facts.hourly_revenue(df).collect()}
    assert got["PL001", 8]["tx_count"] == 2 and got["PL001", 8]["total_revenue"] == Decimal("290.00")
    assert got["PL001", 8]["avg_toll"] == Decimal("145.00") and got["PL001", 8]["unique_vehicles"] == 1
    assert got["PL001", 9]["tx_count"] == 1
    assert got["PL002", 8]["total_revenue"] == Decimal("120.00")
    assert {r["date_id"] for r in got.values()} == {20250715}


def test_partition_columns(spark):
    row = ev.stamp(frame(spark, {})).first()
    assert (row["year"], row["month"], row["day"], row["hour"]) == (2025, 7, 15, 14)
    assert row["ingested_at"] is not None


def test_status_precedence_and_balance(spark):
    cases = [("TAG-00042", 1, 5), ("TAG-1", 1, 5), ("TAG-1", 5, 5), ("TAG-1", None, 5), (None, 9, 5)]
    df = spark.createDataFrame(
        [(t, None if b is None else Decimal(b), Decimal(a)) for t, b, a in cases],
        "tag_id STRING, balance_before DECIMAL(10,2), amount DECIMAL(10,2)")
    out = ev.classify_status(df).withColumn("after", charges.balance_after("balance_before", "amount")).collect()
    assert [r["status"] for r in out] == ["FLAGGED", "LOW_BALANCE", "SUCCESS", "SUCCESS", "SUCCESS"]
    assert [r["after"] for r in out] == [Decimal(0), Decimal(0), Decimal(0), None, Decimal(4)]


def test_charge_and_class_rate(spark):
    df = frame(spark, {"class_id": "C2", "amount": Decimal("150")}, {"class_id": "C9"}, {"class_id": "C0"})
    free = dims.class_seed(spark).limit(1).withColumns({"class_id": F.lit("C0"), "base_rate": F.lit(0).cast("decimal(8,2)")})
    rows = {r["class_id"]: r for r in ev.with_class_rate(df, dims.class_seed(spark).unionByName(free)).collect()}
    assert rows["C0"]["expected_amount"] == 0 and rows["C0"]["trips"] is None
    assert rows["C2"]["expected_amount"] == Decimal("75.00") and rows["C2"]["trips"] == 2.0
    assert rows["C9"]["expected_amount"] is None
    priced = dims.class_seed(spark).withColumn("trips", F.lit(2)).select(charges.charge("base_rate", "trips").alias("c"))
    assert {r["c"] for r in priced.collect()} == {Decimal(v) for v in (70, 150, 240, 430, 660, 910)}


def test_identifiers_keep_all_digits(spark):
    row = spark.range(1).select(
        charges.tag_number("42").alias("a"), charges.tag_number("1234567").alias("b")).first()
    assert (row["a"], row["b"]) == ("TAG-00042", "TAG-1234567")


def test_calendar(spark):
    from datetime import date

    rows = {r["date"]: r for r in dims.calendar(spark, date(2024, 2, 28), date(2024, 3, 3)).collect()}
    assert len(rows) == 5
    assert rows[date(2024, 2, 29)]["date_id"] == 20240229
    assert [rows[d]["is_weekend"] for d in sorted(rows)] == [0, 0, 0, 1, 1]
    assert rows[date(2024, 3, 2)]["day_of_week"] == "Saturday"


def test_second_boundaries(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.9' AS a, TIMESTAMP '2024-01-01 00:00:01.1' AS b")
    assert df.select(dates.seconds_between("a", "b")).first()[0] == 1


def test_dates_from_text():
    assert dates.day_key(dates.parse_day("2025-07-05")) == 20250705
    assert dates.key_day(20250705) == dates.parse_day("2025-07-05")
    with pytest.raises(ValueError):
        dates.parse_day("05/07/2025")


def test_payment_is_chosen_by_method_too(spark):
    df = frame(spark, {}, {"transaction_id": "T2", "status": "ODD"}).withColumns(
        {"ingested_at": F.col("event_ts"), "lane": F.lit(1), "date_id": F.lit(20250715)})
    rows = {r["transaction_id"]: r["payment_id"] for r in facts.conform(df, dims.payment_seed(spark)).collect()}
    assert rows == {"T1": 1, "T2": None}


def test_latest_plate_and_merge_in_any_order(spark):
    ddl = "tag_id STRING, vehicle_no STRING, event_ts TIMESTAMP"
    d = [datetime(2024, 1, i) for i in range(1, 6)]
    old = spark.createDataFrame([("A", "DL01A1000", d[0]), ("A", None, d[1]), ("B", None, d[0]), ("C", "KA1", d[3])], ddl)
    new = spark.createDataFrame([("A", "MH02B2000", d[2]), ("C", "UP1", d[1]), ("D", "TN1", d[4]), ("B", None, d[2])], ddl)
    want = {("A", "MH02B2000", "MH"), ("B", "UNKNOWN", None), ("C", "KA1", "KA"), ("D", "TN1", "TN")}

    def rows(df):
        return {(r["tag_id"], r["vehicle_no"], r["registered_state"]) for r in df.collect()}

    a, b = dims.vehicles(old), dims.vehicles(new)
    once = dims.merge_vehicles(a, b)
    assert rows(once) == rows(dims.merge_vehicles(b, a)) == rows(dims.merge_vehicles(once, a)) == want
    assert rows(dims.vehicles(old.unionByName(new))) == want
    assert dims.repeated_vehicle_ids(once).isEmpty()


def test_absent_rows_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k INT, v STRING")
    assert [tuple(r) for r in dims.absent_rows(new, old, ["k"]).collect()] == [(3, "C")]
    assert {tuple(r) for r in dims.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
