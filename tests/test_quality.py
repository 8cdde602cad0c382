"""Checks, the one-pass report, isolation of failing checks, the gate."""

from datetime import date
from decimal import Decimal

import pytest

from gantry.operators import quality

DAY = date(2025, 7, 15)
DDL = "transaction_id STRING, plaza_id STRING, amount DECIMAL(10,2), date_id INT"


@pytest.fixture(scope="module")
def plaza(spark):
    return spark.createDataFrame([("PL001",), ("PL002",)], "plaza_id STRING")


def day_facts(spark, *rows):
    return spark.createDataFrame([(t, p, None if a is None else Decimal(a), d) for t, p, a, d in rows], DDL)


@pytest.fixture(scope="module")
def faulty(spark):
    return day_facts(
        spark,
        ("T1", "PL001", "75", 20250715), ("T1", "PL001", "75", 20250715), ("T2", "PL009", "-1", 20250715),
        (None, None, "10", 20250715), (None, "PL002", None, 20250715), ("T3", "PL001", "5000", 20250715),
        ("T4", "PL001", "5000.01", 20250715), ("T1", "PL001", "1", 20250714),
    )


def observed(df):
    return {r["check"]: (r["observed"], r["passed"]) for r in df.collect()}


EXPECTED = {
    "row_count_gt": (7, True),
    "no_null_transaction_ids": (2, False),
    "amount_in_range": (2, False),
    "no_duplicate_transactions": (2, False),
    "valid_plaza_ids": (2, False),
}


def test_report_and_single_checks_agree(spark, faulty, plaza):
    assert observed(quality.report(faulty, plaza, DAY)) == EXPECTED
    singles = {}
    for build in quality.day_checks(faulty, plaza, DAY).values():
        singles.update(observed(build()))
    assert singles == EXPECTED


def test_empty_day_fails_only_the_row_count(spark, faulty, plaza):
    report = observed(quality.report(faulty, plaza, date(2030, 1, 1)))
    assert report.pop("row_count_gt") == (0, False)
    assert set(report.values()) == {(0, True)}


def test_every_day_is_reported_even_without_facts(spark, faulty, plaza):
    days = [DAY, date(2025, 7, 14), date(2030, 1, 1)]
    rows = {(r["date_id"], r["check"]): (r["observed"], r["passed"])
            for r in quality.report_days(faulty, plaza, days).collect()}
    assert len(rows) == 15
    assert {check: rows[20250715, check] for check in EXPECTED} == EXPECTED
    assert rows[20250714, "row_count_gt"] == (1, True) and rows[20250714, "valid_plaza_ids"] == (0, True)
    assert rows[20300101, "row_count_gt"] == (0, False)
    with pytest.raises(quality.DataQualityError, match="20300101 row_count_gt"):
        quality.gate(faulty, plaza, days)


def test_gate_passes_clean_days(spark, plaza):
    rows = quality.gate(day_facts(spark, ("T1", "PL001", "75", 20250715)), plaza, [DAY])
    assert len(rows) == 5


def test_gate_names_what_failed(spark, faulty, plaza):
    with pytest.raises(quality.DataQualityError) as raised:
        quality.gate(faulty, plaza, [DAY])
    assert "no_duplicate_transactions" in str(raised.value) and "row_count_gt" not in str(raised.value)


def test_a_check_that_raises_is_a_failure_of_its_own(spark, faulty, plaza):
    with pytest.raises(quality.DataQualityError) as raised:
        quality.gate(faulty.drop("amount"), plaza, [DAY])
    rows = {r["check"]: r for r in raised.value.rows}
    assert rows["amount_in_range"]["error"] and not rows["amount_in_range"]["passed"]
    assert rows["row_count_gt"]["passed"] and rows["no_duplicate_transactions"]["observed"] == 2
