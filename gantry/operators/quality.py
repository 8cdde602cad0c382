"""Data-quality checks on one day of facts, and the gate they feed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.functions.dates import day_key
from gantry.functions.measures import count_where
from gantry.operators.dims import repeated_vehicle_ids
from gantry.schemas import MAX_AMOUNT, MIN_AMOUNT

REPORT_DDL = "check STRING, expected STRING, observed BIGINT, passed BOOLEAN, error STRING"


class DataQualityError(RuntimeError):
    """A check failed; carries the report rows."""

    def __init__(self, rows: Sequence) -> None:
        self.rows = list(rows)
        super().__init__("; ".join(self._line(row.asDict()) for row in self.rows if not row["passed"]))

    @staticmethod
    def _line(row: dict) -> str:
        day = f"{row['date_id']} " if "date_id" in row else ""
        error = f" ({row['error']})" if row["error"] else ""
        return f"{day}{row['check']}: expected {row['expected']}, observed {row['observed']}{error}"


@dataclass(frozen=True)
class Check:
    """`measure` aggregates the per-transaction groups of `_groups` to one number."""

    name: str
    expected: str
    measure: Callable[[], Column]
    minimum: int | None = None

    def passes(self, observed: Column) -> Column:
        return observed == 0 if self.minimum is None else observed >= self.minimum


# The names of the checks and their expectations.
def default_checks(min_rows: int = 1, low: float = MIN_AMOUNT, high: float = MAX_AMOUNT) -> list[Check]:
    return [
        Check("row_count_gt", f">= {min_rows}", lambda: F.sum("n"), minimum=min_rows),
        Check("no_null_transaction_ids", "0",
              lambda: F.sum(F.when(F.col("transaction_id").isNull(), F.col("n")).otherwise(0))),
        Check("amount_in_range", f"all amounts in [{low}, {high}]", lambda: F.sum("out_of_range")),
        Check("no_duplicate_transactions", "0", lambda: count_where(F.col("n") > 1)),
        Check("valid_plaza_ids", "all plaza_ids in dim_plaza", lambda: F.sum("orphans")),
    ]


def _groups(facts: DataFrame, dim_plaza: DataFrame, days: Sequence[date], low: float, high: float) -> DataFrame:
    """The days' facts as one row per day and transaction id: every check is a sum over these.

    One scan and one shuffle serve all checks of all days. Copies are combined
    before the shuffle, so an id with any number of copies stays cheap. Null ids
    are a group. Each day gets an empty group too, so that a day without facts is
    reported.
    """
    keys = [day_key(day) for day in days]
    known = dim_plaza.select("plaza_id").distinct().withColumn("_known", F.lit(True))
    groups = (
        facts.where(F.col("date_id").isin(keys))
        .join(known, "plaza_id", "left")
        .groupBy("date_id", "transaction_id")
        .agg(
            F.count("*").alias("n"),
            # A null amount is not out of range.
            count_where(~F.col("amount").between(low, high)).alias("out_of_range"),
            count_where(F.col("_known").isNull()).alias("orphans"),
        )
    )
    empty = facts.sparkSession.range(1).select(
        F.explode(F.lit(keys)).alias("date_id"), F.lit("").alias("transaction_id"),
        *[F.lit(0).cast("bigint").alias(name) for name in ("n", "out_of_range", "orphans")],
    )
    return groups.unionByName(empty)


def report_days(
    facts: DataFrame,
    dim_plaza: DataFrame,
    days: Sequence[date],
    checks: Sequence[Check] | None = None,
    low: float = MIN_AMOUNT,
    high: float = MAX_AMOUNT,
) -> DataFrame:
    """One row per day and check, all from a single pass."""
    checks = default_checks(low=low, high=high) if checks is None else list(checks)
    measured = _groups(facts, dim_plaza, days, low, high).groupBy("date_id").agg(*[
        F.coalesce(check.measure(), F.lit(0)).cast("bigint").alias(f"m{i}") for i, check in enumerate(checks)
    ])
    lines = [
        F.struct(
            F.lit(check.name).alias("check"),
            F.lit(check.expected).alias("expected"),
            F.col(f"m{i}").alias("observed"),
            check.passes(F.col(f"m{i}")).alias("passed"),
            F.lit(None).cast("string").alias("error"),
        )
        for i, check in enumerate(checks)
    ]
    return measured.select("date_id", F.inline(F.array(*lines)))


def report(facts: DataFrame, dim_plaza: DataFrame, day: date, **options) -> DataFrame:
    """One row per check of one day."""
    return report_days(facts, dim_plaza, [day], **options).drop("date_id")


def row_count(facts: DataFrame, day: date, min_rows: int = 1) -> DataFrame:
    return _single(_day(facts, day).agg(F.count("*").alias("observed")), default_checks(min_rows)[0])


def null_ids(facts: DataFrame, day: date) -> DataFrame:
    missing = count_where(F.col("transaction_id").isNull())
    return _single(_day(facts, day).agg(missing.alias("observed")), default_checks()[1])


def amount_range(facts: DataFrame, day: date, low: float = MIN_AMOUNT, high: float = MAX_AMOUNT) -> DataFrame:
    outside = count_where((F.col("amount") < low) | (F.col("amount") > high))
    return _single(_day(facts, day).agg(outside.alias("observed")), default_checks(low=low, high=high)[2])


def duplicates(facts: DataFrame, day: date) -> DataFrame:
    repeated = _day(facts, day).groupBy("transaction_id").agg(F.count("*").alias("n")).where("n > 1")
    return _single(repeated.agg(F.count("*").alias("observed")), default_checks()[3])


def orphan_plazas(facts: DataFrame, dim_plaza: DataFrame, day: date) -> DataFrame:
    """A null plaza is an orphan too: it matches nothing in the anti join."""
    orphans = _day(facts, day).join(dim_plaza.select("plaza_id"), "plaza_id", "left_anti")
    return _single(orphans.agg(F.count("*").alias("observed")), default_checks()[4])


def _day(facts: DataFrame, day: date) -> DataFrame:
    return facts.where(F.col("date_id") == day_key(day))


def _single(observed: DataFrame, check: Check) -> DataFrame:
    return observed.select(
        F.lit(check.name).alias("check"),
        F.lit(check.expected).alias("expected"),
        F.col("observed").cast("bigint").alias("observed"),
        check.passes(F.col("observed")).alias("passed"),
        F.lit(None).cast("string").alias("error"),
    )


def isolated_report(spark, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Run each check by itself; one that raises is a failed row with its error.

    Every check yields one row, so what reaches the driver is the report itself.
    """
    rows: list[tuple] = []
    for name, build in checks.items():
        try:
            rows += [(r["check"], r["expected"], r["observed"], r["passed"], None) for r in build().collect()]
        except Exception as failure:  # noqa: BLE001 - any failure of a check is a failed check
            message = str(failure).strip() or type(failure).__name__
            rows.append((name, None, None, False, message.splitlines()[0]))
    return spark.createDataFrame(rows, REPORT_DDL)


def day_checks(facts: DataFrame, dim_plaza: DataFrame, day: date) -> dict[str, Callable[[], DataFrame]]:
    return {
        "row_count_gt": lambda: row_count(facts, day),
        "no_null_transaction_ids": lambda: null_ids(facts, day),
        "amount_in_range": lambda: amount_range(facts, day),
        "no_duplicate_transactions": lambda: duplicates(facts, day),
        "valid_plaza_ids": lambda: orphan_plazas(facts, dim_plaza, day),
    }


def vehicle_keys(dim_vehicle: DataFrame) -> DataFrame:
    """No two tags may share a surrogate key, or their trips would be counted twice."""
    check = Check("unique_vehicle_keys", "0", lambda: F.count("*"))
    return _single(repeated_vehicle_ids(dim_vehicle).agg(F.count("*").alias("observed")), check)


def gate(facts: DataFrame, dim_plaza: DataFrame, days: Sequence[date], dim_vehicle: DataFrame | None = None) -> list:
    """Raise unless every check passes on every day, and the vehicles' keys are unique.

    The report comes to the driver: five rows a day. If it cannot be made, each
    check runs alone, which tells the one that raises from the others.
    """
    try:
        rows = report_days(facts, dim_plaza, days).collect()
    except Exception:  # noqa: BLE001 - find out which check it was
        spark = facts.sparkSession
        rows = [row for day in days for row in isolated_report(spark, day_checks(facts, dim_plaza, day)).collect()]
    if dim_vehicle is not None:
        rows = [*rows, *vehicle_keys(dim_vehicle).collect()]
    if not all(r["passed"] for r in rows):
        raise DataQualityError(rows)
    return rows
