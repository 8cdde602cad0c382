"""The star schema as one bundle of frames, whatever it is read from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions.dates import date_id
from gantry.operators import dims
from gantry.operators.events import valid_events, validate_and_enrich
from gantry.operators.facts import clean_events, conform, hourly_revenue, revenue_facts
from gantry.schemas import FLAGGED_PAYMENT, MART
from gantry.sources import files
from gantry.sources.writers import read_table, table_path


class Mart:
    """Tables by name, each built when a query first asks for it."""

    def __init__(self, **tables: Callable[[], DataFrame]) -> None:
        self._plans = tables
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._plans[name]()
        return self._built[name]

    def with_tables(self, **tables: Callable[[], DataFrame]) -> Mart:
        return Mart(**{**self._plans, **tables})

    @property
    def facts(self) -> DataFrame:
        """Transactions of every status."""
        return self.table("fact_transaction")

    @property
    def revenue(self) -> DataFrame:
        """Transactions without failed deductions."""
        return revenue_facts(self.facts)

    @property
    def hourly(self) -> DataFrame:
        return self.table("agg_hourly_revenue")

    @property
    def dim_date(self) -> DataFrame:
        return self.table("dim_date")

    @property
    def dim_vehicle(self) -> DataFrame:
        return self.table("dim_vehicle")

    @property
    def dim_plaza(self) -> DataFrame:
        return self.table("dim_plaza")

    @property
    def dim_class(self) -> DataFrame:
        return self.table("dim_class")

    @property
    def dim_payment(self) -> DataFrame:
        return self.table("dim_payment")


def hourly_from_facts(facts: DataFrame) -> DataFrame:
    return hourly_revenue(facts, "entry_time", "vehicle_id", F.expr(f"payment_id = {FLAGGED_PAYMENT}"))


def mart_from_events(spark: SparkSession, events: DataFrame) -> Mart:
    """The mart as plans over charge events; nothing is stored."""
    facts = lambda: conform(clean_events(validate_and_enrich(events)), dims.payment_seed(spark))
    return Mart(
        fact_transaction=facts,
        agg_hourly_revenue=lambda: hourly_from_facts(revenue_facts(facts())),
        dim_date=lambda: dims.days_of(valid_events(events).select(date_id("event_ts").alias("date_id"))),
        # Copies cannot change a latest plate, so vehicles need no de-duplication.
        dim_vehicle=lambda: dims.vehicles(valid_events(events)),
        dim_plaza=lambda: dims.plaza_seed(spark),
        dim_class=lambda: dims.class_seed(spark),
        dim_payment=lambda: dims.payment_seed(spark),
    )


POINTER = "_current-"


def _published(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots that were made public and not yet superseded for long, in order."""
    names = files.children(spark, table_path(root, "dim_vehicle"))
    return sorted(int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER) and not n.endswith(".draft"))


def current_vehicles(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot of the vehicle table that was published last; None before the first load.

    A pointer is a file whose name has the snapshot's number, and a newer one is there before older
    ones go. So there is none only before the first build, and vehicles are never started anew.
    """
    published = _published(spark, root)
    if published:
        return read_table(spark, root, "dim_vehicle").where(F.col("snapshot") == published[-1])
    if files.exists(spark, table_path(root, "build_log")):
        raise FileNotFoundError(f"{root} has builds but no published vehicles: create dim_vehicle/{POINTER}<snapshot>")
    return None


def publish_vehicles(spark: SparkSession, root: str, snapshot: int) -> None:
    """Point to a snapshot. The one before stays for readers that have it open; older ones go."""
    folder = table_path(root, "dim_vehicle")
    before = _published(spark, root)
    if snapshot not in before:
        files.create_text(spark, f"{folder}/{POINTER}{snapshot}", "")
    kept = {snapshot, *before[-1:]}
    for number in before:
        if number not in kept and number < snapshot:
            files.remove(spark, f"{folder}/{POINTER}{number}")
    for name in files.children(spark, folder):
        # A later number is a load at work.
        if name.startswith("snapshot=") and int(name.removeprefix("snapshot=")) not in kept:
            if int(name.removeprefix("snapshot=")) < snapshot:
                files.remove(spark, f"{folder}/{name}")


def read_mart(spark: SparkSession, root: str) -> Mart:
    """The mart written by the nightly job."""

    def vehicles() -> DataFrame:
        current = current_vehicles(spark, root)
        if current is None:
            raise FileNotFoundError(f"{root} has no published vehicles yet")
        return current.drop("snapshot")

    tables = {name: (lambda name=name: read_table(spark, root, name)) for name in MART}
    return Mart(**{**tables, "dim_vehicle": vehicles})
