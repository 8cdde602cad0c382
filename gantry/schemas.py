"""Event and mart schemas, seed rows and table layout: the one place they are stated."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

# The wire format of one event. Money is DECIMAL so that sums are
# exact and do not depend on the order in which partitions are merged.
EVENT_DDL = """
    transaction_id STRING, timestamp STRING, plaza_id STRING, plaza_name STRING,
    highway STRING, tag_id STRING, vehicle_no STRING, class_id STRING,
    class_name STRING, amount DECIMAL(10,2), balance_before DECIMAL(10,2),
    balance_after DECIMAL(10,2), status STRING, lane INT
"""

WIRE_FIELDS = tuple(re.findall(r"(\w+) [A-Z]+", EVENT_DDL))

# The hour of an event, and the raw zone's folders: below the hour, one for each load
# (a trigger of a stream, a backfill, a compaction), so that a load can be written
# again and a build can say which loads it has read.
HOUR_COLUMNS = ("year", "month", "day", "hour")
RAW_PARTITIONS = (*HOUR_COLUMNS, "load")

# The landed event: wire fields with `timestamp` replaced by `event_ts`, plus the
# optional exit time, the ingest time, the fields that the wire format does not know
# (JSON, null without any) and the partition columns.
EXTRA = "extra"
RAW_DDL = """
    transaction_id STRING, plaza_id STRING, plaza_name STRING, highway STRING,
    tag_id STRING, vehicle_no STRING, class_id STRING, class_name STRING,
    amount DECIMAL(10,2), balance_before DECIMAL(10,2), balance_after DECIMAL(10,2),
    status STRING, lane INT, event_ts TIMESTAMP, exit_time TIMESTAMP, ingested_at TIMESTAMP, extra STRING,
    year INT, month INT, day INT, hour INT, load STRING
"""


@dataclass(frozen=True)
class TableSpec:
    """Columns plus physical layout of one mart table.

    `sort_by` orders rows inside each file so that Parquet min/max statistics
    prune. Tables that are small by nature (a calendar, a price list) need no
    layout and are left to Spark's size-checked broadcast.
    """

    columns: str
    key: tuple[str, ...]
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()


# Parts of the ledger that ids are dealt to: within a day's files they lie one after the other.
LEDGER_BUCKETS = 64

# The mart's tables.
MART: dict[str, TableSpec] = {
    "dim_date": TableSpec(
        "date_id INT, date DATE, year SMALLINT, month SMALLINT, day SMALLINT, "
        "day_of_week STRING, is_weekend SMALLINT",
        key=("date_id",), sort_by=("date_id",),
    ),
    "dim_vehicle": TableSpec(
        "vehicle_id BIGINT, tag_id STRING, vehicle_no STRING, owner_name STRING, "
        "registered_state STRING, active SMALLINT, created_at TIMESTAMP, "
        "plate_seen_at TIMESTAMP, number BIGINT, snapshot BIGINT",
        key=("vehicle_id",), partition_by=("snapshot",), sort_by=("tag_id",), bloom=("tag_id", "vehicle_id"),
    ),
    "dim_plaza": TableSpec(
        "plaza_id STRING, name STRING, highway STRING, state STRING, latitude DECIMAL(9,6), "
        "longitude DECIMAL(9,6), operator STRING, active SMALLINT",
        key=("plaza_id",),
    ),
    "dim_class": TableSpec(
        "class_id STRING, name STRING, axles SMALLINT, base_rate DECIMAL(8,2)",
        key=("class_id",),
    ),
    "dim_payment": TableSpec(
        "payment_id SMALLINT, method STRING, status STRING",
        key=("payment_id",),
    ),
    "fact_transaction": TableSpec(
        "transaction_id STRING, plaza_id STRING, vehicle_id BIGINT, class_id STRING, "
        "payment_id SMALLINT, amount DECIMAL(10,2), entry_time TIMESTAMP, exit_time TIMESTAMP, "
        "lane SMALLINT, ingested_at TIMESTAMP, date_id INT",
        key=("transaction_id",), partition_by=("date_id",), sort_by=("plaza_id", "entry_time"),
        bloom=("vehicle_id",),
    ),
    "agg_hourly_revenue": TableSpec(
        "plaza_id STRING, hour SMALLINT, tx_count INT, total_revenue DECIMAL(14,2), "
        "unique_vehicles INT, avg_toll DECIMAL(8,2), flagged_count INT, loaded_at TIMESTAMP, "
        "date_id INT",
        key=("plaza_id", "date_id", "hour"), partition_by=("date_id",), sort_by=("hour", "plaza_id"),
    ),
    # How many of a plaza's trips of a day took how many seconds.
    "agg_processing": TableSpec(
        "plaza_id STRING, seconds BIGINT, n BIGINT, date_id INT",
        key=("plaza_id", "date_id", "seconds"), partition_by=("date_id",), sort_by=("plaza_id", "seconds"),
    ),
    # The vehicles of a plaza's hour as bits of 32,768 vehicle numbers each.
    "agg_vehicle_bits": TableSpec(
        "plaza_id STRING, hour SMALLINT, bucket BIGINT, bits BINARY, date_id INT",
        key=("plaza_id", "date_id", "hour", "bucket"), partition_by=("date_id",), sort_by=("plaza_id", "hour"),
    ),
    # One row for each transaction and event day that sent it; the first day has the fact.
    "tx_ledger": TableSpec(
        "transaction_id STRING, bucket INT, date_id INT",
        key=("transaction_id", "date_id"), partition_by=("date_id",), sort_by=("bucket", "transaction_id"), bloom=("transaction_id",),
    ),
    # One row for each day, load and build: the loads of the day that the build has read.
    # A day without rows to keep has them too. The newest build of a day counts.
    "build_log": TableSpec(
        "date_id INT, load STRING, facts BIGINT, loaded_at TIMESTAMP, build BIGINT",
        key=("build", "date_id", "load"), partition_by=("build",),
    ),
}

# Seed rows.
PAYMENT_SEED = """
    (1, 'FASTAG', 'SUCCESS'),
    (2, 'FASTAG', 'LOW_BALANCE'),
    (3, 'FASTAG', 'FLAGGED'),
    (4, 'CASH', 'SUCCESS'),
    (5, 'CARD', 'SUCCESS'),
    (6, 'CARD', 'FAILED')
"""
CLASS_SEED = """
    ('C1', '2-Wheeler', 2, 35.00),
    ('C2', 'Car/Jeep/Van', 4, 75.00),
    ('C3', 'Light Commercial', 4, 120.00),
    ('C4', 'Bus/Truck', 6, 215.00),
    ('C5', 'Multi-Axle', 8, 330.00),
    ('C6', 'Oversized', 12, 455.00)
"""
PLAZA_SEED = """
    ('PL001', 'Delhi-Meerut Expressway KM 12', 'NH-58', 'Uttar Pradesh', NULL, NULL, 'NHAI', 1),
    ('PL002', 'Mumbai-Pune Expressway KM 45', 'NH-48', 'Maharashtra', NULL, NULL, 'MSRDC', 1),
    ('PL003', 'Bengaluru-Mysuru Expressway KM 8', 'NH-275', 'Karnataka', NULL, NULL, 'NHAI', 1),
    ('PL004', 'Chennai-Vijayawada KM 60', 'NH-16', 'Andhra Pradesh', NULL, NULL, 'NHAI', 1),
    ('PL005', 'Kolkata-Dhanbad KM 30', 'NH-19', 'West Bengal', NULL, NULL, 'NHAI', 1)
"""


def seed_rows(seed: str) -> list[tuple]:
    """A seed's rows as Python values."""
    return ast.literal_eval(f"[{seed.replace('NULL', 'None')}]")


TAG_METHOD = "FASTAG"
LOW_BALANCE_PAYMENT = 2
FLAGGED_PAYMENT = 3

# Tags refused passage.
BLACKLISTED_TAGS = ("TAG-00042", "TAG-00099", "TAG-00315")

# Accepted charge range, both ends included.
MIN_AMOUNT = 0
MAX_AMOUNT = 5000
