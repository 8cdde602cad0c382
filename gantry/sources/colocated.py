"""Facts and vehicles stored by vehicle, so that joining them moves no row.

Two catalog tables are bucketed alike by (vehicle, slot): every bucket of the facts meets the same
bucket of the vehicles where it lies, and totals by vehicle need no exchange either. A bucket is one
task, so a vehicle with very many trips is dealt to SLOTS slots by transaction and its row is kept in
each of them; all others have slot 0. Which vehicles are dealt out is kept in the vehicle table:
once a vehicle is, it stays so, and days that were stored before keep its trips in slot 0.

The facts are also partitioned by day, and a day that is stored again replaces itself. The tables are
made from the mart and can be made again from it; they are for queries over all vehicles, while
lookups of one vehicle are served by the mart's own layout (days, Bloom filters).

Vehicles are written before facts. A load that stops between has vehicles without trips, which join
with nothing, and is repeated whole. Rows without a vehicle join with nothing and are kept in the
bucket of the null. Empty facts leave the days as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.schemas import MART
from gantry.session import settings

FACTS, VEHICLES = "fact_by_vehicle", "vehicle_by_id"
BUCKETS = 1024
#: Trips of one load from which on a vehicle is dealt out, and to how many slots.
HOT, SLOTS = 1_000_000, 64
KEYS = ("vehicle_id", "slot")
VEHICLE_DDL = "vehicle_id BIGINT, slot INT, slots INT, tag_id STRING, vehicle_no STRING, registered_state STRING, round BIGINT"


def create(spark: SparkSession, root: str, database: str = "mart", buckets: int = BUCKETS) -> None:
    """Both tables below `root`; leaves what exists as it is."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    by_vehicle = f"CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {buckets} BUCKETS"
    for table, columns, day in (
        (FACTS, "slot INT, " + MART["fact_transaction"].columns, "date_id"), (VEHICLES, VEHICLE_DDL, "round"),
    ):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet"
            f" PARTITIONED BY ({day}) {by_vehicle} LOCATION '{root.rstrip('/')}/{table}'"
        )


def _rounds(spark: SparkSession, database: str) -> list[int]:
    listed = spark.sql(f"SHOW PARTITIONS {database}.{VEHICLES}").collect()
    return sorted(int(row["partition"].removeprefix("round=")) for row in listed)


def vehicles_by_id(spark: SparkSession, database: str = "mart") -> DataFrame | None:
    """(vehicle_id, slot, slots, tag_id, ...): the newest round; None before the first."""
    rounds = _rounds(spark, database)
    return spark.table(f"{database}.{VEHICLES}").where(F.col("round") == rounds[-1]) if rounds else None


def _buckets(spark: SparkSession, database: str) -> int:
    described = spark.sql(f"DESCRIBE EXTENDED {database}.{FACTS}").where("col_name = 'Num Buckets'").first()
    return int(described["data_type"])


def _store(rows: DataFrame, spark: SparkSession, database: str, table: str) -> None:
    """One task a bucket, dealt as the bucket's number is, so that a bucket of a day is one file."""
    dealt = rows.repartition(_buckets(spark, database), *KEYS)
    with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        dealt.select(*spark.table(f"{database}.{table}").columns).write.insertInto(f"{database}.{table}", overwrite=True)


def store(facts: DataFrame, vehicles: DataFrame, database: str = "mart", hot: int = HOT, slots: int = SLOTS) -> None:
    """Put `facts` in place of their days, and `vehicles` in place of all vehicles."""
    spark = facts.sparkSession
    before = vehicles_by_id(spark, database)
    # At most one in `hot` rows is a hot vehicle, which bounds this list beside the facts.
    dealt = facts.groupBy("vehicle_id").count().where((F.col("count") >= hot) & F.col("vehicle_id").isNotNull())
    dealt = dealt.select("vehicle_id", F.lit(slots).alias("slots"))
    if before is not None:
        dealt = dealt.unionByName(before.where("slots > 1").select("vehicle_id", "slots"))
    dealt = dealt.groupBy("vehicle_id").agg(F.max("slots").alias("slots"))

    number = max(_rounds(spark, database), default=0) + 1
    known = vehicles.select("vehicle_id", "tag_id", "vehicle_no", "registered_state").join(dealt, "vehicle_id", "left")
    known = known.withColumn("slots", F.coalesce("slots", F.lit(1)))
    known = known.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).withColumn("round", F.lit(number).cast("bigint"))
    _store(known, spark, database, VEHICLES)

    # The slots of the facts are those that were stored: the list is not worked out a second time.
    listed = vehicles_by_id(spark, database).where("slots > 1 AND slot = 0").select("vehicle_id", "slots")
    placed = facts.join(listed, "vehicle_id", "left").withColumn(
        "slot", F.coalesce(F.pmod(F.xxhash64("transaction_id"), F.col("slots")), F.lit(0)).cast("int"))
    _store(placed, spark, database, FACTS)
    for old in _rounds(spark, database)[:-2]:  # the round before stays for readers that have it open
        spark.sql(f"ALTER TABLE {database}.{VEHICLES} DROP IF EXISTS PARTITION (round = {old})")


def facts_by_vehicle(spark: SparkSession, database: str = "mart") -> DataFrame:
    return spark.table(f"{database}.{FACTS}")
