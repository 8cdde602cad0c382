"""Exact distinct vehicles that add up: bitmaps over dense vehicle numbers.

A count of distinct vehicles of an hour says nothing about the day's. A bitmap of an hour does:
bitmaps are joined by "or" to any coarser total, and their bits are counted. Spark's bitmaps hold
32,768 consecutive numbers each, so numbers are given without gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def number_vehicles(vehicles: DataFrame, last: int) -> DataFrame:
    """`vehicles` with a `number`: those that have one keep it, the others get the next ones after `last`.

    New vehicles are ranked within parts by a hash of the tag, and parts follow each other by
    their sizes, a row for each: numbers have no gaps, and no task ranks all vehicles.
    """
    dealt = vehicles.withColumn("_part", F.pmod(F.xxhash64("tag_id", F.lit(1)), F.lit(PARTS)))
    new = dealt.where("number IS NULL").drop("number")
    sizes = new.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("tag_id"))
    ranked = new.withColumn("_rank", rank).join(offsets, "_part")
    numbered = ranked.withColumn("number", F.lit(last) + F.col("_before") + F.col("_rank"))
    return dealt.where("number IS NOT NULL").drop("_part").unionByName(numbered.drop("_part", "_before", "_rank"))


def vehicle_bits(facts: DataFrame, dim_vehicle: DataFrame) -> DataFrame:
    """(plaza_id, date_id, hour, bucket, bits): the vehicles of a plaza's hour. A vehicle of an hour meets the table once."""
    once = facts.select("plaza_id", "date_id", F.hour("entry_time").cast("smallint").alias("hour"), "vehicle_id").distinct()
    numbered = once.join(dim_vehicle.select("vehicle_id", "number"), "vehicle_id")
    return numbered.groupBy("plaza_id", "date_id", "hour", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def count_vehicles(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys` and the exact number of distinct `vehicles` of each."""
    joined = bits.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return joined.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("vehicles"))
