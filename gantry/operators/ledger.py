"""Which days have sent which transaction, so that one sent on several days is one fact.

The ledger has a row for each transaction and event day (a claim). A transaction belongs to the
first of its days. Loading days replaces their claims; where that changes whose a transaction
is, the other day has to be loaded again, whether it now loses the transaction or gets it back.
So facts do not depend on the order in which days are loaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.functions.dates import date_id
from gantry.operators.facts import first_copy
from gantry.schemas import LEDGER_BUCKETS


def bucket() -> Column:
    return F.pmod(F.xxhash64("transaction_id"), F.lit(LEDGER_BUCKETS)).cast("int")


def claims(valid: DataFrame) -> DataFrame:
    """(transaction_id, bucket, date_id) of events, combined before the shuffle."""
    return valid.select("transaction_id", date_id("event_ts").alias("date_id")).distinct().withColumn("bucket", bucket())


def first_elsewhere(others: DataFrame, touched: DataFrame) -> DataFrame:
    """(transaction_id, elsewhere): the first of the days in `others` that claims one of the `touched` transactions.

    The semi join comes first, so that what is kept of a ledger of any size are the few
    transactions that were sent on several days.
    """
    met = others.join(touched.select("bucket", "transaction_id").distinct(), ["bucket", "transaction_id"], "left_semi")
    return met.groupBy("transaction_id").agg(F.min("date_id").alias("elsewhere"))


def moved_days(before: DataFrame, now: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """(date_id): days beside the loaded ones that lose a transaction to them or get one back.

    `before` and `now` are the claims of the loaded days. Of the other days only the first that
    claims a transaction can have it.
    """
    def first(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(elsewhere.select("transaction_id"), "transaction_id", "left_semi").groupBy("transaction_id").agg(F.min("date_id").alias(name))

    both = elsewhere.join(first(before, "was"), "transaction_id", "left").join(first(now, "will"), "transaction_id", "left")
    lost, loses = (F.coalesce(F.col(c) < F.col("elsewhere"), F.lit(False)) for c in ("was", "will"))
    return both.where(lost != loses).select(F.col("elsewhere").alias("date_id")).distinct()


def on_first_day(valid: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """Events without copies, on these days or any other: the earliest of each transaction that no earlier day has."""
    once = first_copy(valid.withColumn("date_id", date_id("event_ts")), ["transaction_id"])
    earlier = elsewhere.withColumnRenamed("transaction_id", "_id")
    return once.join(earlier, (once["transaction_id"] == earlier["_id"]) & (earlier["elsewhere"] < once["date_id"]), "left_anti")
