"""From message bytes to validated, flagged events, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions.charges import FLAGGED, blacklist_test, status_after
from gantry.functions.dates import event_hour_columns
from gantry.schemas import BLACKLISTED_TAGS, EVENT_DDL, EXTRA, MAX_AMOUNT, MIN_AMOUNT, WIRE_FIELDS

PAYLOAD = "payload"
WIRE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def all_fields(text: Column) -> Column:
    """Top-level fields of a JSON object by name, each a VARIANT: a number, a text and an object stay what they are."""
    return F.from_json(text, "map<string,variant>")


def extra_fields(text: Column) -> Column:
    """The fields that the event schema does not know, as one JSON object; null where there are none.

    Values are read only of messages with an unknown name, or whose names cannot be read.
    """
    only_known = F.forall(F.json_object_keys(text), lambda name: name.isin(*WIRE_FIELDS))
    unknown = F.map_filter(all_fields(text), lambda name, _: ~name.isin(*WIRE_FIELDS))
    return F.when(only_known, F.lit(None).cast("string")).otherwise(F.nullif(F.to_json(unknown), F.lit("{}")))


def parse_events(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """JSON message bytes to typed columns.

    Malformed text and null messages become all-null rows, which `valid_events`
    drops and `quarantine` reports. Text that is no time becomes a null
    `event_ts` instead of an error, so one bad row cannot stop a stream. `keep`
    names message columns (offset, partition, ...) to carry along; PAYLOAD among
    them is the message's own text, for rows that may be rejected, and EXTRA the
    fields that the schema does not know.

    The event comes as an array of one, spread out again: conditions on its fields stay
    above that, where below it each of them would read the text once more.
    """
    text = F.col("value").cast("string")
    made = {PAYLOAD: text, EXTRA: extra_fields(text)}
    carried = [made[name].alias(name) if name in made else F.col(name) for name in keep]
    fields = messages.select(*carried, F.inline(F.array(F.from_json(text, EVENT_DDL))))
    return fields.withColumn("event_ts", F.try_to_timestamp("timestamp")).drop("timestamp")


def event_json(events: DataFrame, time: Column | None = None) -> Column:
    """JSON text of one event; null fields are left out."""
    time = F.date_format("event_ts", WIRE_TIME) if time is None else time
    wire = [
        time.alias("timestamp") if name == "timestamp" else F.col(name)
        for name in T.StructType.fromDDL(EVENT_DDL).fieldNames()
        if name == "timestamp" or name in events.columns
    ]
    return F.to_json(F.struct(*wire))


def encode_events(events: DataFrame) -> DataFrame:
    """Events to message bytes: the inverse of `parse_events`."""
    return events.select(event_json(events).cast("binary").alias("value"))


IN_RANGE = f"amount BETWEEN {MIN_AMOUNT} AND {MAX_AMOUNT}"

# What makes a row unfit to land, in the order it is reported. The first two need the payload.
UNREADABLE = {
    "unreadable message": " AND ".join(f"{name} IS NULL" for name in (*WIRE_FIELDS, "event_ts") if name != "timestamp"),
    "unreadable amount": f"amount IS NULL AND get_json_object({PAYLOAD}, '$.amount') IS NOT NULL",
}
REJECTIONS = {
    "missing transaction_id": "transaction_id IS NULL",
    "missing tag_id": "tag_id IS NULL",
    "missing amount": "amount IS NULL",
    "amount out of range": f"NOT ({IN_RANGE})",
    "unreadable event time": "event_ts IS NULL",
    "missing status": "status IS NULL",
}


KEY_FIELDS = ("transaction_id", "tag_id", "event_ts", "status")
VALID = " AND ".join([*(f"{key} IS NOT NULL" for key in KEY_FIELDS), IN_RANGE])


def valid_events(events: DataFrame) -> DataFrame:
    """Rows that may be landed: key fields and status present, charge in range, time readable."""
    return events.drop(PAYLOAD).where(VALID)


def quarantine(events: DataFrame) -> DataFrame:
    """The complement of `valid_events`, each row with its first reason.

    Parsed messages that carry their payload keep it, and tell a message that could
    not be read from one without an id.
    """
    reasons = {**UNREADABLE, **REJECTIONS} if PAYLOAD in events.columns else REJECTIONS
    cases = " ".join(f"WHEN {failed} THEN '{reason}'" for reason, failed in reasons.items())
    return events.withColumn("reason", F.expr(f"CASE {cases} END")).where("reason IS NOT NULL")


def flag_blacklisted(events: DataFrame, blacklist: Sequence[str] = BLACKLISTED_TAGS) -> DataFrame:
    status = F.when(blacklist_test("tag_id", blacklist), FLAGGED).otherwise(F.col("status"))
    return events.withColumn("status", status)


def flag_from_table(events: DataFrame, blacklist: DataFrame) -> DataFrame:
    """As `flag_blacklisted`, with the tags kept in a table of any size.

    Works on a stream joined to a static table as well. No broadcast hint: Spark
    broadcasts the list while its size allows and shuffles beyond that.
    """
    listed = blacklist.select("tag_id").distinct().withColumn("_listed", F.lit(True))
    status = F.when(F.col("_listed"), FLAGGED).otherwise(F.col("status"))
    return events.join(listed, "tag_id", "left").withColumn("status", status).drop("_listed")


def stamp(events: DataFrame) -> DataFrame:
    """Partition columns from event time; ingest time unless the row brings one."""
    columns = event_hour_columns("event_ts")
    if "ingested_at" not in events.columns:
        columns["ingested_at"] = F.current_timestamp()
    return events.withColumns(columns)


def validate_and_enrich(events: DataFrame) -> DataFrame:
    return stamp(flag_blacklisted(valid_events(events)))


def with_class_rate(events: DataFrame, dim_class: DataFrame) -> DataFrame:
    """List price of the vehicle class and the number of trips the charge covers."""
    rates = dim_class.select("class_id", F.col("base_rate").alias("expected_amount"))
    # A class without a price has no number of trips.
    price = F.nullif(F.col("expected_amount").cast("double"), F.lit(0.0))
    trips = F.round(F.col("amount").cast("double") / price, 4)
    return events.join(rates, "class_id", "left").withColumn("trips", trips)


def classify_status(events: DataFrame) -> DataFrame:
    """Status worked out from tag, balance and charge instead of trusted from the sender."""
    return events.withColumn("status", status_after("tag_id", "balance_before", "amount"))
