"""What senders add to or change in their messages, against the event schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.operators.events import all_fields, parse_events
from gantry.schemas import WIRE_FIELDS


def drift_report(messages: DataFrame) -> DataFrame:
    """(field, known, n, n_null, n_lost, type) of every top-level field of `messages`.

    `type` is the one that all values of the field fit into, VARIANT where they differ; `n_lost`
    counts values of a known field that the schema's type could not take, so that the event has null.
    A field that comes twice in one message counts twice; null messages and texts that are no JSON
    object have no fields. Counts and types are merged before the shuffle, which has a row for
    each field and task; names that carry data (ids as names) make as many groups, spread by name.
    """
    fields = all_fields(F.col("value").cast("string")).alias("_fields")
    read = parse_events(messages.select("value", fields), keep=["_fields"])
    missing = [F.when(F.col("event_ts" if name == "timestamp" else name).isNull(), F.lit(name)) for name in WIRE_FIELDS]
    each = read.select(F.array_compact(F.array(*missing)).alias("_missing"), F.explode("_fields").alias("field", "value"))
    empty = F.is_variant_null("value")
    return each.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(empty).alias("n_null"),
        F.count_if(~empty & F.array_contains("_missing", F.col("field"))).alias("n_lost"),
        F.schema_of_variant_agg("value").alias("type"),
    ).select("field", F.col("field").isin(*WIRE_FIELDS).alias("known"), "n", "n_null", "n_lost", "type")
