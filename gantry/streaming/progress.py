"""What became of the rows that streams have read: progress kept as a table, and two balances.

`ProgressLog` is a listener that writes a small file for each trigger of each query. From it and the
published totals, `summary_losses` tells for each trigger of a summary with state how many rows came
behind the watermark and are in no total; the mart's repair of late days is where those are found.
`ingest_balance` sets what a trigger of `landing.land_all` says it has read beside what its sinks hold.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gantry.sources import files
from gantry.sources.readers import read_raw
from gantry.streaming.landing import ARRIVED, COUNTS_DDL, SUMMARY_DDL, SUMMARY_KEYS

PROGRESS_DDL = (
    "query STRING, run STRING, name STRING, batch BIGINT, rows_in BIGINT, arrived BIGINT, state_rows BIGINT, "
    "groups_dropped BIGINT, watermark STRING, milliseconds BIGINT"
)


class ProgressLog(StreamingQueryListener):
    """Keeps a row for each trigger of the session's queries below `path`; `spark.streams.addListener(...)` starts it.

    Triggers that are run again after a stop have another `run`. `groups_dropped` is Spark's own number,
    which counts rows after they were added up within a task; `summary_losses` counts rows.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(ARRIVED)
        row = {
            "query": str(p.id), "run": str(p.runId), "name": p.name, "batch": p.batchId, "rows_in": p.numInputRows,
            "arrived": None if seen is None else seen["n"],
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "groups_dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "watermark": p.eventTime.get("watermark"), "milliseconds": p.batchDuration,
        }
        name = f"{self._path}/{p.runId}-{p.batchId:09d}.json"
        # A trigger that only moves the watermark on may follow under the same number.
        if not files.exists(self._spark, name):
            files.create_text(self._spark, name, json.dumps(row))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS_DDL).json(path)


def summarised(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch, summarised): rows that each trigger of `landing.publish_summary` added to the totals.

    A trigger writes the new state of each total it changed, so what it added is the difference to the
    state before. For folders that are not merged yet; one small sort for each plaza, hour and vehicle.
    """
    changes = spark.read.schema(SUMMARY_DDL).parquet(path)
    states = Window.partitionBy("stream", *SUMMARY_KEYS, "tag_id").orderBy("batch")
    added = F.col("tx_count") - F.coalesce(F.lag("tx_count").over(states), F.lit(0))
    return changes.withColumn("_added", added).groupBy("stream", "batch").agg(F.sum("_added").alias("summarised"))


def summary_losses(spark: SparkSession, summary: str, progress: str, query: str) -> DataFrame:
    """(batch, arrived, summarised, lost) of one summary query, by its id: arrived = summarised + lost.

    A trigger that was run again counts as its last run has it.
    """
    own = read_progress(spark, progress).where((F.col("query") == query) & F.col("arrived").isNotNull())
    arrived = own.groupBy("batch").agg(F.max("arrived").alias("arrived"))
    added = summarised(spark, summary).select("batch", "summarised")
    both = arrived.join(added, "batch", "left").withColumn("summarised", F.coalesce("summarised", F.lit(0)))
    return both.withColumn("lost", F.col("arrived") - F.col("summarised"))


def ingest_balance(spark: SparkSession, root: str) -> DataFrame:
    """(load, messages, landed, rejected, raw_rows, rejected_rows, balanced) of each trigger of `land_all`.

    A sink that lost a folder, or has one of another trigger's rows, shows as a load that is not
    balanced. Loads that were compacted since have other names in the raw zone and show as well. Sinks are
    counted by load from folder names and row counts, no column is read.
    """
    counts = spark.read.schema(COUNTS_DDL).parquet(f"{root}/counts")
    raw = read_raw(spark, f"{root}/raw").groupBy("load").agg(F.count("*").alias("raw_rows"))
    held = counts.join(raw, "load", "left")
    if files.exists(spark, f"{root}/rejected"):
        rejected = spark.read.schema("reason STRING, load STRING").parquet(f"{root}/rejected")
        held = held.join(rejected.groupBy("load").agg(F.count("*").alias("rejected_rows")), "load", "left")
    else:
        held = held.withColumn("rejected_rows", F.lit(0).cast("bigint"))
    held = held.na.fill(0, ["raw_rows", "rejected_rows"])
    return held.withColumn("balanced", F.expr(
        "messages = landed + rejected AND landed = raw_rows AND rejected = rejected_rows"))
