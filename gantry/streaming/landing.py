"""Streaming queries: raw landing, live summary, de-duplication.

`land_all` reads a source once for all its sinks; the others are one sink each.
Each query has its own checkpoint and writes what a trigger brings as a folder named
after query and trigger, so that a trigger which is run again replaces its folder, and
readers need no log beside the folders. A bounded source (`maxFilesPerTrigger`,
`maxOffsetsPerTrigger`) bounds what one trigger handles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gantry.functions.charges import FLAGGED
from gantry.functions.dates import event_hour_columns
from gantry.functions.measures import count_where
from gantry.operators.events import PAYLOAD, VALID, parse_events, quarantine, validate_and_enrich
from gantry.operators.offsets import SOURCE, offset_ranges
from gantry.schemas import EXTRA, HOUR_COLUMNS
from gantry.sources import files
from gantry.sources.writers import write_raw

SUMMARY_KEYS = ("plaza_id", "highway", *HOUR_COLUMNS)
#: The published totals; names of streams are texts also where they look like numbers.
SUMMARY_DDL = (
    "plaza_id STRING, highway STRING, tag_id STRING, tx_count BIGINT, total_revenue DECIMAL(20,2), flagged_count BIGINT, "
    "year INT, month INT, day INT, hour INT, stream STRING, batch BIGINT"
)
#: In a trigger's progress: rows before any is dropped for being late.
ARRIVED = "arrived"
TRIGGER = "10 seconds"
#: How late rows may be for the summary; later ones are left to the repair of the mart.
DELAY = "2 days"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State beyond executor memory: keep it in RocksDB, checkpointed as changes. Stays set in the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _start(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Every `interval`, or, without one, everything available and then stop."""
    timing = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**timing).start()


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint, so that triggers of another one are other loads."""
    path = f"{checkpoint.rstrip('/')}/stream_name"
    name = files.read_text(spark, path)
    if name is None:
        name = uuid.uuid4().hex[:12]
        files.create_text(spark, path, name)
    return name


def _land(events: DataFrame, write: Callable[[DataFrame, str], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    name = _stream_name(events.sparkSession, checkpoint)
    stream = events.writeStream.foreachBatch(lambda rows, trigger: write(rows, f"{name}-{trigger:09d}"))
    return _start(stream.outputMode("append"), checkpoint, interval)


def land_raw(events: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER) -> StreamingQuery:
    """Append validated events to the raw zone, one folder per event hour and trigger.

    Late rows go to the hour they belong to.
    """
    return _land(events, lambda rows, load: write_raw(rows, path, load), checkpoint, interval)


def land_rows(rows: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER, *partition_by: str) -> StreamingQuery:
    """Append rows of any shape, one folder per value of `partition_by` and trigger."""

    def write(batch: DataFrame, load: str) -> None:
        writer = batch.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partition_by, "load").parquet(path)

    return _land(rows, write, checkpoint, interval)


def land_rejected(rejected: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER) -> StreamingQuery:
    """Append quarantined rows, one folder per reason."""
    return land_rows(rejected, path, checkpoint, interval, "reason")


def _by_hour(events: DataFrame, delay: str | None) -> DataFrame:
    """Events with their hour as a window, which a watermark can close."""
    marked = events if delay is None else events.withWatermark("event_ts", delay)
    return marked.withColumn("slot", F.window("event_ts", "1 hour"))


def _with_hour_columns(totals: DataFrame) -> DataFrame:
    return totals.withColumns(event_hour_columns("slot.start")).drop("slot")


def vehicle_totals(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Totals per plaza, highway, event hour *and* vehicle.

    Spark has no distinct count over a stream, and a set of tags per group would
    grow in one state row. With the vehicle in the key the state is one small row
    per vehicle and hour, spread over all tasks, and the distinct count is a count
    of rows in `roll_up`. With `delay` the state of an hour goes once the hour is
    that old; rows later than that are left to the late-day repair of the mart.
    """
    totals = _by_hour(events, delay).groupBy("plaza_id", "highway", "slot", "tag_id").agg(
        F.count("transaction_id").alias("tx_count"),
        F.sum("amount").alias("total_revenue"),
        count_where(F.col("status") == FLAGGED).alias("flagged_count"),
    )
    return _with_hour_columns(totals)


def roll_up(totals: DataFrame) -> DataFrame:
    """Summary rows from `vehicle_totals` rows (one per group and vehicle)."""
    return totals.groupBy(*SUMMARY_KEYS).agg(
        F.sum("tx_count").alias("tx_count"),
        F.sum("total_revenue").alias("total_revenue"),
        F.count("tag_id").alias("unique_vehicles"),
        F.sum("flagged_count").alias("flagged_count"),
    )


def summary(events: DataFrame) -> DataFrame:
    """The live summary of a batch frame."""
    return roll_up(vehicle_totals(events))


def approx_summary(events: DataFrame, error: float = 0.01, delay: str | None = None) -> DataFrame:
    """Streaming summary whose vehicle count is a sketch: one state row per group.

    For hours with too many vehicles to keep a row each; the count is approximate.
    """
    totals = _by_hour(events, delay).groupBy("plaza_id", "highway", "slot").agg(
        F.count("transaction_id").alias("tx_count"),
        F.sum("amount").alias("total_revenue"),
        F.approx_count_distinct("tag_id", error).alias("unique_vehicles"),
        count_where(F.col("status") == FLAGGED).alias("flagged_count"),
    )
    return _with_hour_columns(totals)


def print_summary(events: DataFrame, checkpoint: str, interval: str | None = TRIGGER, rows: int = 20) -> StreamingQuery:
    """Show the whole summary after each trigger."""

    def show(totals: DataFrame, batch: int) -> None:
        roll_up(totals).orderBy(*SUMMARY_KEYS).show(rows, truncate=False)

    return _start(vehicle_totals(events).writeStream.foreachBatch(show).outputMode("complete"), checkpoint, interval)


def publish_summary(events: DataFrame, path: str, checkpoint: str, interval: str | None = TRIGGER,
                    delay: str | None = DELAY,
                    also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the summary as a table that `read_summary` reads.

    A trigger writes only the totals that changed, in a folder of its stream and
    `batch`; a trigger that is run again replaces that folder, and a stream with
    another checkpoint, which counts its triggers from 0 again, has other folders.
    `also` may send the changed totals elsewhere, to a warehouse for instance.
    """
    name = _stream_name(events.sparkSession, checkpoint)

    def write(totals: DataFrame, batch: int) -> None:
        changed = totals.withColumns({"stream": F.lit(name), "batch": F.lit(batch).cast("bigint")})
        writer = changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("stream", "batch").parquet(path)
        if also is not None:
            also(totals, batch)

    arrived = events.observe(ARRIVED, F.count(F.lit(1)).alias("n"))
    stream = vehicle_totals(arrived, delay).writeStream.foreachBatch(write)
    return _start(stream.outputMode("update"), checkpoint, interval)


def _newest_totals(changes: DataFrame) -> DataFrame:
    """Totals only grow, so the newest state of a row is its largest count.

    That holds between streams as well: a new checkpoint reads the source from its start, so an hour
    that the source still has is counted whole again, and of one that it has lost the old total stays.
    """
    return changes.groupBy(*SUMMARY_KEYS, "tag_id").agg(
        F.max("tx_count").alias("tx_count"),
        F.max_by("total_revenue", "tx_count").alias("total_revenue"),
        F.max("flagged_count").alias("flagged_count"),
    )


def read_summary(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """The published summary; `wanted` may select days or plazas."""
    changes = spark.read.schema(SUMMARY_DDL).parquet(path)
    return roll_up(_newest_totals(changes if wanted is None else changes.where(wanted)))


def merge_summary(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Merge each stream's folders but those of its last `keep` triggers into one; the number that went.

    What is merged up to trigger n lies in the folder of batch -(n + 1). It is written before
    the others go, and a reader that sees both sees the same totals.
    """
    return sum(_merge_stream(spark, path, name, keep) for name in files.children(spark, path) if name.startswith("stream="))


def _merge_stream(spark: SparkSession, path: str, folder: str, keep: int) -> int:
    numbers = [int(n.removeprefix("batch=")) for n in files.children(spark, f"{path}/{folder}") if n.startswith("batch=")]
    closed = sorted(n for n in numbers if n >= 0)[:-keep or None]
    if not closed:
        return 0
    old = [n for n in numbers if n < 0] + closed
    own = (F.col("stream") == folder.removeprefix("stream=")) & F.col("batch").isin(old)
    merged = _newest_totals(spark.read.schema(SUMMARY_DDL).parquet(path).where(own))
    target = -(closed[-1] + 1)
    merged = merged.hint("rebalance", *HOUR_COLUMNS).withColumns(
        {"stream": F.lit(folder.removeprefix("stream=")), "batch": F.lit(target).cast("bigint")})
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(path)
    for n in old:
        if n != target:
            files.remove(spark, f"{path}/{folder}/batch={n}")
    return len(old)


def first_seen(events: DataFrame, delay: str = "2 days", position: str | None = None, salts: int = 16) -> DataFrame:
    """Each transaction once across triggers, for copies that arrive within `delay`.

    All copies of a transaction meet in one task. With `position`, a column that
    differs between copies (a message offset), they are first thinned out in
    `salts` groups, so at most that many of a transaction reach that task.
    """
    marked = events.withWatermark("event_ts", delay)
    if position is not None:
        marked = marked.withColumn("_salt", F.pmod(F.col(position), F.lit(salts)).cast("int"))
        marked = marked.dropDuplicatesWithinWatermark(["transaction_id", "_salt"]).drop("_salt")
    return marked.dropDuplicatesWithinWatermark(["transaction_id"])


def start_ingest(valid: DataFrame, rejected: DataFrame, root: str, checkpoints: str,
                 interval: str | None = TRIGGER, delay: str = DELAY) -> list[StreamingQuery]:
    """Landing, quarantine and summary over one stream, each restartable by itself."""
    keep_state_on_disk(valid.sparkSession)
    return [
        land_raw(valid, f"{root}/raw", f"{checkpoints}/raw", interval),
        land_rejected(rejected, f"{root}/rejected", f"{checkpoints}/rejected", interval),
        publish_summary(valid, f"{root}/summary", f"{checkpoints}/summary", interval, delay),
    ]


RANGES_DDL = "topic STRING, partition INT, span BIGINT, first BIGINT, last BIGINT, copies BIGINT, load STRING"
COUNTS_DDL = "messages BIGINT, landed BIGINT, rejected BIGINT, load STRING"
#: In the name of a file that says up to which trigger a stream's totals are merged.
MERGED = "_merged-"


def land_all(messages: DataFrame, root: str, checkpoint: str, interval: str | None = TRIGGER) -> StreamingQuery:
    """One read of a source of messages for all sinks: `raw`, `rejected`, `counts`, `totals` and, where messages have them, `ranges` of offsets.

    A trigger parses its messages once, keeps them, and writes each sink in folders of its own
    name. A trigger that stopped between sinks is run again with the same messages and replaces
    what it had written, so the sinks cannot stand apart. Totals are those of the trigger's own
    rows: they add up (`read_totals`), so no state is kept and no row comes too late for them.
    """
    name = _stream_name(messages.sparkSession, checkpoint)
    position = [c for c in (*SOURCE, "offset") if c in messages.columns]

    def write(batch: DataFrame, trigger: int) -> None:
        load = f"{name}-{trigger:09d}"
        parsed = parse_events(batch, keep=[PAYLOAD, EXTRA, *position]).persist()
        try:
            valid = validate_and_enrich(parsed.drop(*position))
            write_raw(valid, f"{root}/raw", load)
            _write_load(quarantine(parsed).drop(EXTRA), f"{root}/rejected", load, "reason")
            if {*SOURCE, "offset"} <= set(position):
                _write_load(offset_ranges(parsed), f"{root}/ranges", load)
            counts = parsed.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.expr(VALID)).alias("landed"))
            _write_load(counts.withColumn("rejected", F.col("messages") - F.col("landed")), f"{root}/counts", load)
            totals = vehicle_totals(valid).withColumns({"stream": F.lit(name), "batch": F.lit(trigger).cast("bigint")})
            _replace(totals, f"{root}/totals", "stream", "batch")
        finally:
            parsed.unpersist()

    return _start(messages.writeStream.foreachBatch(write).outputMode("append"), checkpoint, interval)


def _replace(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def _write_load(rows: DataFrame, path: str, load: str, *partition_by: str) -> None:
    _replace(rows.withColumn("load", F.lit(load)), path, *partition_by, "load")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Offsets that all triggers have read, for `offsets.audit`."""
    return spark.read.schema(RANGES_DDL).parquet(path)


def _valid_totals(spark: SparkSession, path: str) -> Column:
    """Folders that count: of each stream the last merged one and the triggers after it. One term for each stream."""
    wanted = F.lit(False)
    for folder in files.children(spark, path):
        if folder.startswith("stream="):
            merged = _merged_up_to(spark, f"{path}/{folder}")
            batch = F.col("batch") > merged if merged is not None else F.col("batch") >= 0
            if merged is not None:
                batch = batch | (F.col("batch") == -(merged + 1))
            wanted = wanted | ((F.col("stream") == folder.removeprefix("stream=")) & batch)
    return wanted


def _merged_up_to(spark: SparkSession, folder: str) -> int | None:
    return max((int(n.removeprefix(MERGED)) for n in files.children(spark, folder) if n.startswith(MERGED)), default=None)


def _added(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*SUMMARY_KEYS, "tag_id").agg(
        *[F.sum(c).cast(t).alias(c) for c, t in (("tx_count", "bigint"), ("total_revenue", "decimal(20,2)"), ("flagged_count", "bigint"))])


def read_totals(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """The live summary from what `land_all` keeps for each trigger; `wanted` may select days or plazas.

    Streams add up as well: another checkpoint is another reader of the source, as in the raw zone.
    """
    parts = spark.read.schema(SUMMARY_DDL).parquet(path).where(_valid_totals(spark, path))
    return roll_up(_added(parts if wanted is None else parts.where(wanted)))


def merge_totals(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Add up each stream's folders but those of its last `keep` triggers; the number of folders that went.

    Sums may not be seen beside their parts, so a file made after the merged folder is there
    names the trigger up to which it holds, and readers take no older folder. A job that stops
    before leaves the parts in force, one that stops later leaves folders that the next one removes.
    """
    gone = 0
    for folder in files.children(spark, path):
        if not folder.startswith("stream="):
            continue
        place, name = f"{path}/{folder}", folder.removeprefix("stream=")
        numbers = sorted(int(n.removeprefix("batch=")) for n in files.children(spark, place) if n.startswith("batch="))
        closed, merged = [n for n in numbers if n >= 0][:-keep or None], _merged_up_to(spark, place)
        if closed and (merged is None or closed[-1] > merged):
            parts = spark.read.schema(SUMMARY_DDL).parquet(path).where(_valid_totals(spark, path))
            own = parts.where((F.col("stream") == name) & (F.col("batch") <= closed[-1]))
            target = {"stream": F.lit(name), "batch": F.lit(-(closed[-1] + 1)).cast("bigint")}
            _replace(_added(own).hint("rebalance", *HOUR_COLUMNS).withColumns(target), path, "stream", "batch")
            files.create_text(spark, f"{place}/{MERGED}{closed[-1]:09d}", "")
            merged = closed[-1]
        if merged is None:
            continue
        for n in numbers:
            if n <= merged and n != -(merged + 1):
                files.remove(spark, f"{place}/batch={n}")
                gone += 1
        for marker in files.children(spark, place):
            if marker.startswith(MERGED) and int(marker.removeprefix(MERGED)) < merged:
                files.remove(spark, f"{place}/{marker}")
    return gone


def wait_all(queries: list[StreamingQuery]) -> None:
    """Wait until all have ended; when any fails, stop the others and raise its error."""
    streams = SparkSession.active().streams
    try:
        while True:
            failed = next((error for error in (q.exception() for q in queries) if error), None)
            if failed:
                raise failed
            if not any(q.isActive for q in queries):
                return
            # Returns as soon as any query ends, ours or another's; the loop finds out which.
            streams.resetTerminated()
            if all(q.isActive for q in queries):
                try:
                    streams.awaitAnyTermination(60)
                except Exception:  # noqa: BLE001 - ours is raised above, another query's is not ours to raise
                    pass
            else:
                next(q for q in queries if q.isActive).awaitTermination(1)
    finally:
        for query in queries:
            query.stop()
