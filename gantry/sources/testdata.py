"""The given `events` and `lineitem` tables in the shape of charge events and facts.

The given rows are clean, so faults are added by rule: nulls, copies, plazas that
no dimension knows, late arrival, unreadable messages. No row is left out.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions.charges import balance_after, numbered, status_after
from gantry.functions.dates import date_id
from gantry.operators.events import WIRE_TIME, event_json
from gantry.schemas import CLASS_SEED, PLAZA_SEED, seed_rows
from gantry.sources import files
from gantry.sources.readers import stream_parquet


def _array(values: Iterable[str]) -> str:
    return f"array({', '.join(repr(v) for v in values)})"


# Values of the adapter's own, and names as the seeds have them.
STATE_CODES = _array(f"{letter}X" for letter in "BCDFGHJKLM")
PLATE_LETTERS = _array("PQRSTVWZ")
PLAZA_NAMES = _array(row[1] for row in seed_rows(PLAZA_SEED))
HIGHWAYS = _array(row[2] for row in seed_rows(PLAZA_SEED))
CLASS_NAMES = _array(row[1] for row in seed_rows(CLASS_SEED))

# A row is an original (copy = 0) or the clean second copy (copy = 1) of one.
_COPIES = "explode(CASE WHEN event_id % 50 = 0 THEN array(0, 1) ELSE array(0) END) AS copy"
_PARTIAL = "event_id % 10 = 3"
# A status that no payment of a tag has, and a status that an original does not send.
FAILED = "event_id % 71 = 1"
NO_STATUS = "event_id % 73 = 1 AND copy = 0"


def _lost(every: int, value: str) -> str:
    """`value`, but null in one original of `every`; copies keep it."""
    return f"CASE WHEN copy = 1 OR event_id % {every} <> 1 THEN {value} END"


def _optional(value: str) -> str:
    return f"CASE WHEN NOT {_PARTIAL} THEN {value} END"


_PLATE = (
    f"get({STATE_CODES}, CAST(user_id % 10 AS INT)) || lpad(CAST(user_id % 99 + 1 AS STRING), 2, '0')"
    f" || get({PLATE_LETTERS}, CAST((user_id + IF(dayofmonth(ts) > 15, 1, 0)) % 8 AS INT))"
    " || CAST(user_id % 9000 + 1000 AS STRING)"
)
# `props` is {"k": n}: cutting the number out costs a tenth of parsing the text.
_SECONDS = "IF(event_type <> 'error', try_cast(rtrim('}', substring_index(props, ':', -1)) AS INT), NULL)"

EVENT_COLUMNS = {
    "transaction_id": _lost(97, numbered("TX-", "event_id", 8)),
    "event_ts": _lost(83, "CAST(ts AS TIMESTAMP)"),
    "plaza_id": numbered("PL", "(user_id % 6 + 1)", 3),
    "plaza_name": _optional(f"get({PLAZA_NAMES}, CAST(user_id % 6 AS INT))"),
    "highway": _optional(f"get({HIGHWAYS}, CAST(user_id % 6 AS INT))"),
    "tag_id": _lost(89, numbered("TAG-", "user_id", 5)),
    "vehicle_no": _optional(_PLATE),
    "class_id": "'C' || CAST(event_id % 6 + 1 AS STRING)",
    "class_name": _optional(f"get({CLASS_NAMES}, CAST(event_id % 6 AS INT))"),
    "amount": "CAST(CAST(value AS DECIMAL(10,2)) * 12 - 5 AS DECIMAL(10,2))",
    "balance_before": "CAST(CAST(event_id * 3701 % 200000 AS DECIMAL(10,0)) * 0.01BD AS DECIMAL(10,2))",
    "lane": "CAST(event_id % 6 + 1 AS INT)",
    "_sent": f"CASE WHEN {FAILED} THEN 'FAILED' WHEN {NO_STATUS} THEN '' END",
    "exit_time": _lost(83, f"dateadd(SECOND, {_SECONDS}, CAST(ts AS TIMESTAMP))"),
    "ingested_at": (
        "CAST(ts AS TIMESTAMP) + IF(event_id % 61 = 1, INTERVAL 36 HOURS, INTERVAL 5 SECONDS)"
        " + IF(copy = 1, INTERVAL 60 SECONDS, INTERVAL 0 SECONDS)"
    ),
}


def shape_events(events: DataFrame) -> DataFrame:
    """Rows of `events` as charge events; batch and streaming frames alike."""
    position = [c for c in ("event_id", "offset") if c in events.columns]
    columns = [f"{expression} AS {name}" for name, expression in EVENT_COLUMNS.items()]
    shaped = events.selectExpr("*", _COPIES).selectExpr(*position, *columns)
    return shaped.withColumns({
        "balance_after": balance_after("balance_before", "amount"),
        "status": F.when(F.col("_sent").isNull(), status_after("tag_id", "balance_before", "amount")).otherwise(
            F.nullif("_sent", F.lit(""))),
    }).drop("_sent")


def raw_events(
    spark: SparkSession, sf_dir: str, since: date | None = None, before: date | None = None, dealt: bool = False,
) -> DataFrame:
    """Charge events from `events.parquet`.

    `since`/`before` repeat a query's own date range on the stored time, so that
    it reaches the Parquet scan; rows without event time satisfy no date range.
    `dealt` is for work that takes far longer for a row than its reading.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for bound, operator in ((since, ">="), (before, "<")):
        if bound is not None:
            midnight = datetime(bound.year, bound.month, bound.day).isoformat(" ")
            events = events.where(f"ts {operator} TIMESTAMP_NTZ '{midnight}'")
    return shape_events(dealt_evenly(events) if dealt else events)


def dealt_evenly(table: DataFrame) -> DataFrame:
    """The table's rows in tasks of equal size, four for each core or as many as read it.

    A row of the table is a few bytes, and a file's rows may be one row group: what reads
    the table would be one task, or a few, whatever the number of cores.
    """
    return table.repartition(max(4 * table.sparkSession.sparkContext.defaultParallelism, scan_tasks(table)))


def worked_out(events: DataFrame) -> DataFrame:
    """The same rows, for those that need every column: each is worked out once.

    A row comes as an array of one, spread out again. Conditions stay above that; below it
    each of them would work out the columns it names once more.
    """
    return events.select(F.inline(F.array(F.struct(*events.columns))))


def sent_again(events: DataFrame, days: int = 7) -> DataFrame:
    """Charge events, every 37th of which comes once more some days later, as its own sender's clock has it.

    Only those of the first three weeks, so that no day has nothing but copies, which the gate would stop.
    """
    later = {c: F.col(c) + F.make_dt_interval(days=F.lit(days)) for c in ("event_ts", "exit_time", "ingested_at")}
    return events.unionByName(events.where("event_id % 37 = 5 AND day(event_ts) <= 22").withColumns(later))


def event_stream(spark: SparkSession, sf_dir: str, **limits: str) -> DataFrame:
    """The same charge events as a stream; `limits` bound one trigger, to a file if not given.

    A row's position in its file serves as its message offset.
    """
    limits = limits or {"maxFilesPerTrigger": "1"}
    path = f"{sf_dir}/events.parquet"
    events = stream_parquet(spark, path, spark.read.parquet(path).schema, **limits)
    return shape_events(events.selectExpr("*", "_metadata.row_index AS offset"))


def in_order_of_time(spark: SparkSession, sf_dir: str, folder: str, parts: int = 6, files_each: int | None = None) -> str:
    """All of `events` as files of one span of time each, written one after the other: a feed of `parts` triggers.

    Every span has the same number of files, as many as the table is read by tasks if not given, so
    that a trigger of so many files is a whole span. A trigger that ended within a span would take the
    watermark past rows of that span's other files.
    """
    path = f"{folder}/events.parquet"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files_each = files_each or scan_tasks(events)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    bounds = [] if first is None else [first + (last - first) * i / parts for i in range(1, parts)]
    spans = zip([None, *bounds], [*bounds, None])
    for n, (since, before) in enumerate(spans, 1):
        part = events
        if since is not None:
            part = part.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        if before is not None:
            part = part.where((F.col("ts") < F.lit(before).cast("timestamp_ntz")) | F.col("ts").isNull())
        part.repartition(files_each).write.mode("append").parquet(path)
        # A span of fewer rows than files has fewer: empty ones make up for them.
        for _ in range(n * files_each - sum(name.endswith(".parquet") for name in files.children(spark, path))):
            spark.createDataFrame([], events.schema).coalesce(1).write.mode("append").parquet(path)
    return folder


def scan_tasks(table: DataFrame) -> int:
    """Tasks that read the table; planned, not run."""
    return max(1, table.rdd.getNumPartitions())


def stream_in_order_of_time(spark: SparkSession, sf_dir: str, folder: str, parts: int = 6) -> DataFrame:
    """The charge events as a stream with a trigger for each of `parts` spans of time, however large the table is."""
    files_each = scan_tasks(spark.read.parquet(f"{sf_dir}/events.parquet"))
    feed = in_order_of_time(spark, sf_dir, folder, parts, files_each)
    return event_stream(spark, feed, maxFilesPerTrigger=str(files_each))


def as_messages(events: DataFrame) -> DataFrame:
    """Encoded events, with some messages that cannot be read added between them.

    A row without event time sends a text that is no time. Every 101st event is
    followed by a message that is not well-formed and by a null message.
    """
    time = F.coalesce(F.date_format("event_ts", WIRE_TIME), F.lit("not a time"))
    offset = "offset" if "offset" in events.columns else "event_id AS offset"
    sent = "CASE WHEN event_id % 101 = 1 THEN array(text, '{' || text, NULL) ELSE array(text) END"
    texts = events.withColumn("text", event_json(events, time)).selectExpr(offset, f"explode({sent}) AS text")
    return texts.selectExpr("offset", "CAST(text AS BINARY) AS value")


#: Fields that senders add after the fact, as their JSON text: (field, which events, value).
NEWS = (
    ("axles_seen", "event_id % 29 = 5", "CAST(event_id % 5 + 2 AS STRING)"),
    ("booth", "event_id % 31 = 7", """'{"id":' || CAST(event_id % 9 AS STRING) || ',"open":true}'"""),
    ("note", "event_id % 23 = 11", "IF(event_id % 2 = 0, '\"late\"', CAST(event_id % 7 AS STRING))"),
)


def with_new_fields(events: DataFrame) -> DataFrame:
    """Messages of events, some of which say more than the schema knows, or send a lane that is no number."""
    time = F.coalesce(F.date_format("event_ts", WIRE_TIME), F.lit("not a time"))
    plain = event_json(events, time)
    lettered = F.regexp_replace(plain, '"lane":([0-9]+)', '"lane":"L$1"')
    whole = F.when(F.expr("event_id % 43 = 2"), lettered).otherwise(plain)
    added = [F.when(F.expr(which), F.concat(F.lit(f',"{field}":'), F.expr(value))).otherwise("") for field, which, value in NEWS]
    text = F.concat(F.rtrim(whole, F.lit("}")), *added, F.lit("}"))
    return events.select("event_id", text.cast("binary").alias("value"))


def delivered(events: DataFrame, partitions: int = 5) -> DataFrame:
    """Offsets of `events` as a topic's partitions number them, with stretches that were lost or sent twice.

    One partition has a third of all rows. A load is a day.
    """
    dealt = events.select("event_id", F.to_date("ts").alias("day"), F.expr(
        f"IF(event_id % 3 = 0, 0, 1 + (event_id DIV 3) % {partitions - 1})").cast("int").alias("partition"))
    position = f"IF(partition = 0, event_id DIV 3, 2 * (event_id DIV {3 * (partitions - 1)}) + event_id % 3 - 1)"
    sent = dealt.select(F.lit("reads").alias("topic"), "partition", "day", F.expr(position).alias("offset"))
    copies = "CASE WHEN offset % 41 IN (7, 8, 9) THEN array() WHEN offset % 37 < 2 THEN array(0, 1) ELSE array(0) END"
    return sent.selectExpr("topic", "partition", "day", "offset", f"explode({copies}) AS _copy").drop("_copy")


def lineitem_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as facts over several years, for the monthly trend."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lineitem.select(
        date_id("l_shipdate").alias("date_id"),
        F.expr("CAST(l_extendedprice AS DECIMAL(14,2)) AS amount"),
    )
