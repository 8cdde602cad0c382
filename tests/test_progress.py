"""Progress kept by a listener, rows behind the watermark, and sinks that hold what was read."""

import time
from datetime import datetime, timedelta

from gantry.operators.events import encode_events
from gantry.session import scratch_dir
from gantry.sources import files
from gantry.sources.readers import stream_parquet
from gantry.streaming import landing, progress

ROW = "transaction_id STRING, tag_id STRING, plaza_id STRING, highway STRING, amount DECIMAL(10,2), status STRING, event_ts TIMESTAMP"


def feed(spark, root, *parts):
    """Each part as a file; a file is a trigger."""
    for rows in parts:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(root)
        time.sleep(0.05)
    return stream_parquet(spark, root, spark.read.parquet(root).schema, maxFilesPerTrigger="1")


def event(i, at, tag="t"):
    from decimal import Decimal

    return (f"x{i}", tag, "PL1", "H", Decimal(10), "SUCCESS", at)


def test_arrived_is_summarised_and_lost(spark):
    day = datetime(2024, 1, 10)
    first = [event(i, day + timedelta(minutes=i), f"t{i % 3}") for i in range(50)]
    second = [event(100 + i, day + timedelta(hours=3, minutes=i)) for i in range(20)]
    # Ten rows of one vehicle and hour far behind the watermark of one hour, five in an hour that is open.
    third = [event(200 + i, day - timedelta(days=2)) for i in range(10)] + [event(300 + i, day + timedelta(hours=3)) for i in range(5)]
    fourth = [event(400, day + timedelta(hours=3), "new")]
    work = scratch_dir(spark, "progress")
    landing.keep_state_on_disk(spark)
    events = feed(spark, f"{work}/feed", first, second, third, fourth)
    log = progress.ProgressLog(spark, f"{work}/progress")
    spark.streams.addListener(log)
    try:
        query = landing.publish_summary(events, f"{work}/summary", f"{work}/check", interval=None, delay="1 hour")
        landing.wait_all([query])
        until = time.time() + 30
        while len(files.children(spark, f"{work}/progress")) < 4 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = progress.summary_losses(spark, f"{work}/summary", f"{work}/progress", str(query.id)).orderBy("batch").collect()
    assert [tuple(r) for r in rows if r["arrived"]] == [(0, 50, 50, 0), (1, 20, 20, 0), (2, 15, 5, 10), (3, 1, 1, 0)]
    kept = {r["batch"]: r for r in progress.read_progress(spark, f"{work}/progress").collect()}
    assert kept[2]["groups_dropped"] == 1 and kept[2]["watermark"] and kept[1]["state_rows"] > 0


def test_a_sink_without_its_rows_is_named(spark):
    work = scratch_dir(spark, "balance")
    day = datetime(2024, 1, 10)
    good = [[event(10 * k + i, day + timedelta(hours=i)) for i in range(5)] for k in range(3)]
    bad = [(None, "t", "PL1", "H", None, "SUCCESS", day)]
    messages = encode_events(feed(spark, f"{work}/feed", good[0] + bad, good[1], good[2] + bad * 2))
    landing.wait_all([landing.land_all(messages, work, f"{work}/check", interval=None)])
    rows = progress.ingest_balance(spark, work).orderBy("load").collect()
    assert [tuple(r)[1:] for r in rows] == [(6, 5, 1, 5, 1, True), (5, 5, 0, 5, 0, True), (7, 5, 2, 5, 2, True)]
    hour = f"{work}/raw/year=2024/month=1/day=10/hour=2"
    assert f"load={rows[1]['load']}" in files.children(spark, hour)
    files.remove(spark, f"{hour}/load={rows[1]['load']}")
    after = progress.ingest_balance(spark, work).orderBy("load").collect()
    assert [r["balanced"] for r in after] == [True, False, True] and after[1]["raw_rows"] == 4
