"""Ranges of offsets against a plain count of every offset, and one read of a stream for all sinks."""

from collections import Counter

import pytest
from compare import spark_rows
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gantry.operators import offsets
from gantry.session import scratch_dir
from gantry.sources import files
from gantry.sources.readers import read_raw
from gantry.sources.testdata import as_messages, event_stream
from gantry.streaming import ingest, landing

SCHEMA = "topic STRING, partition INT, load INT, offset BIGINT"


def plain(rows):
    """What `audit` says, offset by offset."""
    counts = {}
    for topic, partition, _, offset in rows:
        if offset is not None:
            counts.setdefault((topic, partition), Counter())[offset] += 1
    found = []
    for key, seen in counts.items():
        at, end = min(seen), max(seen)
        while at <= end:
            last = at
            while last < end and seen[last + 1] == seen[at]:
                last += 1
            if seen[at] != 1:
                found.append((seen[at], at, last, last - at + 1, key[1], "repeated" if seen[at] else "missing", key[0]))
            at = last + 1
    return Counter(found)


def audited(spark, rows, span):
    ranges = offsets.offset_ranges(spark.createDataFrame(rows, SCHEMA), (*offsets.SOURCE, "load"), span)
    return spark_rows(offsets.audit(ranges.drop("load"), span=span))


row = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, None]), st.integers(0, 2), st.none() | st.integers(0, 25))


@settings(max_examples=6, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, max_size=60), span=st.sampled_from([1, 3, 4, 100]))
def test_audit_equals_a_plain_count(spark, rows, span):
    assert audited(spark, rows, span) == plain(rows)


@pytest.mark.parametrize("span", [4, 10, 1 << 20])
def test_planted_faults_are_found_exactly(spark, span):
    present = [o for o in range(3, 60) if o not in {8, 9, 10, 11, 12, 31} and not 40 <= o <= 52]
    rows = [("t", 0, 0, o) for o in present] + [("t", 0, 1, o) for o in range(20, 25)] + [("t", 1, 0, 5)]
    assert audited(spark, rows, span) == Counter([
        (0, 8, 12, 5, 0, "missing", "t"), (0, 31, 31, 1, 0, "missing", "t"), (0, 40, 52, 13, 0, "missing", "t"),
        (2, 20, 24, 5, 0, "repeated", "t")])


def test_nothing_landed_is_nothing_wrong(spark):
    assert audited(spark, [], 10) == Counter()


def test_offsets_beyond_what_a_double_can_tell(spark):
    top = (1 << 62) + 5
    assert audited(spark, [("t", 0, 0, top + o) for o in (0, 1, 3)], 1 << 20) == Counter([(0, top + 2, top + 2, 1, 0, "missing", "t")])


@pytest.fixture(scope="module")
def split(spark, sf):
    root = scratch_dir(spark, "split")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3, "event_id").write.parquet(f"{root}/events.parquet")
    return root


def messages(spark, split):
    """Three triggers of the events of two days; a message's place in its file is its offset."""
    events = event_stream(spark, split).where("event_ts IS NULL OR day(event_ts) <= 2")
    shaped = as_messages(events).where("offset % 29 <> 4")
    return shaped.withColumns({"topic": F.lit("reads"), "partition": F.lit(0)})


def everything(spark, root):
    raw = read_raw(spark, f"{root}/raw").drop("ingested_at")
    return [spark_rows(frame) for frame in (
        raw, spark.read.parquet(f"{root}/rejected"), landing.read_ranges(spark, f"{root}/ranges"),
        landing.read_totals(spark, f"{root}/totals"))]


def test_one_read_for_all_sinks(spark, sf, split):
    root = scratch_dir(spark, "one")
    query = landing.land_all(messages(spark, split), root, f"{root}/check", interval=None)
    landing.wait_all([query])
    read = sum(p["numInputRows"] for p in query.recentProgress)
    assert read == spark.read.parquet(f"{split}/events.parquet").count()  # a second read would count again
    landed, rejected = read_raw(spark, f"{root}/raw"), spark.read.parquet(f"{root}/rejected")
    assert spark_rows(landing.read_totals(spark, f"{root}/totals")) == spark_rows(landing.summary(landed))
    covered = landing.read_ranges(spark, f"{root}/ranges").agg(F.sum(F.expr("(last - first + 1) * copies"))).first()[0]
    assert landed.count() + rejected.count() == covered
    assert rejected.where("payload IS NOT NULL AND offset IS NOT NULL").count() > 0
    came = messages(spark, split).select("topic", "partition", "offset").writeStream.format("memory").queryName("came")
    came.trigger(availableNow=True).option("checkpointLocation", f"{root}/came").start().awaitTermination()
    rows = [(r["topic"], r["partition"], 0, r["offset"]) for r in spark.table("came").collect()]
    assert spark_rows(offsets.audit(landing.read_ranges(spark, f"{root}/ranges"))) == plain(rows)


@pytest.mark.parametrize("stops_at", ["_write_load", "vehicle_totals"])
def test_a_stop_between_sinks_replays_into_the_same_folders(spark, split, monkeypatch, stops_at):
    whole, broken = scratch_dir(spark, "whole"), scratch_dir(spark, "broken")
    for root in (whole, broken):
        files.create_text(spark, f"{root}/check/stream_name", "same")
    landing.wait_all([landing.land_all(messages(spark, split), whole, f"{whole}/check", interval=None)])
    real, calls = getattr(landing, stops_at), []

    def fail(*args, **kwargs):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("the machine is gone")
        return real(*args, **kwargs)

    monkeypatch.setattr(landing, stops_at, fail)
    with pytest.raises(Exception, match="the machine is gone"):
        landing.wait_all([landing.land_all(messages(spark, split), broken, f"{broken}/check", interval=None)])
    assert files.exists(spark, f"{broken}/raw") and not calls[2:]
    monkeypatch.setattr(landing, stops_at, real)
    landing.wait_all([landing.land_all(messages(spark, split), broken, f"{broken}/check", interval=None)])
    assert everything(spark, broken) == everything(spark, whole)


def test_merged_totals_say_the_same(spark, split, monkeypatch):
    root = scratch_dir(spark, "merged")
    for check in ("c1", "c2"):  # two readers of the source: their rows add up, as they do in the raw zone
        landing.wait_all([landing.land_all(messages(spark, split), root, f"{root}/{check}", interval=None)])
    want = spark_rows(landing.read_totals(spark, f"{root}/totals"))
    assert want == spark_rows(landing.summary(read_raw(spark, f"{root}/raw")))

    def stop(*_):
        raise OSError("stopped")

    # Stopped before the parts are out of force, and after it: readers see sums or parts, never both.
    for step in ("create_text", "remove"):
        with monkeypatch.context() as patched:
            patched.setattr(files, step, stop)
            with pytest.raises(OSError):
                landing.merge_totals(spark, f"{root}/totals")
        assert spark_rows(landing.read_totals(spark, f"{root}/totals")) == want
    assert landing.merge_totals(spark, f"{root}/totals") == 4
    assert landing.merge_totals(spark, f"{root}/totals") == 0
    assert spark_rows(landing.read_totals(spark, f"{root}/totals")) == want
    assert landing.merge_totals(spark, f"{root}/totals", keep=0) == 4
    assert spark_rows(landing.read_totals(spark, f"{root}/totals")) == want


def test_older_checkpoints_go_on_with_three_queries(spark, split):
    root = scratch_dir(spark, "older")
    source = messages(spark, split).select("value")
    files.create_text(spark, f"{root}/check/raw/stream_name", "older")
    queries = ingest.ingest_messages(source, f"{root}/out", f"{root}/check", interval=None, delay="40 days")
    landing.wait_all(queries)
    assert len(queries) == 3
