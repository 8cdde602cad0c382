"""Fields beside the event schema: kept with their types, landed, and reported."""

import json

from compare import duck_rows, spark_rows

import duckdb_sql
from __spark_entry__ import own_queries as queries
from gantry.operators import events as ev
from gantry.operators.drift import drift_report
from gantry.schemas import EXTRA
from gantry.session import scratch_dir
from gantry.sources.readers import read_raw
from gantry.streaming import landing

TEXTS = [
    '{"transaction_id":"a","amount":5,"lane":1,"x":1,"y":{"k":[1,"2",null]}}',
    '{"transaction_id":"b","amount":"much","lane":"L1","x":"one"}',
    '{"transaction_id":"c","amount":null,"x":null}',
    '{"transaction_id":"d","x":1,"x":2}',
    '{"Lane":3}', "{}", "", "[1,2]", "7", "{broken", None, '{"transaction_id":"e","long":"' + "w " * 300_000 + '"}',
]


def messages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value STRING").selectExpr("CAST(value AS BINARY) AS value", "'clash' AS field")


def test_unknown_fields_keep_their_types(spark):
    rows = ev.parse_events(messages(spark, TEXTS), keep=[EXTRA]).collect()
    extra = [None if r[EXTRA] is None else json.loads(r[EXTRA]) for r in rows]
    assert extra[:3] == [{"x": 1, "y": {"k": [1, "2", None]}}, {"x": "one"}, {"x": None}]
    assert extra[4] == {"Lane": 3} and extra[5:11] == [None] * 6
    assert extra[11] == {"long": "w " * 300_000}
    assert [r["transaction_id"] for r in rows][:4] == list("abcd")


def test_report_counts_fields_and_losses(spark):
    report = {r["field"]: tuple(r)[1:] for r in drift_report(messages(spark, TEXTS)).collect()}
    assert report["x"] == (False, 5, 1, 0, "VARIANT")
    assert report["y"] == (False, 1, 0, 0, "OBJECT<k: ARRAY<VARIANT>>")
    assert report["lane"] == (True, 2, 0, 1, "VARIANT")
    assert report["amount"][:4] == (True, 3, 1, 1)
    assert report["Lane"][:4] == (False, 1, 0, 0)
    assert report["long"] == (False, 1, 0, 0, "STRING")
    assert drift_report(messages(spark, [])).count() == 0
    assert drift_report(messages(spark, [None, "", "{}"])).count() == 0


def test_landed_by_one_read_of_a_stream(spark, sf):
    """The raw zone has the new fields; quarantined rows have them in their payload."""
    from gantry.sources.readers import stream_parquet
    from gantry.sources.testdata import raw_events, with_new_fields

    work = scratch_dir(spark, "drift")
    with_new_fields(raw_events(spark, sf)).write.parquet(f"{work}/feed")
    feed = stream_parquet(spark, f"{work}/feed", spark.read.parquet(f"{work}/feed").schema)
    landing.wait_all([landing.land_all(feed, work, f"{work}/check", interval=None)])
    landed = read_raw(spark, f"{work}/raw").where("extra IS NOT NULL").select("transaction_id", "event_ts", "lane", EXTRA)
    assert spark_rows(landed) == duck_rows(duckdb_sql.all_sql()["extra_fields_landed"], sf)[1]
    assert EXTRA not in spark.read.parquet(f"{work}/rejected").columns


def test_report_has_one_row_a_field_in_its_shuffle(spark, sf):
    plan = queries()["schema_drift"](spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and plan.count("partial_schema_of_variant_agg") == 1
