"""The feed of the stream queries, and messages that are read once whatever is asked of their fields."""

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

import duckdb_sql
from __spark_entry__ import own_queries as queries
from gantry.operators import events as ev
from gantry.schemas import EXTRA, WIRE_FIELDS
from gantry.session import scratch_dir
from gantry.sources import files, testdata


@pytest.fixture(scope="module")
def spread(spark, sf):
    """The events in three files, each of all days, which three tasks read."""
    root = scratch_dir(spark, "spread")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3, "event_id").write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", ["stream_dedup", "stream_live_summary"])
def test_a_table_of_several_tasks_loses_no_row_to_the_watermark(spark, sf, spread, name):
    assert spark_rows(queries()[name](spark, spread)) == duck_rows(duckdb_sql.all_sql()[name], sf)[1]


def test_a_trigger_is_a_span_however_many_files_it_has(spark, spread):
    work = scratch_dir(spark, "spans")
    stream = testdata.stream_in_order_of_time(spark, spread, f"{work}/feed")
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{work}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 6
    fed, given = (spark.read.parquet(f"{root}/events.parquet") for root in (f"{work}/feed", spread))
    assert spark_rows(fed) == spark_rows(given)


def test_spans_of_fewer_rows_than_files_have_as_many_files(spark, spread):
    work = scratch_dir(spark, "sparse")
    some = spark.read.parquet(f"{spread}/events.parquet").where("day(ts) IN (1, 30) AND event_id % 5 = 0")
    some.write.parquet(f"{work}/events.parquet")
    testdata.in_order_of_time(spark, work, f"{work}/feed", files_each=4)
    assert sum(n.endswith(".parquet") for n in files.children(spark, f"{work}/feed/events.parquet")) == 24
    assert spark_rows(spark.read.parquet(f"{work}/feed/events.parquet")) == spark_rows(some)


def test_conditions_on_fields_do_not_read_the_text_again(spark):
    texts = spark.createDataFrame([("{}",)], "value STRING").selectExpr("CAST(value AS BINARY) AS value")
    plan = ev.validate_and_enrich(ev.parse_events(texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_unknown_fields_of_odd_texts(spark):
    """As when the values of every message are read."""
    texts = [
        "{}", "", " ", "null", "7", "[1]", '[{"x":1}]', "{'x':1}", "{x:1}", '{"x":1} more', '{"x":1,"lane":', '{"lane":1,"x":', '{"lane":1}}',
        '{"lane":1,"lane":2}', '{"x":{"lane":1}}', '{"lane":{"x":1}}', '{"Lane":1}', '{"lane":1,"x":01}', '{"":1}', '{"l\\u0061ne":1}', '{"lane":1', None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING")
    whole = F.map_filter(ev.all_fields(F.col("text")), lambda name, _: ~name.isin(*WIRE_FIELDS))
    both = rows.select("text", ev.extra_fields(F.col("text")).alias(EXTRA), F.nullif(F.to_json(whole), F.lit("{}")).alias("whole")).collect()
    assert [(r["text"], r[EXTRA]) for r in both] == [(r["text"], r["whole"]) for r in both]
