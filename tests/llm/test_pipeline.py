"""The registered queries against DuckDB, and the pipeline against plain code stage by stage."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from gantry.llm import pii
from gantry.llm.queries import oracle_sql
from gantry.llm.queries import queries as llm_queries
from test_quality_rules import defined as measured
from test_simhash import brute as grouped

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    result = llm_queries()[name](spark, sf)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        expected = con.sql(oracle_sql()[name])
        names = sorted(expected.columns)
        assert sorted(result.columns) == names
        rows = Counter(tuple(r[expected.columns.index(c)] for c in names) for r in expected.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in result.collect()) == rows


def test_all_are_registered():
    assert {"pipeline", *llm_queries()} <= set(queries())
    assert [n.split("_")[0] for n in llm_queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows after each stage, the documents first."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_stages_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_quality_rejects_by_the_base_rule(stages):
    # So few labels certify no cutoff: what goes fails the base rule.
    def fails(text):
        n, _, _, _, repeated = measured(text)
        return n < 50 or 100 * repeated > 50 * n

    assert {r["doc_id"] for r in stages[1].collect()} == {r["doc_id"] for r in stages[0].collect() if not fails(r["text"])}


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({c for _, _, c in grouped(rows)})


def test_personal_data_go(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    for r in stages[3].collect():
        text = before[r["doc_id"]]["text"]
        assert r["text"] == pii.redact_text(text, pii.find(text)[1]) and r["n_chars"] == len(r["text"])
        assert not any(k in ("email", "card") for _, _, k in pii.find(r["text"])[0])


def test_the_mixture_repeats_documents(stages):
    before = Counter(tuple(r) for r in stages[3].collect())
    after = Counter(tuple(r) for r in stages[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 3 * max(before.values())
    size = lambda rows: sum(n * len((r[1] or "").encode().split()) for r, n in rows.items())
    assert size(after) == pytest.approx(size(before), rel=0.3)


def test_run_packs_what_the_stages_left(spark, sf, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = corpus_pipeline.run(spark, sf).collect()
    expected = Counter(tuple(r[c] for c in columns) for r in stages[5].collect())
    assert Counter(tuple(r[c] for c in columns) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def test_stages_take_edge_rows(spark, sf, docs):
    text = " ".join(random.Random(0).choice("abcdefghij") + str(i) for i in range(80))
    rows = [(None, None), (1, ""), (2, text, None, None), (2, text, None, None), (None, text, "en", "s"), (3, text + " me@x.org", "en", "s")]
    frame = docs(rows, ["cast(length(text) AS bigint) AS n_chars", "1 AS copies", "'x' AS kept", "2 AS fingerprint", "3 AS length"])
    for start in (frame, frame.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == frame.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert (last.count() > 0) == (start is frame)
