"""N-gram rows against plain code, the learner's updates, and accuracy on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gantry.llm import ngrams
from gantry.llm import quality_classifier as qc
from gantry.llm.queries import queries as llm_queries

MASK = (1 << 64) - 1


def stir(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def kind_of(b):
    c = chr(b)
    return 0 if c in " \t\n\v\f\r" else 2 if c in "0123456789" else 1 if b >= 128 or c.isalpha() else 3


def plain_row(text, bits):
    """The row of one text, token by token."""
    tokens = []
    for b in text:
        k = kind_of(b)
        if not tokens or tokens[-1][0] != k:
            tokens.append((k, bytearray()))
        tokens[-1][1].append(b)
    tokens = [(k, bytes(t)) for k, t in tokens if k]
    hashed = lambda t: stir(sum((b + 1) * pow(ngrams._BASE, i, 1 << 64) for i, b in enumerate(t.lower())) & MASK)
    words, shapes, before = [], [], None
    for k, t in tokens:
        if k == 1:
            upper = sum(65 <= b <= 90 for b in t)
            shape = 1 if t.lower() == before else 2 if not upper else 3 if upper == 1 and 65 <= t[0] <= 90 else 4 if upper == len(t) else 5
            words.append(hashed(t))
            shapes.append(shape)
            before = t.lower()
        else:
            shapes.append(6 if k == 2 else hashed(t))
    counts = Counter()
    for units, n, seed in [(words, 1, 1), (words, 2, 2), (shapes, 1, 11), (shapes, 2, 12), (shapes, 3, 13)]:
        for i in range(len(units) - n + 1):
            h = seed
            for u in units[i:i + n]:
                h = stir((h * ngrams._BASE + u) & MASK)
            counts[h >> 64 - bits] += 1
    norm = math.sqrt(sum(c * c for c in counts.values()))
    return sorted((b, c / norm) for b, c in counts.items())


def test_rows_of_texts_in_a_row():
    rng = random.Random(1)
    texts = [b"", b" ", b"The the  the. THE\n", "Él él ÉL 12 3a!!".encode(), b"###", b"a", b"x y x y", b"don't stop ... ", "日本 日本".encode()]
    texts += [bytes(rng.choice(b"abAB12 .,!\n\xc3\xa9") for _ in range(rng.randrange(60))) for _ in range(80)]
    for bits in (10, 18):
        offsets, numbers, values = ngrams.sparse_rows(texts, bits)
        assert len(offsets) == len(texts) + 1
        for i, text in enumerate(texts):
            row = list(zip(numbers[offsets[i]:offsets[i + 1]].tolist(), values[offsets[i]:offsets[i + 1]].tolist()))
            expected = plain_row(text, bits)
            assert [b for b, _ in row] == [b for b, _ in expected]
            assert [v for _, v in row] == pytest.approx([v for _, v in expected], rel=1e-6)
    assert ngrams.sparse_rows([], 10)[0].tolist() == [0]


def test_a_learner_step_by_the_formula():
    s = qc.Settings(alpha=0.3, beta=2.0, l1=0.05, l2=0.4, bits=3)
    learner, z, n = qc.Learner(s), [0.0] * 9, [0.0] * 9
    rng = random.Random(4)
    for _ in range(200):
        numbers = sorted(rng.sample(range(8), rng.randrange(0, 5)))
        x = dict(zip(numbers, [rng.random() for _ in numbers])) | {8: 1.0}
        y = float(rng.random() < 0.7)
        w = {i: 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g
        learner.learn(np.array(numbers, np.int32), np.array([x[i] for i in numbers]), y)
    assert learner.z.tolist() == pytest.approx(z) and learner.n.tolist() == pytest.approx(n)


def corpus(rng, n):
    """Good documents and three kinds of junk, words being new in every one."""
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(20, 90))]
        junk = i % 6
        if junk == 0:
            words = [w + "$$$" for w in words]
        elif junk == 1:
            words = [w.upper() + "!!" for w in words]
        elif junk == 2:
            words = words[:1] * len(words)
        yield " ".join(words) + ".", int(junk > 2)


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, t, q, "en", "s") for i, (t, q) in enumerate(corpus(random.Random(3), 900))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, lang string, source string")
    return frame.drop("quality").selectExpr("*", "0.5 AS score", "1 AS label", "2 AS predicted").cache(), frame.selectExpr("doc_id", "quality", "0 AS toxic").cache()


def accuracy(found, labels):
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in found if r["held_out"]]
    assert len(rows) > 150
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_held_out_accuracy(learned):
    frame, labels = learned
    found = qc.classify(frame, labels).collect()
    assert [(r["doc_id"], r["held_out"]) for r in sorted(found)] == [(i, zlib.crc32(str(i).encode()) % 4 == 2) for i in range(900)]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert accuracy(found, labels) >= 0.97
    again = qc.classify(frame.repartition(5), labels.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({r["doc_id"]: r["score"] for r in found})


def test_several_learners_agree_with_one(learned):
    frame, labels = learned
    assert accuracy(qc.classify(frame, labels, learner_rows=150).collect(), labels) >= 0.95


def test_held_out_labels_are_never_read(learned):
    frame, labels = learned
    same = lambda l: {r["doc_id"]: round(r["score"], 9) for r in qc.classify(frame, l, settings=qc.Settings(passes=1)).collect()}
    turned = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert same(labels) == same(turned) != same(labels.withColumn("quality", 1 - F.col("quality")))


def test_the_sample_is_bounded(learned):
    frame, labels = learned
    assert 60 < qc.training_sample(frame, labels, most_rows=100).count() < 140
    whole = qc.training_sample(frame, labels).count()
    assert whole == labels.where(~qc.held_out()).count()


def test_edges(spark, docs):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, None), (1, ""), (2, " \n"), (3, "some words"), (3, "some words"), (4, long), (5, "!!!"), (None, "x")]
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = qc.classify(docs(rows), labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    empty = [r["score"] for r in found if r["doc_id"] in (1, 2)]
    assert empty[0] == empty[1]
    assert {r["score"] for r in qc.classify(docs(rows), labels.limit(0)).collect()} == {0.5}
    assert qc.classify(docs([]), labels).count() == 0


def test_query_on_the_given_table(spark, sf):
    found = llm_queries()["op13_quality_classifier"](spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in found.collect() if r["doc_id"] in truth and r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    assert len(rows) > 15 and right >= 0.9 * len(rows)
