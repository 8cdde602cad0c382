"""Lyndon arrays, runs and collapsed texts against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gantry.llm import lyndon, periodic_runs
from gantry.llm.queries import looped
from gantry.llm.queries import queries as llm_queries


def longest_lyndon(w):
    out = []
    for i in range(len(w)):
        words = [w[i:j] for j in range(i + 1, len(w) + 1)]
        out.append(max(len(u) for u in words if all(u < u[k:] for k in range(1, len(u)))))
    return out


def brute_runs(w, e=4, m=6):
    n, out = len(w), []
    for q in range(1, n // e + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            x = w[i:j + q]
            smaller = any(all(x[k] == x[k + r] for k in range(len(x) - r)) for r in range(1, q))
            if len(x) >= max(m, e * q) and not smaller:
                out.append((i, len(x), q))
            i = j
    return sorted(out)


def sequences(rng, n):
    for _ in range(n):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 8)
            w[a:a] = [rng.randrange(3) for _ in range(p)] * rng.randrange(1, 7)
        yield w


def test_groups_are_the_lyndon_array():
    for w in sequences(random.Random(1), 150):
        size, word = lyndon.lyndon_groups(np.array(w, np.int64))
        assert size.tolist() == longest_lyndon(w)
        own = [tuple(w[i:i + s]) for i, s in enumerate(size.tolist())]
        assert len(set(zip(word.tolist(), own))) == len(set(word.tolist())) == len(set(own))


@pytest.mark.parametrize("e,m", [(2, 2), (3, 1), (4, 6), (5, 1)])
def test_runs_of_sequences_in_a_row(e, m):
    rng = random.Random(e)
    for _ in range(60):
        parts = list(sequences(rng, 4))
        ends = np.cumsum([len(p) for p in parts])
        expected = [(a + int(end) - len(p), n, q) for p, end in zip(parts, ends) for a, n, q in brute_runs(p, e, m)]
        assert lyndon.find_runs(np.array(sum(parts, []), np.int64), ends, e, m) == sorted(expected)


def test_no_sequence_and_empty_ones():
    assert lyndon.find_runs(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
    assert lyndon.find_runs(np.zeros(0, np.int64), np.zeros(3, np.int64)) == []
    assert lyndon.find_runs(np.zeros(8, np.int64), np.array([0, 4, 4, 8])) == []


def test_long_sequences_in_linear_time():
    for w in (np.zeros(400_000, np.int64), np.arange(400_000) % 2, np.arange(400_000) % 100_000):
        period = len(np.unique(w))
        assert lyndon.find_runs(w, np.array([len(w)])) == [(0, len(w), period)]


def test_words_without_repetition_are_not_grouped(monkeypatch):
    monkeypatch.setattr(lyndon, "lyndon_groups", None)
    rng = np.random.default_rng(0)
    assert lyndon.find_runs(rng.integers(0, 20_000, 50_000), np.array([50_000])) == []


def defined(text, doc_id=None):
    """What the query says of one text."""
    words = (text or "").encode().split()
    places = looped(doc_id, len(words))
    if places is not None:
        words = [words[i] for i in places]
    runs = brute_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts(rng):
    yield from [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "x " + "a b " * 6 + "a y", "é è " * 9, "A a " * 5]
    for w in sequences(rng, 120):
        yield rng.choice([" ", "\n", "  "]).join(f"w{i}" for i in w)


def test_query_on_a_fixture(spark, docs, tmp_path):
    rows = list(enumerate(texts(random.Random(5)))) + [(3, "a " * 20), (3, "a " * 20), (None, "q r " * 9), (-7, "k " * 9)]
    docs(rows, ["1 AS start", "2 AS n_runs", "'x' AS runs", "'y' AS collapsed"]).write.parquet(f"{tmp_path}/documents.parquet")
    found = llm_queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((i, *defined(t, i))) for i, t in rows)


def test_query_on_the_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len((r["text"] or "").split()) < 400}
    found = {r["doc_id"]: tuple(r)[1:] for r in llm_queries()["op12_periodic_runs"](spark, sf).collect()}
    assert len(found) == len(rows) and len(short) > len(rows) / 2
    assert {i: found[i] for i in short} == {i: defined(t, i) for i, t in short.items()}


def test_operator_without_arrangement(spark, docs):
    found = periodic_runs.detect(docs([(1, "x " + "a b " * 4 + "c"), (2, None)])).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found] == [(10, [(1, 8, 2)], "x a b c"), (0, [], "")]
    assert periodic_runs.detect(docs([])).count() == 0
    two = periodic_runs.detect(docs([(1, "a b a b c")]), least_exponent=2, least_length=2).collect()
    assert [tuple(x) for x in two[0]["runs"]] == [(0, 4, 2)]
    with pytest.raises(ValueError):
        periodic_runs.detect(docs([]), least_exponent=1)


def test_the_arrangement_follows_the_contract():
    for doc_id in range(300):
        n = 1 + doc_id % 37
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        expected = None if h % 10 else [i if i < a else a + (i - a) % p for i in range(n)]
        found = looped(doc_id, n)
        assert (None if found is None else found.tolist()) == expected
    assert looped(None, 5) is None and looped(0, 0) is None
