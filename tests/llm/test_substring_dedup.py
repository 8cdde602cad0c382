"""The index against counting, removals against all windows of all documents."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from gantry.llm import substring_dedup as s
from gantry.llm.fm_index import FMIndex


def times(sequences, pattern):
    n = len(pattern)
    return sum(seq[i:i + n] == pattern for seq in sequences for i in range(len(seq) - n + 1))


@pytest.mark.parametrize("least", [1, 2])
def test_matching_statistics_are_counts(least):
    rng = np.random.default_rng(least)
    for _ in range(60):
        lengths = rng.integers(0, 12, rng.integers(1, 8))
        symbols = rng.integers(0, 3, lengths.sum()).astype(np.uint64) * np.uint64(1 << 62)
        if not lengths.sum():
            continue
        index = FMIndex(symbols, lengths)
        sequences = [x.tolist() for x in np.split(symbols, np.cumsum(lengths)[:-1])]
        ends = np.flatnonzero(index.text > 0)
        matched, lo, hi = index.matching(index.text, ends, 5, least)
        for e, n, a, b in zip(ends.tolist(), matched.tolist(), lo.tolist(), hi.tolist()):
            own, last = index.owner[e], e - index.starts[index.owner[e]]
            best = 0
            while best < min(5, last + 1) and times(sequences, sequences[own][last - best:last + 1]) >= least:
                best += 1
            assert n == best
            if n:
                assert b - a == times(sequences, sequences[own][last - n + 1:last + 1])


def test_unknown_symbols_match_nothing():
    index = FMIndex(np.array([5, 6, 7], np.uint64), np.array([3]))
    codes = index.codes(np.array([6, 9, 6, 7], np.uint64))
    assert index.matching(codes, np.arange(4), 3)[0].tolist() == [1, 0, 1, 2]


@pytest.mark.parametrize("most_bytes", [1, 3, 1000])
def test_words_are_hashed_as_they_are_split(most_bytes):
    rng = random.Random(most_bytes)
    known = {}
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "b", " ", "\n", "é", "  ", "\x0b", "ab"]) for _ in range(rng.randint(0, 12))).encode()
                 for _ in range(rng.randint(0, 6))]
        column = pa.array(texts, pa.binary())
        if len(texts) > 2:
            column, texts = column.slice(1), texts[1:]
        hashes, sizes = s.word_hashes(column, most_bytes)
        words = [(t or b"").split() for t in texts]
        assert sizes.tolist() == [len(w) for w in words]
        for word, value in zip((w for ws in words for w in ws), hashes.tolist()):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_digests_and_contents_tell_runs_apart():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x123456789ABC)
    first = rng.integers(0, 380, 900)
    lengths = rng.integers(1, 20, 900)
    digests, data = s.run_digests(h, first, lengths), s.contents(h, first, lengths).to_pylist()
    runs = [tuple(h[a:a + n].tolist()) for a, n in zip(first.tolist(), lengths.tolist())]
    assert len(set(runs)) == len(set(digests.tolist())) == len(set(data))
    assert [tuple(s.symbols_of(d).tolist()) for d in data] == runs


@pytest.mark.parametrize("window, q", [(13, 6), (5, 2), (4, 4), (7, 3)])
def test_equal_windows_have_equal_anchors(window, q):
    rng = np.random.default_rng(window)
    sizes = np.array([0, 3, 40, window, 200, 1])
    h = rng.integers(0, 4, sizes.sum()).astype(np.uint64)
    text, first, windows, anchor = s.segments(h, sizes, window, q)
    of = {}
    starts = np.cumsum(sizes) - sizes
    seen = set()
    for t, a, n, x in zip(text.tolist(), first.tolist(), windows.tolist(), anchor.tolist()):
        for k in range(a, a + n):
            assert starts[t] <= k and k + window <= starts[t] + sizes[t]
            assert of.setdefault(tuple(h[k:k + window].tolist()), x) == x
            seen.add(k)
    assert len(seen) == sum(max(0, n - window + 1) for n in sizes.tolist())


def brute(rows, window):
    infinity = float("inf")
    texts = [(infinity if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, infinity), d)
    out = []
    for (d, w), (doc_id, _) in zip(texts, rows):
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for k in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def sample(rng, n):
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((rng.choice([i, i, i, i // 2, None]) if rng.random() < 0.3 else i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(3, None), (4, ""), (1000, "a " * 500), (1001, "a " * 12), (1002, "a " * 13), rows[0], rows[1], (2000, rows[2][1])]


@pytest.mark.parametrize("seed, window, q, hot", [(1, 13, 6, s.HOT), (2, 13, 6, 3), (3, 5, 2, 1), (4, 6, 6, s.HOT)])
def test_removals_are_those_of_all_windows(spark, docs, seed, window, q, hot):
    rows = sample(random.Random(seed), 60)
    frame = docs(rows, ["1 AS row", "'x' AS start", "2 AS n_words"]).repartition(4)
    found = s.remove_repeats(frame, window, q, hot)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows, window)


def test_a_very_long_text_and_an_empty_table(spark, docs):
    long = " ".join(str(i % 5003) for i in range(300_000))
    rows = [(1, long), (2, "new " + long[:200_000])]
    found = sorted(map(tuple, s.remove_repeats(docs(rows)).collect()))
    assert found[0][1:3] == (300_000, 0) and found[1][1] - found[1][2] <= 2
    assert s.remove_repeats(docs([])).count() == 0
