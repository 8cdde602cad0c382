"""Fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash
from gantry.llm import simhash
from gantry.llm.components import components


def defined(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_as_defined(spark):
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "É", " ", "\n", "\t", "x y", "\u00a0"]) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(text.encode()) == defined(text)
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()["h"]
    assert simhash.fingerprint(b"A b  C d") == one % (1 << 64)


def test_a_long_text_is_hashed_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole


def near(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("t, m, parts", [(4, 5, 4), (4, 5, 2), (3, 4, 4), (4, 7, 3), (0, 1, 1)])
def test_links_are_exact(spark, t, m, parts):
    rng = random.Random(t * 10 + m)
    centres = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = {near(rng, c, 6) for c in centres for _ in range(12)} | set(centres)
    signed = sorted(p - (1 << 64) * (p >> 63) for p in prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), t, m, parts).distinct().collect()
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) % (1 << 64)).count("1") <= t}
    assert {(r["a"], r["b"]) for r in found} == expected


def test_links_refuse_what_the_method_cannot_prove(spark):
    frame = spark.createDataFrame([(1,)], "fp bigint")
    with pytest.raises(ValueError):
        simhash.links(frame, 5, 5)
    with pytest.raises(ValueError):
        simhash.links(frame, 4, 5, 1)


def sample(rng):
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(150)] = rng.choice(words)
            rows.append((k * 7 % 97 + 100 * (k // 97), " ".join(text)))
            k += 1
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two three"), (905, "one two three"), (None, "one")]


def brute(rows):
    """(doc_id, fingerprint, component_id) of each row."""
    prints = [defined(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    root = roots(pairs, range(len(rows)))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root[i], []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(d, format(p, "016x"), least[root[i]]) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_components_are_those_of_all_pairs(spark, docs):
    rows = sample(random.Random(5))
    frame = docs(rows, ["0 AS fingerprint", "'x' AS component_id", "1 AS fp"])
    found = simhash.near_duplicates(frame).withColumn("fingerprint", simhash.hex_digits("fingerprint")).collect()
    expected = brute(rows)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in expected})


def test_hex_digits_of_unsigned_numbers(spark):
    frame = spark.createDataFrame([(0,), (-1,), (255,), (-(1 << 63),)], "f bigint")
    assert [r[0] for r in frame.select(simhash.hex_digits("f")).collect()] == ["0" * 16, "f" * 16, "00000000000000ff", "8000000000000000"]


def test_empty_table(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    pairs += [(5, 5), (5, None)] + pairs[:10]
    nodes = {n for a, b in pairs if a != b and None not in (a, b) for n in (a, b)}
    expected = roots([(a, b) for a, b in pairs if a in nodes and b in nodes], nodes)
    shuffled = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs]
    found = components(spark.createDataFrame(shuffled, "x bigint, y bigint")).collect()
    assert {r["node"]: r["root"] for r in found} == expected and len(found) == len(expected)


def test_unrelated_components_with_one_least_id_keep_a_row_each(spark, docs):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    kept = simhash.keep_one(docs([(1, a), (2, a), (1, b), (3, b)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (1, b)]
