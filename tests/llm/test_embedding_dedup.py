"""Links and components against all pairs."""

import numpy as np
import pytest
from gantry.llm import embedding_dedup as e

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=e.THRESHOLD):
    """{row number: (links, component)}; a pair's cosine is taken in double precision."""
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(np.array(v, np.float32), np.float64)
            good.setdefault((label, len(v)), []).append((i, x / np.linalg.norm(x)))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for members in good.values():
        x = np.stack([v for _, v in members])
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            a, b = members[a][0], members[b][0]
            links[a] += 1
            parent[find(a)] = find(b)
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(d, links[i], least[find(i)], d == least[find(i)]) for i, (d, _, _) in enumerate(rows)]


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0

    def add(v, label):
        nonlocal k
        rows.append((k * 7919 % 10_007, [float(x) for x in v], label))
        k += 1

    for _ in range(500):
        add(rng.standard_normal(16), int(rng.integers(3)))
    for size in (2, 3, 40, 1200):  # more than a window, and more than a block
        centre = rng.standard_normal(16)
        for _ in range(size):
            add(centre + rng.normal(0, 0.06, 16), 1)
    centre = rng.standard_normal(16)
    for _ in range(300):
        add(centre, 2)  # copies
    add(centre * 3, 2)
    add(centre, 0)
    chain = rng.standard_normal(16)
    for i in range(30):  # neighbours link, ends do not
        add(chain * np.cos(i * 0.3) + np.roll(chain, 3) * np.sin(i * 0.3), 0)
    expected = brute(rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS rank", "0 AS kept")
    found = e.near_duplicates(frame)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {r["vec_id"]: tuple(r)[1:] for r in found.collect()}
    assert len(got) == len(rows)
    total = sum(n for _, n, _, _ in expected)
    assert sum(min(n, got[d][0]) for d, n, _, _ in expected) >= 0.99 * total  # recall
    assert all(got[d][0] <= n for d, n, _, _ in expected)  # nothing below the threshold
    wrong = [d for d, *rest in expected if got[d] != tuple(rest)]
    assert len(wrong) <= 0.005 * len(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [2.0, 0.1], 1), (11, [1.0, 0.0], 2),
        (None, [5.0, -7.0], 3), (12, [-1.0, 0.0], 1), (13, [1e-30, 0.0], 4), (14, [3e38, 0.0], 4),
    ]
    found = e.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    got = sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in found.collect())
    assert got == sorted(str(x[:3]) for x in brute(rows))
    kept = {(r["vec_id"], r["kept"]) for r in found.collect()}
    assert (8, True) in kept and (10, False) in kept and (None, False) in kept
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("window", [1, 3])
def test_small_windows_find_neighbours_over_block_borders(spark, window, monkeypatch):
    rows = [(i, [1.0, 0.001 * (i % 7)], 1) for i in range(7)]
    found = e.near_duplicates(spark.createDataFrame(rows, SCHEMA), window=window)
    assert {(r["n_links"], r["component_id"]) for r in found.collect()} == {(6, 0)}


def test_passes_follow_the_size_of_the_label(spark):
    assert e.passes_for(1000) == e.PASSES < e.passes_for(20_000) < e.passes_for(1_000_000)
    # A window of one in a label of 6,000 is as narrow as one of sixteen in a label of 96,000.
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + (1 - 0.931**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    found = e.near_duplicates(spark.createDataFrame(rows, SCHEMA), window=1)
    assert found.where("n_links > 0").count() >= 0.985 * len(rows)
