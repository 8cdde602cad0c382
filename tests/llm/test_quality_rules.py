"""Measures against their definitions, certified cutoffs against exact arithmetic."""

import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from gantry.llm import quality_rules as q


def defined(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, straight from the definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_are_as_defined():
    rng = random.Random(4)
    pieces = ["a", "b", "é", "a#", " ", " ", "\n", "\n", "\t", "𐍈x", "|", "<>", "\r", "\u00a0", "the"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        expected = defined(text)
        found = dict(zip(q.MEASURES, q.measure(text.encode())))
        if not expected[0]:
            assert set(found.values()) == {0}
        else:
            assert tuple(found[m] for m in q.MEASURES[:5]) == expected, text


def test_a_very_long_text_is_measured_whole():
    text = ("one two three four\n" * 200_000).encode()
    found = dict(zip(q.MEASURES, q.measure(text)))
    assert found["n_words"] == found["n_repeat_words"] == 800_000 and found["n_dup_lines"] == 199_999


@pytest.mark.parametrize("n, p", [(1, 0.1), (17, 0.01), (60, 0.3)])
def test_binomial_tail_is_exact(n, p):
    share = Fraction(p)
    for k in range(n + 1):
        exact = sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
        assert q.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)


def test_cutoff_is_the_laxest_that_gains_most_and_needs_enough_labels():
    good, bad = np.zeros(100), np.zeros(100)
    good[0], bad[60] = 5000, 100  # the bad ones exceed 60 cutoffs
    assert q.choose_cutoff(good, bad, 0.01, 0.001) == q.GRID[99 - 60]
    assert q.choose_cutoff(np.eye(1, 100)[0] * 100, bad, 0.01, 0.001) is None  # 0.99^100 is no proof
    assert q.choose_cutoff(good, np.zeros(100), 0.01, 0.001) is None
    few = np.zeros(100)
    few[0], few[60] = 99, 1
    assert q.choose_cutoff(good, few, 0.01, 0.001) is None  # one of a hundred may be chance
    few[60] = 12
    assert q.choose_cutoff(good, few, 0.01, 0.001) == q.GRID[99 - 60]
    good[60] = 400  # now any useful cutoff rejects 400 of 5400 good ones
    assert q.choose_cutoff(good, bad, 0.01, 0.001) is None


def corpus(rng, n, lang, junk):
    vocabulary = [f"{lang}{i}" for i in range(3000)]
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        yield " ".join(w + "$$$" if junk else w for w in words)


def test_junk_goes_and_clean_documents_stay(spark, docs):
    rng = random.Random(2)
    texts = [(t, "en", 1) for t in corpus(rng, 4500, "en", False)] + [(t, "en", 0) for t in corpus(rng, 300, "en", True)]
    texts += [(t, None, 1) for t in corpus(rng, 50, "fr", False)] + [(t, None, 0) for t in corpus(rng, 20, "fr", True)]
    rows = [(i, t, lang, "s") for i, (t, lang, _) in enumerate(texts)]
    labels = spark.createDataFrame([(i, quality, 0) for i, (_, _, quality) in enumerate(texts)], "doc_id bigint, quality int, toxic int")
    frame = docs(rows, ["'x' AS kept", "1 AS n_words", "2 AS stratum"])
    found = {r["doc_id"]: r for r in q.quality(frame, labels).collect()}
    for i, (_, lang, quality) in enumerate(texts):
        assert not found[i]["base_failed"]
        # Fifty labels prove nothing, so the stratum without a language keeps all.
        assert found[i]["kept"] == (quality == 1 or lang is None)
    kept = q.keep_good(frame, labels)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_edges(spark, docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en"), (2, "", None), (3, " \n ", "en"), (None, good, None), (4, good, "en"), (4, good, "en"), (5, "a b c " * 40, "en")]
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in q.quality(docs(rows), labels).collect())
    assert found == [
        ("1", 0, True, False), ("2", 0, True, False), ("3", 0, True, False), ("4", 60, False, True), ("4", 60, False, True),
        ("5", 120, True, False), ("None", 60, False, True)]
    assert q.quality(docs([]), labels).count() == 0
    assert q.quality(docs(rows), labels.limit(0)).where("kept").count() == 3


def test_strata_too_small_for_a_proof_are_judged_together(spark, docs):
    rng = random.Random(6)
    texts = [(t, "en", 1) for t in corpus(rng, 900, "en", False)] + [(t, "en", 0) for t in corpus(rng, 60, "en", True)]
    for lang in ("de", "fr", None):  # none of them proves a cutoff alone
        texts += [(t, lang, 1) for t in corpus(rng, 320, "x", False)] + [(t, lang, 0) for t in corpus(rng, 20, "x", True)]
    texts += [(t, "es", None) for t in corpus(rng, 5, "es", False)]
    rows = [(i, t, lang, "s") for i, (t, lang, _) in enumerate(texts)]
    labels = spark.createDataFrame([(i, quality, 0) for i, (_, _, quality) in enumerate(texts)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in q.quality(docs(rows), labels).collect()}
    assert all(found[i] == (quality != 0) for i, (_, _, quality) in enumerate(texts))


def test_who_is_pooled_follows_from_the_numbers_of_labels():
    sizes = {"en": (5000, 300), "de": (400, 50), None: (300, 20), "fr": (5000, 1)}
    assert q.own_strata(sizes, 6, 0.01, 0.05) == {"en"}
    assert q.own_strata({"en": (5000, 300)}, 6, 0.01, 0.05) == {"en"}
    assert q.own_strata({}, 6, 0.01, 0.05) == set()
