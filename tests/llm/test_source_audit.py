"""Term counts and differences between sources against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gantry.llm import source_audit, term_counts

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, least=10, top=10):
    """The audit's rows from (doc_id, text, lang, source) rows."""
    n, in_docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms_of(text)
        for t in found:
            n[lang, source, t] += 1
        for t in set(found):
            in_docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        own = sorted(s for g, s in groups if g == lang)
        kept = [t for (g, t), d in in_docs.items() if g == lang and d >= least]

        def shares(count):
            whole = sum(count(t) for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count(t) + 2) // whole for t in kept}

        p = {s: shares(lambda t, s=s: n[lang, s, t]) for s in own}
        q = shares(lambda t: sum(n[lang, s, t] for s in own))
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(differ(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            words = [(differ(p[s][t], q[t]), t) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", words, top)):
                ordered = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank + 1) for rank, (value, item) in enumerate(ordered)]
    return sorted(out)


def result(frame, **options):
    found = source_audit.audit(frame, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [t for _, t in found.dtypes] == ["string"] * 4 + ["bigint", "int"]
    return sorted(map(tuple, found.collect()))


def corpus(rng, n=120):
    words = ["The", "the", "THE", "of", "Ölfeld", "élan", "a", "x" * 8, "y" * 9, "z" * 16, "w" * 17, "v" * 40, "été-là", "naïve_word", "日本語。", "don't", "r2d2", "longer" * 30]
    for i in range(n):
        k = rng.randrange(0, 30)
        text = rng.choice([" ", "\n", "  ", ", "]).join(rng.choices(words, k=k))
        yield i % 90, rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None, "fr"]), rng.choice(["s1", "s2", "", None, "é"])


def test_against_plain_counts(docs):
    rows = [*corpus(random.Random(1)), (None, "lonely words", "xx", "s1"), (500, None, "xx", "s2"), (501, "\x00 1 2 3", "yy", None)]
    frame = docs(rows, ["1 AS n", "'q' AS term", "2 AS value", "'x' AS part", "3 AS rank"])
    assert result(frame) == brute(rows)
    assert result(frame, least_docs=1, top=3) == brute(rows, 1, 3)


def test_empty_tables_and_texts(docs):
    assert result(docs([])) == []
    rows = [(1, None, None, "a"), (2, "", None, "b"), (3, " 12 ", "", "a")]
    assert result(docs(rows)) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)] == brute(rows)


def test_a_source_without_any_kept_term_differs(docs):
    rows = [(i, "red red green", "en", "big") for i in range(12)] + [(50, "none of these", "en", "odd"), (51, None, "en", "void")]
    assert result(docs(rows)) == brute(rows)
    assert {r[1] for r in result(docs(rows)) if r[2] == "pair" and r[4] > 0} == {"big", "odd", "void"}


def test_large_counts_are_exact(spark):
    big = spark.createDataFrame([(10**12, 4 * 10**12 + 7, 5), (0, 10**13, 1), (3, 0, 0)], "n bigint, total bigint, v bigint")
    found = [r[0] for r in big.select(source_audit.share("n", "total", "v")).collect()]
    assert found == [1 + 10**9 * (10**12 + 2) // (4 * 10**12 + 17), 1 + 10**9 * 2 // (10**13 + 2), None]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_a_task_counts_as_dictionaries_do(most):
    rng = random.Random(7)
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in corpus(rng, 300)]
    counter, found = term_counts.Counter(most), defaultdict(lambda: [0, 0])
    batches = [b for a in range(0, 300, 50) for b in counter.add(
        [r[1] for r in rows[a:a + 50]], [r[2] for r in rows[a:a + 50]], [r[0].encode() for r in rows[a:a + 50]])]
    assert bool(batches) == (most == 40)  # few entries are held, so some go on early
    for batch in [*batches, *counter.rest()]:
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in batch.columns)):
            found[lang, source, term.decode()][0] += n
            found[lang, source, term.decode()][1] += docs
    expected = defaultdict(lambda: [0, 0])
    for text, lang, source in rows:
        for t, n in Counter(terms_of(text)).items():
            expected[lang, source, t][0] += n
            expected[lang, source, t][1] += 1
    assert found == expected


def test_words_in_order_are_terms_in_order():
    rng = random.Random(3)
    terms = ["".join(rng.choices("abyzéß", k=rng.randrange(1, 9))).encode() for _ in range(500)]
    terms = [t for t in terms if len(t) <= 16]
    for w, columns, at in term_counts.buckets(terms):
        order = term_counts.radix_order([*reversed(columns)])
        own = [terms[i] for i in at]
        assert [own[i] for i in order] == sorted(own) and all(len(t) <= w for t in own)


def test_radix_order_is_stable_and_right():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2), rng.integers(0, 3, 1000).astype(np.uint64)
    assert term_counts.radix_order([a, b]).tolist() == np.lexsort((a, b)).tolist()


def test_no_text_is_shuffled(docs):
    plan = source_audit.kept_terms(docs([(1, "a b", "en", "s")]).withColumn("spare", F.lit("x")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BatchEvalPython" not in plan
