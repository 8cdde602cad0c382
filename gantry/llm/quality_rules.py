"""Quality rules whose cutoffs are certified on labelled documents.

Each rule is a score of one document, high for junk. A rule rejects a document of a stratum
when the score is above the stratum's cutoff, and a cutoff may be used only if labelled good
documents prove that it rejects few of them: the exact binomial test must refute "more than
`risk` of the good documents are rejected". Within a rule and stratum cutoffs are tested from
the laxest to the strictest and testing stops at the first that fails, so the whole chain is one
test; over all rules and strata the error is divided by their number (Bonferroni). With
probability 1 - `error` no rule rejects more than `risk` of the good documents of any stratum,
and all rules together no more than `risk` times their number. Among the certified cutoffs the
one is chosen that gains most: the share of labelled bad documents rejected less the share of
good ones, the laxest if several gain the same. The gain has to be proven as well, by the same
test turned round: labelled bad documents must refute "no more than `risk` of the bad ones are
rejected". So a rule that junk does not break is not used, however harmless.

A stratum with too few labels for any proof of its own is judged with all others like it: they are
one pool with its own chain for each rule, counted in the correction. Who belongs to the pool
follows from the numbers of labels alone. What is proven for the pool holds for its documents
taken together, not for each of its strata, and takes labels that were drawn from all of them
alike. If the pool is too small as well, only the base rule judges it.

Cases: a null or blank text has no words, scores 0 and fails the base rule; a null stratum is a
stratum of its own; a document labelled more than once counts as good only if all labels say so,
null labels and labels of unknown documents do not count; rows that repeat an id each get a
verdict, and count once in the tests, with their largest score; without labels only the base
rule judges. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import settled, slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
REPEAT_PERCENT = 50

RISK = 0.01
ERROR = 0.05
#: Cutoffs that are tested, from the laxest.
GRID = tuple(round(0.99 - 0.01 * i, 2) for i in range(99))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_same")


def measure(text: bytes) -> tuple[int, ...]:
    """The numbers of MEASURES for one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    code_points = len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    word_chars = code_points - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        # A pair of words gets a number below n, so a window is two numbers in one long.
        _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
        _, window, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[window] > 1)
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[twice + i] = True
        repeated = int(covered.sum())
    n_upper = len(text) - len(text.translate(None, CAPITALS))
    n_letters = len(text) - len(text.translate(None, CAPITALS + CAPITALS.lower()))
    return (
        n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), n_upper, n_letters,
        text.count(b"!"), int(np.count_nonzero(ids[1:] == ids[:-1])),
    )


def with_measures(docs: DataFrame, stratum: str = "lang", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry`, the stratum and the numbers of MEASURES of every row."""
    n = len(carry) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            rows = [measure(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(n)]
            numbers = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *numbers], [*carry, "stratum", *MEASURES])

    rows = docs.select(*carry, F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("binary").alias("text"))
    result = rows.drop("text").select("*", *[F.lit(0).cast("bigint").alias(m) for m in MEASURES])
    return rows.mapInArrow(run, result.schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def scores() -> dict[str, Column]:
    """Each between 0 and 1 for natural text."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "capitals": _share("n_upper", "n_letters"),
        "shouts": F.least(F.lit(1.0), _share("n_marks", "n_words")),
        "same": _share("n_same", "n_words"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with probability p, summed term by term."""
    if k >= n:
        return 1.0
    terms = (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    )
    return min(1.0, math.fsum(map(math.exp, terms)))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> float | None:
    """The certified cutoff that gains most, or None.

    `good` and `bad` count documents by the number of GRID cutoffs that reject them: one that
    the laxest cutoff rejects is rejected by all.
    """
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best, gain = None, 0.0
    for i, cutoff in enumerate(GRID):
        # Rejected by cutoff i: documents that at least len(GRID) - i cutoffs reject.
        lost = int(good[len(GRID) - i:].sum())
        if not n_good or binomial_tail(lost, n_good, risk) > error:
            break
        caught = int(bad[len(GRID) - i:].sum())
        # P(X >= caught) of n trials is P(Y <= n - caught) of the trials that miss.
        if not caught or binomial_tail(n_bad - caught, n_bad, 1 - risk) > error:
            continue
        gained = caught / n_bad - lost / n_good
        if gained > gain + 1e-12:
            best, gain = cutoff, gained
    return best


def own_strata(sizes: dict, rules: int, risk: float, error: float) -> set:
    """Of {stratum: (good, bad)} labels those with enough for a proof of their own; the rest are the pool."""
    def enough(n: tuple[int, int], chains: int) -> bool:
        least = error / chains
        return binomial_tail(0, n[0], risk) <= least and binomial_tail(0, n[1], 1 - risk) <= least

    own = set(sizes)
    while own:
        # A stratum that leaves for the pool may bring the number of chains down, never up.
        left = {s for s in own if enough(sizes[s], rules * (len(own) + (len(own) < len(sizes))))}
        if left == own:
            break
        own = left
    return own


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff): at most one row for each rule and stratum.

    Only counts leave the join with the labels: for each rule, stratum and verdict, how many
    documents are rejected by how many cutoffs.
    """
    rules = scores()
    verdicts = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    largest = measured.where(~base_failed()).groupBy("doc_id", "stratum").agg(*[F.max(s).alias(r) for r, s in rules.items()])
    long = largest.join(verdicts, "doc_id").select(
        "stratum", (F.col("quality") > 0).alias("good"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in rules])).alias("_s"),
    )
    grid = F.array(*[F.lit(c) for c in GRID])
    above = F.size(F.filter(grid, lambda c: F.col("_s.score") > c))
    counts = long.select("stratum", "good", F.col("_s.rule").alias("rule"), above.alias("above"))
    counts = settled(counts.groupBy("stratum", "rule", "good", "above").agg(F.count("*").alias("n")), "quality")
    rule_names = list(rules)
    # A row for each stratum: every labelled document has a score of every rule.
    labelled = counts.where(F.col("rule") == rule_names[0]).groupBy("stratum").agg(
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("good"), F.col("n")).otherwise(0)).alias("bad")).collect()
    own = own_strata({r["stratum"]: (r["good"], r["bad"]) for r in labelled}, len(rules), risk, error)
    chains = len(rules) * (len(own) + (len(own) < len(labelled)))
    is_own = F.lit(False)
    if own - {None}:
        is_own = F.coalesce(F.col("stratum").isin(sorted(own - {None})), F.lit(False))
    if None in own:
        is_own = is_own | F.col("stratum").isNull()
    pooled = counts.withColumn("pool", ~is_own).withColumn("stratum", F.when(is_own, F.col("stratum")))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(len(GRID) + 1)
        sums = {g: np.bincount(part["above"], part["n"], len(GRID) + 1) for g, part in rows.groupby("good")}
        cutoff = choose_cutoff(sums.get(True, none), sums.get(False, none), risk, error / chains)
        first = rows.iloc[0]
        found = [] if cutoff is None else [(first["pool"], first["stratum"], first["rule"], cutoff)]
        return pd.DataFrame(found, columns=["pool", "stratum", "rule", "cutoff"])

    found = settled(pooled.groupBy("pool", "stratum", "rule").applyInPandas(decide, "pool boolean, stratum string, rule string, cutoff double"), "quality")
    # The pool's cutoffs go to each of its strata, labelled or not.
    others = measured.select("stratum").distinct().where(~is_own)
    shared = others.crossJoin(found.where("pool").select("rule", "cutoff"))
    return found.where("NOT pool").select("stratum", "rule", "cutoff").unionByName(shared)


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`measured` with base_failed and kept."""
    limits = settled(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_limits")), "quality")
    limits = limits.withColumnRenamed("stratum", "_stratum")
    joined = measured.join(limits, measured["stratum"].eqNullSafe(limits["_stratum"]), "left")
    over = F.lit(False)
    for rule, score in scores().items():
        over = over | F.coalesce(score > F.col("_limits")[rule], F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_limits")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, measures, base_failed, kept) of every row of `docs`."""
    measured = settled(with_measures(docs, stratum), "quality")
    return judge(measured, certify(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of `docs` that are kept.

    Each text goes to Python once, inside its row, and is measured once: rows and measures are
    written as one table, the cutoffs come from its narrow columns, and the rest is a filter.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 2 << 20):
            texts = batch.column(0).field(at)
            rows = [measure(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            numbers = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], ["_doc", "stratum", *MEASURES])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(stratum).cast("string").alias("stratum"))
    result = whole.select("*", *[F.lit(0).cast("bigint").alias(m) for m in MEASURES])
    measured = settled(whole.mapInArrow(run, result.schema), "quality")
    cutoffs = certify(measured.select(F.col("_doc.doc_id").alias("doc_id"), "stratum", *MEASURES), labels)
    return judge(measured, cutoffs).where("kept").select("_doc.*")
