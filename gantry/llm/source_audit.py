"""How the sources of a language differ in the terms they use.

The terms are counted by `term_counts`, combined in each task, and gathered once by language and
term; a language keeps the terms that enough of its documents have. A group (a language and a
source) gives each kept term the share p = 1 + floor(10^9 (n + 2) / (N + 2 V)), with n its count
there, N the sum of them and V the number of kept terms. Two shares differ by
f = floor((p - q)^2 / (p + q)). All numbers are integers, products above 64 bits are decimals.

Two sources differ by the sum of f over all kept terms, also those that one or both of them
lack. Terms that both lack have one f for the pair, a term that one of them lacks has one that
depends on the other's share of a missing term only; so the sum is V times the first, plus what
each source's own terms differ from that (a histogram of shares suffices), plus a correction for
the terms that both have, which meet in a join on language and term. Nothing is filled up with
zeros. A key of that join has as many rows as sources use the term, and the number of results
is by contract that of the pairs of sources; it is not one of pairs of documents.

Cases: null text, lang and source are read as empty; a source without terms differs like any
other; a language without kept terms gives each pair of its sources the value 0; every row counts
as a document, also one that repeats an id; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import settled
from gantry.llm.term_counts import count_terms

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000


def share(n: str, total: str, terms: str) -> Column:
    """p of a count, exact also where the product is above 64 bits; null without kept terms."""
    whole = f"CAST({total} + 2 * {terms} AS DECIMAL(20,0))"
    return F.expr(f"1 + CAST(CAST({n} + 2 AS DECIMAL(20,0)) * {SCALE}BD AS DECIMAL(38,0)) div nullif({whole}, 0)")


def difference(p: str, q: str) -> str:
    """Both at most 10^9 + 1, so that the square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms in at least `least_docs` documents of the language.

    One shuffle by language and term serves the sums by source and those of the language; a key
    has a row for each source after the first of them.
    """
    gathered = count_terms(docs).repartition("lang", "term")
    by_source = gathered.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = W.partitionBy("lang", "term")
    summed = by_source.withColumns({"lang_n": F.sum("n").over(of_lang), "_docs": F.sum("docs").over(of_lang)})
    return summed.where(F.col("_docs") >= least_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n")


def sized_groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, v, total, lang_total, p0): a row for each group, p0 the share of a term it lacks."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    per_lang = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    per_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    joined = groups.join(per_lang, "lang", "left").join(per_group, ["lang", "source"], "left")
    zeros = joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "total", "lang_total")])
    return zeros.withColumn("p0", share("0", "total", "v"))


def over_used(scored: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, the most different first.

    The rank's limit is applied before the shuffle, so a large group sends `top` rows from each task.
    """
    more = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)


def between_sources(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of each source and each other source of its language."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    in_none = one.join(two, "lang").where("a < b").select(
        "lang", "a", "b", F.expr(f"coalesce(v * {difference('a0', 'b0')}, 0)").alias("value"))

    shares = scored.groupBy("lang", F.col("source").alias("a"), "p", F.col("p0").alias("a0")).agg(F.count("*").alias("m"))
    in_one = shares.join(two, "lang").where("a <> b").select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.expr(f"m * ({difference('p', 'b0')} - {difference('a0', 'b0')})").alias("value"))

    left = scored.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = scored.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    shared = f"{difference('pa', 'pb')} - {difference('pa', 'b0')} - {difference('a0', 'pb')} + {difference('a0', 'b0')}"
    in_both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(shared).alias("value"))

    pairs = settled(
        in_none.unionByName(in_one).unionByName(in_both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit")
    both_ways = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return both_ways.withColumn("rank", F.row_number().over(by_value))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` between sources, part `term` of the terms used most."""
    terms = settled(kept_terms(docs, least_docs), "audit")
    groups = settled(sized_groups(docs, terms), "audit")
    scored = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = between_sources(scored, groups).withColumn("part", F.lit("pair"))
    return pairs.select(*columns).unionByName(over_used(scored, top).withColumn("part", F.lit("term")).select(*columns))
