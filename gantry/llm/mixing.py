"""Mixing sources to target weights, with DataFrame functions only.

A source's rate is its target number of words over the words it has. Each document is taken
floor(rate) times, and once more when a number hashed from the seed and its id falls below the
fraction of the rate. So a source's expected words are its target, no document is taken more
than ceil(rate) times, and a run on the same rows takes the same copies.

Cases: null, empty and blank texts have size 0 and are copied like others; a null source is a
source of its own, the last one; null ids draw as the text "null"; rows that repeat an id draw
alike, each one for itself; a source without words, and any source of a corpus without words,
has target and rate 0. Columns of the operator's own must not be in the input: the caller
selects or renames (`mix` says so with an error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import WORD, settled, unit_hash


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target, rate) from rows (source, size).

    Weights go round in code-point order of the sources, null last, and share the whole size.
    A target stops at `most` times its source's size; the excess goes to the others by weight
    until none is above. That is one level L with target = min(most * size, L * weight): sources
    in order of size per weight reach their limit first, so running sums find the level. The
    windows without a key run over one row for each source, after a map-side sum.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighted = per_source.withColumn("weight", weight.cast("bigint"))
    by_limit = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_limit.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("_total"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("_limits"),
        F.sum("weight").over(from_here).alias("_weights"),
    )
    left = F.col("_total") - F.col("_limits")
    limited = ranked.withColumn("_limited", F.col("source_size") * most * F.col("_weights") <= left * F.col("weight"))
    # The first source below its limit has the level; sources after it are below theirs too.
    level = F.max(F.when(~F.col("_limited"), left / F.col("_weights"))).over(everything)
    target = F.when(F.col("_limited"), (F.col("source_size") * most).cast("double")).otherwise(
        F.least(level * F.col("weight"), (F.col("source_size") * most).cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        limited.withColumn("target", target)
        .select("source", F.col("source_size").cast("bigint").alias("source_size"), "weight", "target", rate.alias("rate"))
    )


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """`docs` with source_size, target, rate and `copies`, the times that a document is taken."""
    own = {"source_size", "weight", "target", "rate", "copies"} & set(docs.columns)
    if own:
        raise ValueError(f"columns {sorted(own)} are the operator's own: rename them first")
    right = targets.withColumnRenamed("source", "_mixed_source")
    joined = docs.join(right, docs["source"].eqNullSafe(right["_mixed_source"]), "left").drop("_mixed_source")
    whole = F.floor("rate")
    extra = F.when(unit_hash(seed, key) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + extra).cast("bigint"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as many times as its `copies`, numbered from 0 in `copy`; none for 0."""
    taken = mixed.where("copies > 0")
    return taken.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")).drop("copies")


def plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of the sources of `docs`, written down: a row for each source."""
    sizes = docs.select("source", n_words().alias("size"))
    return settled(source_targets(sizes, weights, most), "mix")


def remix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of `docs`, each as many times as it is taken."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "source")
    return emit(mix(whole, plan(docs, weights, most), seed=seed)).select("_doc.*")
