"""Connected components by alternating stars, on tables that are written after each round.

Each round does two steps. Large star: every node links its larger neighbours to the smallest
node that it knows. Small star: every node links its smaller neighbours, and itself, to the
smallest of them. Both keep the components; when a round changes nothing, each component is a
star around its smallest node. A step is an aggregate of one value per node, combined before
the shuffle, and a join, which Spark splits where a node has many links; no group of links is
ever held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import discard, settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger a, smaller b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _downwards(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that tell one set of edges from the next."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link, root being the smallest node it reaches.

    `links` has two columns of one orderable type, in any direction, repeats and self-links
    allowed (a node with none but itself has no row); null ends are no links. Raises if
    `most_rounds` are not enough, which for n nodes takes about log2(n) rounds.
    """
    a, b = links.columns
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = settled(_downwards(edges), "components")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        old, edges = edges, settled(_downwards(_small_star(_downwards(_large_star(edges)))), "components")
        discard(old)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
