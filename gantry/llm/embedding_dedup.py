"""Near-duplicate embeddings by sorted projection passes.

Each pass hashes a vector to the signs of its products with random directions, puts the signs in
a row and sorts the vectors of a label by that. Vectors at a small angle share long prefixes, so
they come close to each other in most passes: a vector is compared with the next WINDOW ones,
pairs with a cosine of at least the threshold are kept, and the pairs of all passes are united.
The larger a label, the shorter the prefixes that bring two vectors into one window, so the number
of passes follows from the size of the largest label: for an isolated pair at the threshold among
vectors of random directions the estimated chance of a miss is at most MISS. Passes are made in
rounds, whose rows are dropped before the next.

A window cannot hold all partners of a vector in a dense group. The united pairs tell the groups
exactly, so the rest is done there: within each component all members are compared, in blocks,
and each task adds up numbers of links and passes no pair on. Equal vectors are one class with a
count from the start, so copies are never compared.

Cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label
is null, links with nothing; vectors of different lengths do not link; rows that repeat a
vector link with each other, whatever their ids; null ids pass through and are never the
smallest; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import discard, settled, shards
from gantry.llm.components import components

THRESHOLD = 0.93
#: Passes of a round, and the least number.
PASSES = 12
#: Half of the hundredth that may be missed: prefixes hold uneven numbers of vectors, which the estimate leaves out.
MISS = 0.005
BITS = 62
WINDOW = 16
#: Rows that a task compares at a time: of a sorted pass, and of a component.
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as doubles of unit length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def usable(vector: str = "embedding", label: str = "label") -> Column:
    # A norm that is not a number or infinite tells of such components; null ones have to be asked for.
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = square.isNotNull() & ~F.isnan(square) & (square < float("inf")) & (square > 0)
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def pass_chance(size: int, threshold: float, window: int) -> float:
    """The chance that one pass over a label of `size` vectors brings a pair at the threshold into one window.

    Two vectors agree in a sign with a chance that their angle gives. If the first sign in which
    they differ comes after `shared` others, about half of the vectors with that prefix lie
    between them.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    chance = agree**BITS
    for shared in range(BITS):
        between = size / 2 ** (shared + 1)
        fits = sum(math.exp(k * math.log(between) - between - math.lgamma(k + 1)) for k in range(window))
        chance += agree**shared * (1 - agree) * min(1.0, fits)
    return min(1.0, chance)


def passes_for(size: int, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """Passes after which the estimated chance that a pair at the threshold is missed is at most MISS."""
    chance = pass_chance(max(1, size), threshold, window)
    return PASSES if chance >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-chance)))


def _hashed(classes: DataFrame, passes: int, seed: int, first: int = 0) -> DataFrame:
    """A row of each class for each pass, with its `key`: BITS signs, the first the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                if dim not in directions:
                    directions[dim] = np.random.default_rng([seed, dim, first] if first else [seed, dim]).standard_normal((dim, passes * BITS))
                signs = (_matrix(part.column(1)) @ directions[dim] >= 0).reshape(part.num_rows, passes, BITS)
                keys = (signs * weights).sum(axis=2)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, p, np.int32)), pa.array(keys[:, p]), part.column(0), part.column(2), part.column(1)],
                        ["pass", "key", "node", "label", "embedding"])

    rows = classes.select("node", "embedding", "label")
    return rows.mapInArrow(run, "pass int, key bigint, node bigint, label string, embedding array<float>")


def _ranked(rows: DataFrame) -> DataFrame:
    """`rows` with `rank`, their place in the order of pass, label, length and key."""
    keys = ["pass", "label", "dim", "key", "node"]
    ordered = rows.withColumn("dim", F.size("embedding")).repartitionByRange(shards(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    # The id counts up within a partition, and its upper bits are the partition's number.
    numbered = settled(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "embeddings")
    # One row for each partition.
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = settled(sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "embeddings")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = numbered.join(offsets, "_part").withColumn("rank", place).drop("_part", "_before", "_id")
    ranked.settled_at = numbered.settled_at
    return ranked


def _runs(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table each; rows come grouped."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def window_links(ranked: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(a, b) of the pairs that one of the next `window` rows of the same pass and label makes."""
    block = F.floor(F.col("rank") / BLOCK)
    # The first rows of a block are also the last neighbours of the one before.
    twice = F.when((F.col("rank") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = ranked.select(F.explode(twice).alias("block"), "rank", "pass", "label", "dim", "node", "embedding")
    rows = rows.repartition(shards(ranked.sparkSession), "block").sortWithinPartitions("block", "rank")

    def compare(t: pa.Table) -> np.ndarray:
        block = t["block"][0].as_py()
        ranks, nodes, dims = (t[c].to_numpy() for c in ("rank", "node", "dim"))
        passes, labels = t["pass"].to_numpy(), t["label"].to_numpy()
        own = ranks // BLOCK == block
        found = []
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = _matrix(t["embedding"].combine_chunks().take(pa.array(at)))
            for d in range(1, min(window, len(at) - 1) + 1):
                i, j = at[:-d], at[d:]
                near = own[i] & (passes[i] == passes[j]) & (labels[i] == labels[j]) & (ranks[j] - ranks[i] <= window)
                near &= np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold
                found.append(np.stack([nodes[i[near]], nodes[j[near]]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, [0]):
            pairs = compare(t)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def count_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, linked) for rows (node, root, copies, embedding): how many vectors of the other classes of the component link.

    A component's members fall into blocks of about BLOCK; each pair of blocks is one piece of work.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    dealt = members.join(sizes, "root").withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = dealt.select(
        "root", "node", "copies", "embedding", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"),
    ).select(
        "root", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "node", "copies", "embedding")
    rows = rows.repartition(shards(members.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "_own", "node")

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        own, nodes, copies = (t[c].to_numpy() for c in ("_own", "node", "copies"))
        x = _matrix(t["embedding"].combine_chunks())
        if i == j:
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            return nodes, near @ copies
        first = own == i
        near = x[first] @ x[~first].T >= threshold
        return np.concatenate([nodes[first], nodes[~first]]), np.concatenate([near @ copies[~first], near.T @ copies[first]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, [0, 1, 2]):
            nodes, linked = compare(t)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(linked.astype(np.int64))], ["node", "linked"])

    return rows.mapInArrow(run, "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, seed: int = 0,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label)."""
    rows = vectors.select(
        "vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("string").alias("label"), usable().alias("_ok"))
    valid = rows.where("_ok")
    classes = valid.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = settled(classes.withColumn("node", F.monotonically_increasing_id()), "embeddings")
    if passes is None:
        largest = classes.groupBy("label", F.size("embedding")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        passes = passes_for(largest or 1, threshold, window)
    rounds = []
    for first in range(0, passes, PASSES):
        ranked = _ranked(_hashed(classes, min(PASSES, passes - first), seed, first))
        rounds.append(settled(window_links(ranked, threshold, window), "embeddings"))
        discard(ranked)
    roots = settled(components(reduce(DataFrame.unionByName, rounds)), "embeddings")
    members = classes.join(roots, "node")
    linked = count_links(members.select("node", "root", "copies", "embedding"), threshold)
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = settled(roots.join(linked, "node").join(least, "root").select("node", "linked", "component_id"), "embeddings")
    known = classes.join(per_node, "node", "left").select(
        "label", "embedding",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"))
    judged = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT _ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
