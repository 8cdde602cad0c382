"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint's 64 bits form a ring of m segments. If two fingerprints differ in at most t bits,
some chain of consecutive segments stays within its share all the way: the first segment differs
in at most t/m bits, the first two in at most 2t/m, and so on round the ring. With t < m the
first segment of such a chain is equal and the second differs in at most floor(2t/m) bits, so
cutting the second into one part more than that leaves at least that many parts less one equal.
First segment and all parts but the differing ones are the key under which fingerprints meet.
Pairs that meet are pruned by the rest of the chain before the full difference is taken, and a
pair is reported under its first good chain only.

Equal fingerprints are one node, so copies never pair up. Components come from `components`.

Cases: a null or blank text has fingerprint 0 and links like any other; fewer words than a
shingle count as one shingle; rows that repeat an id or a text each keep their row; a null id is
never the smallest unless no other is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import settled, slices
from gantry.llm.components import components

BITS = 64
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits, unsigned: bit i is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    digest, last = xxhash.xxh64_intdigest, ends[min(shingle, len(words)) - 1:]
    for at in range(0, n, CHUNK):
        spans = zip(starts[at:min(at + CHUNK, n)].tolist(), last[at:at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry` and the fingerprint, as a signed long, of every row."""
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            texts = batch.column(n)
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], signed], [*carry, "fingerprint"])

    rows = docs.select(*carry, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").withColumn("fingerprint", F.lit(0).cast("bigint")).schema)


def _segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(low: int, width: int) -> int:
    value = ((1 << width) - 1) << low
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _keys(fp: Column, m: int, t: int, parts: int) -> Column:
    """Array of (chain, key): the bits that must be equal, the others cleared."""
    segments, found = _segments(m), []
    for i in range(m):
        allowed = 2 * t // m
        low, width = segments[(i + 1) % m]
        cuts = [low + width * p // parts for p in range(parts + 1)]
        for k, out in enumerate(combinations(range(parts), allowed)):
            mask = _mask(*segments[i])
            for p in set(range(parts)) - set(out):
                mask |= _mask(cuts[p], cuts[p + 1] - cuts[p])
            found.append(F.struct(F.lit(i * 1000 + k).alias("chain"), fp.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*found)


def links(prints: DataFrame, t: int = 4, m: int = 5, parts: int = 4) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in 1 to `t` bits; `prints` has each once.

    `parts` sets the width of the key (more are more selective and more rows). A pair may come
    more than once. Exact for any t < m.
    """
    if not 0 <= t < m:
        raise ValueError("the first segment of a chain is only equal if t < m")
    allowed = 2 * t // m
    if parts <= allowed:
        raise ValueError("the second segment needs more parts than bits it may differ in")
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), m, t, parts)).alias("_k")).select(
        "fp", F.col("_k.chain").alias("chain"), F.col("_k.key").alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    per_segment = [F.bit_count(diff.bitwiseAND(F.lit(_mask(*s)))) for s in _segments(m)]

    def chain_holds(i: int) -> Column:
        total, holds = per_segment[i], per_segment[i] <= t // m
        for length in range(2, m + 1):
            total = total + per_segment[(i + length - 1) % m]
            holds = holds & (total <= length * t // m)
        return holds

    first = F.lit(None).cast("int")
    for i in reversed(range(m)):
        first = F.when(chain_holds(i), F.lit(i)).otherwise(first)
    met = (F.col("a.chain") == F.col("b.chain")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    # The chain's last prefix is the whole ring, so it holds the full difference as well.
    ring = F.floor(F.col("a.chain") / 1000) == first
    return a.join(b, met & ring).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def rooted(prints: DataFrame, t: int = 4) -> DataFrame:
    """(fp, least, root) of each fingerprint: its least id, and the least fingerprint in reach."""
    classes = settled(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash")
    roots = components(links(classes.select("fp"), t))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(prints: DataFrame, t: int = 4) -> DataFrame:
    """(fingerprint, component_id) for rows (doc_id, fingerprint): the least id in reach, itself included."""
    found = rooted(prints, t)
    # A table of its own, so that Spark can split the rows of a large component in the join.
    least = settled(found.groupBy("root").agg(F.min("least").alias("component_id")), "simhash")
    return found.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, t: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`; only doc_id and text are read."""
    prints = settled(with_fingerprints(docs, shingle), "simhash")
    return prints.join(settled(groups(prints, t), "simhash"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, t: int = 4, shingle: int = 4) -> DataFrame:
    """`docs` with one row of each group: the least doc_id's, and of rows that repeat it the first by a hash of the text.

    Rows are told apart by hashes of id and text, so equal rows are one. The choice is a narrow
    table; the texts are read again and meet it in a join.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")
    keyed = keyed.withColumn("_a", F.xxhash64("doc_id", "text")).withColumn("_b", F.hash("text", "doc_id"))
    prints = settled(with_fingerprints(keyed, shingle, ("doc_id", "_a", "_b")), "simhash")
    roots = rooted(prints, t).select(F.col("fp").alias("fingerprint"), "root")
    grouped = prints.join(settled(roots, "simhash"), "fingerprint")
    # Null ids come last. Unrelated components may have the same least id.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b")
    first = grouped.groupBy("root").agg(F.min(order).alias("_m"))
    kept = settled(first.select("_m._a", "_m._b").distinct(), "simhash")
    return keyed.select("_doc", "_a", "_b").join(kept, ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select("_doc.*")


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
