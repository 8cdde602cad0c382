"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has room for tokens, for documents and for attention cost (the sum of the squares of
its pieces' lengths). Pieces are placed in order of decreasing length. Each goes to the open
sequence that has room for it in every dimension and scores best, by the norm of the room left
over ("residual") or by the dot product of the piece and the room ("dot"), dimensions being
scaled by their capacity and weighted; if none has room, it opens a new one.

Pieces are dealt round robin to groups of about `GROUP`, each packed by one task: that bounds a
task's memory and time whatever the input, and wastes at most about one sequence in a group.

Cases: a null or empty text is its end id alone, one piece of one token; documents longer than a
sequence are cut into full pieces, the first one taking the rest; rows that repeat an id are
packed each for itself; ids may be null; an empty table gives no sequences. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import settled, slices
from gantry.llm.tokens import SLICE, crc32, encoder, vocabulary_path

TOKENS = 2048
GROUP = 16384
#: Weights of tokens, documents and attention cost: tokens decide, the others settle ties.
WEIGHTS = (1.0, 1e-3, 1e-3)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: full ones but for the first."""
    first = n % most or most
    return [(0, first)] + [(at, most) for at in range(first, n, most)] if n else []


def pieces(docs: DataFrame, tokens: int = TOKENS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of `docs`, `ids` as little-endian 32-bit numbers."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in slices(batches, 1, SLICE):
            ids, sizes = encoder(path).encode([t.as_py() or "" for t in batch.column(1)])
            rows, at = [], 0
            for i, n in enumerate(sizes.tolist()):
                for k, (start, length) in enumerate(cut(n, tokens)):
                    own = ids[at + start:at + start + length]
                    rows.append((i, k, start, length, crc32(own), own.astype("<u4").tobytes() if with_ids else None))
                at += n
            row, piece, start, length, crc, own = zip(*rows)
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                *(pa.array(c, pa.int64()) for c in (start, length, crc)),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_lengths(
    lengths: np.ndarray, capacity: Sequence[float], weights: Sequence[float] = WEIGHTS, rule: str = "residual",
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces of the given lengths, by vector best-fit in order of decreasing length."""
    if rule not in ("residual", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    capacity, scale = np.asarray(capacity, float), np.asarray(weights, float)
    need = np.stack([lengths, np.ones_like(lengths), lengths.astype(float) ** 2]).astype(float)
    if lengths.size and (need.max(axis=1) > capacity).any():
        raise ValueError("a piece is larger than an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((3, len(lengths)))
    number = np.empty(len(lengths), np.int64)
    least = need.min(axis=1) if lengths.size else capacity
    n_open = n_bins = 0
    for i in order.tolist():
        item = need[:, i]
        best = -1
        if n_open:
            left = room[:, :n_open] - item[:, None]
            fits = (left >= 0).all(axis=0)
            if fits.any():
                if rule == "residual":
                    score = -(scale[:, None] * (left / capacity[:, None]) ** 2).sum(axis=0)
                else:
                    score = (scale * item / capacity**2) @ room[:, :n_open]
                best = int(np.where(fits, score, -np.inf).argmax())
        if best < 0:
            best, n_open = n_open, n_open + 1
            room[:, best], number[best] = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = number[best], capacity[0] - room[0, best]
        room[:, best] -= item
        if (room[:, best] < least).any():  # no piece can come any more
            n_open -= 1
            room[:, best], number[best] = room[:, n_open], number[n_open]
    return bins, offsets


def pack(
    found: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
    weights: Sequence[float] = WEIGHTS, rule: str = "residual", group: int = GROUP,
) -> DataFrame:
    """`found` (rows with a `length`) with sequence_id and offset; `found` is read twice, so it should be a table.

    Without limits of their own, documents and attention cost may reach what a sequence full of
    tokens can have.
    """
    capacity = (tokens, documents or tokens, attention or tokens**2)
    groups = max(1, math.ceil(found.count() / group))
    names = found.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        lengths = np.concatenate([b.column(at).to_numpy() for b in rows])
        bins, offsets = pack_lengths(lengths, capacity, weights, rule)
        bins = bins + (TaskContext.get().partitionId() << 32)
        start = 0
        for b in rows:
            part = slice(start, start + b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(bins[part]), pa.array(offsets[part])], [*names, "sequence_id", "offset"])
            start += b.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.repartition(groups).mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts) of pieces that carry `ids`: each sequence whole, as training reads it.

    A group is one sequence, which its capacity bounds.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("_p")).select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("_p.ids", lambda b: F.hex(b)), "")).alias("ids"),
        F.col("_p.offset").alias("starts"), F.col("_p.doc_id").alias("doc_ids"))


def best_fit(docs: DataFrame, tokens: int = TOKENS, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of `docs`."""
    return pack(settled(pieces(docs, tokens, vocabulary), "packing"), tokens)
