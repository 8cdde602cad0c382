"""Counts of terms for each group of documents, by length-bucketed packing.

A term is a run of ASCII letters and non-ASCII characters, with A-Z lower-cased. Terms of up to
8 bytes are one unsigned 64-bit word, filled up with zeros, those of up to 16 bytes two, so that
words in order are terms in byte order. Words are sorted by radix, sixteen bits at a time, and
equal ones counted as runs. Longer terms lie in buckets of their own, one for each doubling of
the length, as byte strings of one width that are sorted as such.

A task keeps what it has counted, merges it as it grows and sends it on when more than MOST
entries are left, so a frequent term leaves a task a few times and not once for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import slices

#: Entries of one bucket that a task holds before they are merged, and sent on if that leaves more than half.
MOST = 1 << 20
SLICE = 4 << 20

#: The byte that a term has for a byte of the text; 0 divides terms.
FOLD = np.zeros(256, np.uint8)
FOLD[0x61:0x7B] = FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)

NAMES = ["lang", "source", "term", "n", "docs"]


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned columns, the least important first; each pass sorts by sixteen bits."""
    order = np.arange(len(columns[0]))
    for column in columns:
        for shift in range(0, column.dtype.itemsize * 8, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[digit[order].argsort(kind="stable")]
    return order


def _order(columns: tuple[np.ndarray, ...], group: np.ndarray) -> np.ndarray:
    if columns[0].dtype.kind == "S":
        order = columns[0].argsort(kind="stable")
        return order[radix_order([group[order]])]
    return radix_order([*reversed(columns), group])


def _starts(columns: tuple[np.ndarray, ...], group: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def count_runs(columns: tuple[np.ndarray, ...], group: np.ndarray, doc: np.ndarray) -> tuple:
    """(columns, group, n, docs) of each distinct term of a group; rows come in the order of their documents."""
    order = _order(columns, group)
    columns, group, doc = tuple(c[order] for c in columns), group[order], doc[order]
    new = _starts(columns, group)
    first = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]  # the order is stable, so a document's rows stand together
    n = np.diff(np.append(first, len(group)))
    return tuple(c[first] for c in columns), group[first], n, np.add.reduceat(new, first, dtype=np.int64)


def merge_runs(parts: list[tuple]) -> tuple:
    """Entries of several `count_runs` of one bucket as one, with the sums of n and docs."""
    columns = tuple(np.concatenate(c) for c in zip(*(p[0] for p in parts)))
    group, n, docs = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    order = _order(columns, group)
    columns, group = tuple(c[order] for c in columns), group[order]
    first = np.flatnonzero(_starts(columns, group))
    sums = (np.add.reduceat(a[order], first) for a in (n, docs))
    return tuple(c[first] for c in columns), group[first], *sums


def buckets(texts: list[bytes]) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """(width, columns, number of the text) of all terms, by the width of their bucket."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    folded = FOLD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = np.zeros(len(folded) + 1, np.int8)
    inside[1:] = folded != 0
    edges = np.flatnonzero(np.diff(inside))  # the text ends with a divider, so edges come in pairs
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    if not len(starts):
        return
    width = np.maximum(8, 1 << np.ceil(np.log2(lengths)).astype(np.int64))
    widest = int(width.max())
    folded = np.concatenate((folded, np.zeros(max(16, widest), np.uint8)))
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        at, size = starts[own], lengths[own]
        if w <= 16:
            windows = np.ndarray(len(folded) - 7, ">u8", folded, strides=(1,))
            last = windows[at + w - 8].astype(np.uint64)
            spare = (8 * (w - size)).astype(np.uint64)
            last = last >> spare << spare
            columns = (last,) if w == 8 else (windows[at].astype(np.uint64), last)
        else:
            columns = (_wide(folded, at, size, w),)
        yield w, columns, doc[own]


def _wide(folded: np.ndarray, at: np.ndarray, size: np.ndarray, w: int) -> np.ndarray:
    found = np.ndarray(len(folded) - w + 1, f"S{w}", folded, strides=(1,))[at]
    cells = found.view(np.uint8).reshape(len(at), w)
    step = max(1, (1 << 22) // w)
    for a in range(0, len(at), step):
        cells[a:a + step][np.arange(w) >= size[a:a + step, None]] = 0
    return found


def _terms(columns: tuple[np.ndarray, ...]) -> pa.Array:
    if columns[0].dtype.kind != "S":
        words = np.ascontiguousarray(np.stack(columns, axis=1).astype(">u8"))
        columns = (words.view(f"S{8 * len(columns)}").ravel(),)
    return pa.array(columns[0].tolist(), pa.binary())


class Counter:
    """What one task has counted and not yet sent on."""

    def __init__(self, most: int = MOST):
        self.most, self.codes, self.held, self.size = most, {}, {}, {}

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        groups = np.array([self.codes.setdefault(g, len(self.codes)) for g in zip(langs, sources)], np.uint32)
        for w, columns, doc in buckets(texts):
            part = count_runs(columns, groups[doc], doc)
            self.held.setdefault(w, []).append(part)
            self.size[w] = self.size.get(w, 0) + len(part[1])
            if self.size[w] > max(1, self.most * 16 // max(w, 16)):
                yield from self._settle(w, self.most * 8 // max(w, 16))

    def _settle(self, w: int, most: int) -> Iterator[pa.RecordBatch]:
        parts = self.held.pop(w)
        merged = merge_runs(parts) if len(parts) > 1 else parts[0]
        if len(merged[1]) <= most:
            self.held[w], self.size[w] = [merged], len(merged[1])
            return
        self.size[w] = 0
        columns, group, n, docs = merged
        names = [pa.array(list(names)) for names in zip(*self.codes)]
        for a in range(0, len(group), 1 << 16):
            part = slice(a, a + (1 << 16))
            code = pa.array(group[part])
            yield pa.RecordBatch.from_arrays(
                [names[0].take(code), names[1].take(code), _terms(tuple(c[part] for c in columns)), pa.array(n[part]), pa.array(docs[part])], NAMES)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for w in list(self.held):
            yield from self._settle(w, 0)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, a few rows for each term, group and task.

    Null text, lang and source are read as empty; every row is a document of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in slices(batches, 2, SLICE):
            yield from counter.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        yield from counter.rest()

    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
