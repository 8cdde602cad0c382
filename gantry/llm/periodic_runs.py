"""Stretches of words that repeat with a period, found by Lyndon roots, and texts without them.

A run is a stretch of consecutive words with smallest period q, at least `least_exponent` times q
and `least_length` long, that no neighbouring word extends keeping the period. `lyndon` finds
them; a word that some run contains after that run's first q words is left out of the collapsed
text. A text is judged by the task that reads it, a slice of some megabytes at a time.

Cases: a null, empty or blank text has no words, no runs and an empty collapsed text; a text
without runs is its words joined by single spaces; words are compared as bytes; rows that repeat
an id each get a row; ids may be null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import slices
from gantry.llm.lyndon import find_runs

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
SLICE = 2 << 20

#: Gives, for an id and a number of words, the places whose words a text is read as; None for the text as it is.
Arrangement = Callable[[int | None, int], np.ndarray | None]


class _Numbers(dict):
    """Words by order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """True for the words that some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def judge(ids: list, texts: list[bytes], arrange: Arrangement | None, least_exponent: int, least_length: int) -> Iterator[tuple]:
    """(n_words, runs, collapsed text) of each text."""
    words = [text.split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    numbers = _Numbers()
    symbols = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    if arrange is not None:
        for k, (doc_id, end, n) in enumerate(zip(ids, ends.tolist(), sizes.tolist())):
            places = arrange(doc_id, n)
            if places is not None:
                symbols[end - n:end] = symbols[end - n + places]
                own = words[k]
                words[k] = [own[i] for i in places.tolist()]
    runs = find_runs(symbols, ends, least_exponent, least_length)
    owner = np.searchsorted(ends, [r[0] for r in runs], "right") if runs else np.zeros(0, np.int64)
    cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
    for k, (own, begin) in enumerate(zip(words, (ends - sizes).tolist())):
        found = [(start - begin, length, period) for start, length, period in runs[cuts[k]:cuts[k + 1]]]
        if found:
            kept = np.flatnonzero(~repeated(found, len(own))).tolist()
            yield len(own), found, b" ".join([own[i] for i in kept])
        else:
            yield len(own), found, b" ".join(own)


def _lists(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets = pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32())
    flat = np.array(list(chain.from_iterable(rows)), np.int64).reshape(-1, 3)
    columns = [pa.array(flat[:, i]) for i in range(3)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "length", "period"]))


def detect(
    docs: DataFrame, arrange: Arrangement | None = None, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of `docs`; runs are (start, length, period) in order."""
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            n, runs, collapsed = zip(*judge(batch.column(0).to_pylist(), texts, arrange, least_exponent, least_length))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _lists(list(runs)), pa.array(collapsed, pa.binary())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
