"""Substring de-duplication with an FM-index for each shard.

A word goes when a window of WINDOW words that covers it also starts in a document with a
smaller doc_id. Only windows that can occur twice need looking at, and equal windows have to
meet, so a window is filed under its anchor, the least hash among its runs of Q words: equal
windows have equal anchors, and neighbouring windows mostly share one. A segment is a run of
windows with one anchor.

1. Anchors of all documents are counted. Within a task an anchor is sent on once, whatever the
   number of its documents there, so an anchor that a third of all documents have is a row a
   task. Documents whose anchors all stand alone are done.
2. The other documents give the segments of their shared anchors. Equal segments become one with
   its least doc_id, which is a map-side minimum.
3. Distinct segments are dealt to shards by anchor, and each shard gets an FM-index of its own.
   All its segments are streamed through by backward search; the matching statistics tell the
   windows that reach the threshold, and the suffixes in their range tell the least document.
4. Each segment goes back to its places, where windows with a smaller document become intervals,
   and the documents that have any lose those words.

An anchor of more than HOT documents, such as a line that everyone has, may stand in as many
different segments. Its windows are filed one by one, each under its own hash, so that a shard
holds about SHARD_WORDS words whatever the text.

Words are compared by hashes: 64 bits for anchors, 48 of them for the words of a segment. Cases: null, blank and short texts (fewer words than a
window) lose nothing; a null doc_id is larger than any other and equal to itself; rows with one
doc_id do not take words from each other, nor do windows that repeat within a document; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import discard, settled, shards, slices
from gantry.llm.fm_index import FMIndex

WINDOW = 13
Q = 4
HOT = 20_000
SHARD_WORDS = 400_000
NO_ID = (1 << 63) - 1


_TABLES = np.random.default_rng(20).integers(0, 1 << 64, 256 + 4096, np.uint64) | np.uint64(1)
_OF_BYTE, _OF_PLACE = _TABLES[:256], _TABLES[256:]
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes of a word's hash that a segment's content has.
CODE = 6


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each text begins and the last one ends; null is empty."""
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_hashes(texts: pa.Array, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in a row, and the number of words of each text.

    A hash is the sum over a word's bytes of a number for the byte times a number for its place,
    both random and fixed. It is taken for about `most_bytes` at a time.
    """
    data, offsets = _buffers(texts)
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        part = data[offsets[at]:offsets[to]]
        inside = ~_IS_SPACE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[at:to] - offsets[at]
        edges = edges[edges < len(part)]
        begins[edges] = inside[edges]  # a text's first word does not continue the last one of the text before
        starts = np.flatnonzero(begins)
        if len(starts):
            spans = np.diff(np.append(starts, len(part)))
            place = np.arange(starts[0], len(part)) - np.repeat(starts, spans)
            value = _OF_BYTE[part[starts[0]:]] * _OF_PLACE[place & 4095]
            value[~inside[starts[0]:]] = 0
            letters = np.add.reduceat(inside[starts[0]:].astype(np.int64), starts - starts[0]).astype(np.uint64)
            hashes.append(_mixed(np.add.reduceat(value, starts - starts[0]) + letters * np.uint64(_FACTOR)))
            sizes[at:to] = np.diff(np.searchsorted(starts, offsets[at:to + 1] - offsets[at]))
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), sizes


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(_FACTOR, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, f, np.uint64))) for f in (_FACTOR, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def run_digests(h: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each run of word hashes, from sums of hashes times powers."""
    up, down = _POWERS.of(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)])))
    return _mixed((sums[first + lengths] - sums[first]) * down[first] + lengths.astype(np.uint64) * np.uint64(_FACTOR))


def contents(h: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The lower CODE bytes of the hashes of each run, as binary values."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)
    data = np.ascontiguousarray(h[at].view(np.uint8).reshape(-1, 8)[:, :CODE])
    offsets = np.concatenate(([0], ends * CODE)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def symbols_of(data: bytes) -> np.ndarray:
    """The numbers that `contents` has put into bytes."""
    wide = np.zeros((len(data) // CODE, 8), np.uint8)
    wide[:, :CODE] = np.frombuffer(data, np.uint8).reshape(-1, CODE)
    return wide.reshape(-1).view(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _run_hashes(h: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q numbers."""
    n, total = len(h) - q + 1, np.uint64(0)
    factor, base = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(q):
            total += h[j:n + j] * factor
            factor = factor * base
        return _mixed(total)


def segments(h: np.ndarray, sizes: np.ndarray, window: int = WINDOW, q: int = Q) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor) of each run of windows with one anchor.

    `h` has the word hashes of all texts in a row, `sizes` their numbers of words; first words
    are places in `h`.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if len(h) < window:
        return none
    least = _run_hashes(h, q)
    span, have = window - q + 1, 1
    while have < span:  # the minimum of the next `have` hashes, doubled until it is that of a window
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    owner = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(owner[:len(least)] == owner[window - 1:])
    if not len(valid):
        return none
    anchor, text = least[valid], owner[valid]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    return text[at], valid[at], np.diff(np.append(at, len(valid))), anchor[at]


def _words(batch: pa.RecordBatch, column: int) -> list[list[bytes]]:
    return [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in batch.column(column)]


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc, text): a hash of each row, its doc_id with null as the largest, and its text as bytes.

    Row and doc together are the key of a row. It comes from the contents, so that each pass over
    the input finds the same keys however the input is split; equal rows have one key and one result.
    """
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    return docs.select(F.xxhash64(doc, "text").alias("row"), doc.alias("doc"), F.col("text").cast("binary").alias("text"))


def summaries(rows: DataFrame) -> DataFrame:
    """(row, doc, n_words, words_sha256) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words = _words(batch, 2)
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(digests)],
                ["row", "doc", "n_words", "words_sha256"])

    return rows.mapInArrow(run, "row bigint, doc bigint, n_words bigint, words_sha256 string")


def anchors(rows: DataFrame, window: int = WINDOW, q: int = Q) -> DataFrame:
    """(row, anchor, n_docs) of each document's anchors, met once by a task.

    n_docs counts the documents that have the anchor in one batch of a task: on one row for them,
    the others having null, which says that the anchor is known to be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 16 << 20):
            text, _, _, anchor = segments(*word_hashes(batch.column(2)), window, q)
            if not len(text):
                continue
            order = np.lexsort((text, anchor))
            text, anchor = text[order], anchor[order]
            new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            new_pair = new_anchor | np.concatenate(([True], text[1:] != text[:-1]))
            text, anchor, first = text[new_pair], anchor[new_pair], new_anchor[new_pair]
            counts = np.diff(np.append(np.flatnonzero(first), len(first)))
            n_docs = np.zeros(len(first), np.int64)
            n_docs[first] = counts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(anchor.view(np.int64)), pa.array(n_docs.astype(np.int32), mask=~first)],
                ["row", "anchor", "n_docs"])

    return rows.mapInArrow(run, "row bigint, anchor bigint, n_docs int")


def shared_anchors(found: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, anchors, hot) of the documents that share any: the anchors, and those of more than `hot` documents; a table."""
    # Rows that are known to be shared are only carried along, spread by their document.
    known = F.col("n_docs").isNull()
    key = F.when(known, F.xxhash64("row", "anchor")).otherwise(F.col("anchor"))
    dealt = found.select("row", "n_docs", key.alias("key"), F.when(known, F.col("anchor")).alias("known"))
    docs = F.sum("n_docs").over(W.partitionBy("key"))
    flagged = dealt.withColumn("docs", docs).where("known IS NOT NULL OR docs > 1")
    flagged = settled(flagged.select("row", F.coalesce("known", "key").alias("anchor"), "docs"), "substrings")
    heavy = settled(flagged.where(F.col("docs") > hot).select("anchor").distinct(), "substrings")
    marked = flagged.join(heavy.withColumn("_hot", F.lit(True)), "anchor", "left")
    shared = settled(marked.groupBy("row").agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("_hot"), F.col("anchor"))).alias("hot")), "substrings")
    discard(flagged, heavy)
    return shared


def places(texts: DataFrame, window: int = WINDOW, q: int = Q) -> DataFrame:
    """(row, doc, start, windows, shard, digest, content) of the segments of shared anchors.

    `texts` has (row, doc, text, anchors, hot). `content`, CODE bytes of the hash of each word,
    comes with the first place of a segment in a task and is empty elsewhere. Windows of a hot
    anchor are segments of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        names = ["row", "doc", "start", "windows", "shard", "digest", "content"]
        for batch in slices(batches, 2):
            h, sizes = word_hashes(batch.column(2))
            text, first, windows, anchor = segments(h, sizes, window, q)
            if not len(text):
                continue
            signed = anchor.view(np.int64)
            wanted, is_hot = (_listed(signed, text, batch.column(c)) for c in (3, 4))
            # A hot run of windows becomes as many runs of one.
            times = np.where(wanted, np.where(is_hot, windows, 1), 0)
            at = np.repeat(np.arange(len(text)), times)
            shift = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            first, spread = first[at] + shift, is_hot[at]
            windows, text = np.where(spread, 1, windows[at]), text[at]
            lengths = windows + window - 1
            digest = run_digests(h, first, lengths)
            _, once = np.unique(digest, return_index=True)
            new = np.array([i for i, d in zip(once.tolist(), digest[once].tolist()) if d not in sent], np.int64)
            sent.update(digest[new].tolist())
            shown = np.zeros(len(text), np.int64)
            shown[new] = lengths[new]
            starts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)),
                 pa.array((first - starts[text]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                 pa.array(np.where(spread, digest.view(np.int64), signed[at])), pa.array(digest.view(np.int64)),
                 contents(h, first, shown)], names)

    return texts.select("row", "doc", "text", "anchors", "hot").mapInArrow(
        run, "row bigint, doc bigint, start int, windows int, shard bigint, digest bigint, content binary")


def _listed(anchor: np.ndarray, text: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each segment's anchor is in the list of its text; segments come by text."""
    found = np.zeros(len(anchor), bool)
    begins = np.searchsorted(text, np.arange(len(lists) + 1)).tolist()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    for i, (a, b) in enumerate(zip(begins, begins[1:])):
        own = values[offsets[i]:offsets[i + 1]]
        if a < b and len(own):
            found[a:b] = np.isin(anchor[a:b], own)
    return found


def least_documents(h: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each of the sequences the least document of each of its windows, by an FM-index of all.

    Matching statistics are asked for ranges of two suffixes or more: what stands alone stops
    early, and its least document is its own.
    """
    index = FMIndex(h, lengths)
    windows = index.lengths - window + 1
    owner = np.repeat(np.arange(len(lengths)), windows)
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = index.starts[owner] + nth + window - 1
    matched, lo, hi = index.matching(index.text, ends, window, least_range=2)
    least = docs[owner].copy()
    long = np.flatnonzero(matched >= window)
    if len(long):
        # Ranges of one length are equal or apart, so each is reduced once.
        lows, which = np.unique(lo[long], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = hi[long]
        sizes = highs - lows
        inside = np.repeat(lows - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        mins = np.minimum.reduceat(docs[index.owners(inside)], np.cumsum(sizes) - sizes)
        least[long] = mins[which]
    return np.split(least, np.cumsum(windows)[:-1])


def search(found: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, digest, least): for each distinct segment the least document of each window; a table."""
    distinct = found.groupBy("shard", "digest").agg(F.min("doc").alias("doc"), F.max("content").alias("content"))
    distinct = settled(distinct, "substrings")
    words = distinct.agg(F.sum(F.octet_length("content") / CODE)).first()[0] or 0
    parts = max(shards(found.sparkSession), int(words // shard_words) + 1)
    dealt = distinct.withColumn("_part", F.pmod(F.xxhash64("shard"), F.lit(parts)))
    dealt = dealt.repartition(shards(found.sparkSession), "_part").sortWithinPartitions("_part")

    def of_part(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        data = t["content"].to_pylist()
        lengths = np.array([len(c) // CODE for c in data], np.int64)
        least = least_documents(symbols_of(b"".join(data)), lengths, t["doc"].to_numpy(), window)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in least]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(least)))
        columns = [t["shard"].combine_chunks(), t["digest"].combine_chunks(), lists]
        return pa.RecordBatch.from_arrays(columns, ["shard", "digest", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            parts = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if held and parts[a] != current:
                    yield of_part(held)
                    held = []
                if b > a:
                    current = parts[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield of_part(held)

    rows = dealt.select("shard", "digest", "doc", "content", "_part")
    searched = settled(rows.mapInArrow(run, "shard bigint, digest bigint, least array<bigint>"), "substrings")
    discard(distinct)
    return searched


def intervals(found: DataFrame, searched: DataFrame) -> DataFrame:
    """(row, doc, starts): the first words of each row's windows that start in a smaller document."""
    joined = found.select("row", "doc", "start", "shard", "digest").join(searched, ["shard", "digest"])
    taken = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = joined.select("row", "doc", taken.alias("_s")).where(F.size("_s") > 0)
    return hits.groupBy("row", "doc").agg(F.flatten(F.collect_list("_s")).alias("starts"))


def cover(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words a window beginning at one of `starts` covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:n]) > 0


def without(texts: DataFrame, taken: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(row, doc, n_removed, kept_sha256[, kept]) of the rows of `texts` that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            removed, kept = [], []
            for words, starts in zip(_words(batch, 2), batch.column(3)):
                gone = cover(len(words), np.unique(starts.values.to_numpy()), window)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests)]
            names = ["row", "doc", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array([k.decode() for k in kept])], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = texts.select("row", "doc", "text").join(taken, ["row", "doc"]).select("row", "doc", "text", "starts")
    return joined.mapInArrow(run, "row bigint, doc bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text)


def remove_repeats(docs: DataFrame, window: int = WINDOW, q: int = Q, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of `docs`."""
    rows = numbered(docs)
    whole = settled(summaries(rows), "substrings")
    shared = shared_anchors(anchors(rows, window, q), hot)
    texts = settled(rows.join(shared, "row"), "substrings")
    discard(shared)
    found = settled(places(texts, window, q), "substrings")
    searched = search(found, window)
    taken = settled(intervals(found, searched), "substrings")
    discard(found, searched)
    changed = settled(without(texts, taken, window).dropDuplicates(["row", "doc"]), "substrings")
    discard(texts, taken)
    return whole.join(changed, ["row", "doc"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"))
