"""Token files with directly addressable codes.

An id is split into chunks of 8, 8 and 16 bits, lowest first. Level 0 has the first chunk of
every id, and a bitmap that says which ids go on; level 1 has the second chunk of those, and so
on. The number of set bits before a place, which tells the place on the next level, comes from a
directory with the count before each block of 512 bits and the bits of one block. So any id is
found by a few small reads, and none is decoded to reach another.

File (all numbers little-endian): segments of up to SEGMENT ids, one after the other; then the
documents' first ids (n + 1 numbers of 64 bits), the documents' ids (64 bits each) and one byte
for each that is 1 for null; then for each segment its place (64 bits); at the end the numbers
of documents, ids and segments (64 bits each) and the 8 bytes MAGIC. A segment is, for each
level: the number of chunks (64 bits), the chunks, and but for the last level the directory
(32 bits for each block) and the bitmap, filled up to whole blocks.

Cases: a null or empty text is its end id alone; null doc_ids come first; rows that repeat an id
are told apart by their text, and equal rows by their place in the input; an empty table gives
no file and no row.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import settled, shards, slices
from gantry.llm.tokens import SLICE, crc32, encoder, vocabulary_path
from gantry.session import scratch_dir

MAGIC = b"DACFILE1"
LEVELS = ((8, "<u1"), (8, "<u1"), (16, "<u2"))
SEGMENT = 1 << 20
BLOCK = 512


def encode_segment(ids: np.ndarray) -> bytes:
    rest, parts = ids.astype(np.uint32), []
    for level, (bits, kind) in enumerate(LEVELS):
        parts += [np.array([len(rest)], "<u8").tobytes(), (rest & ((1 << bits) - 1)).astype(kind).tobytes()]
        if level == len(LEVELS) - 1:
            break
        high = rest >> bits
        goes_on = high > 0
        blocks = -(-len(rest) // BLOCK)
        flags = np.zeros(blocks * BLOCK, bool)
        flags[:len(rest)] = goes_on
        before = np.cumsum(flags.reshape(-1, BLOCK).sum(axis=1)) if blocks else np.zeros(0)
        parts += [np.concatenate(([0], before[:-1])).astype("<u4").tobytes() if blocks else b"",
                  np.packbits(flags, bitorder="little").tobytes()]
        rest = high[goes_on]
    return b"".join(parts)


class Writer:
    """One file, written segment by segment; only a segment and the documents' starts are held."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.places, self.at = out, [], 0, [], 0
        self.starts, self.doc_ids, self.total = [0], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.total += len(ids)
        self.starts.append(self.total)
        while len(ids):
            part, ids = ids[:SEGMENT - self.held], ids[SEGMENT - self.held:]
            self.waiting.append(part)
            self.held += len(part)
            if self.held == SEGMENT:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            data = encode_segment(np.concatenate(self.waiting))
            self.places.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self._flush()
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.doc_ids], "<u1").tobytes())
        self.out.write(np.array([*self.places, len(self.doc_ids), self.total, len(self.places)], "<u8").tobytes())
        self.out.write(MAGIC)
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if self._read(size - 8, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, self.n_segments = self._numbers(size - 32, 3).tolist()
        self.places = self._numbers(size - 32 - 8 * self.n_segments, self.n_segments)
        self.directory = size - 32 - 8 * self.n_segments - self.n_docs * 17 - 8
        self.levels: dict[int, list] = {}

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _numbers(self, at: int, n: int, kind: str = "<u8") -> np.ndarray:
        return np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), kind)

    def starts(self, first: int = 0, n: int | None = None) -> np.ndarray:
        return self._numbers(self.directory + 8 * first, self.n_docs + 1 - first if n is None else n)

    def doc_ids(self, first: int = 0, n: int | None = None) -> list[int | None]:
        n = self.n_docs - first if n is None else n
        ids = self._numbers(self.directory + 8 * (self.n_docs + 1 + first), n, "<i8")
        nulls = self._read(self.directory + 8 * (2 * self.n_docs + 1) + first, n)
        return [None if x else i for i, x in zip(ids.tolist(), nulls)]

    def _layout(self, segment: int) -> list[tuple[int, int, int, int]]:
        """(chunks, their place, the directory's, the bitmap's) of each level."""
        if segment not in self.levels:
            at, found = int(self.places[segment]), []
            for level, (_, kind) in enumerate(LEVELS):
                n = int(self._numbers(at, 1)[0])
                chunks = at + 8
                directory = chunks + n * np.dtype(kind).itemsize
                blocks = -(-n // BLOCK) if level < len(LEVELS) - 1 else 0
                bitmap = directory + 4 * blocks
                found.append((n, chunks, directory, bitmap))
                at = bitmap + blocks * BLOCK // 8
            self.levels = {segment: found}
        return self.levels[segment]

    def token(self, i: int) -> int:
        """The id at place `i`, from one chunk, one count and one block of bits on each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        place, value, shift = i % SEGMENT, 0, 0
        for level, (bits, kind) in enumerate(LEVELS):
            _, chunks, directory, bitmap = self._layout(i // SEGMENT)[level]
            width = np.dtype(kind).itemsize
            value |= int(self._numbers(chunks + place * width, 1, kind)[0]) << shift
            shift += bits
            if level == len(LEVELS) - 1:
                break
            block = np.frombuffer(self._read(bitmap + place // BLOCK * BLOCK // 8, BLOCK // 8), np.uint8)
            flags = np.unpackbits(block, bitorder="little")
            if not flags[place % BLOCK]:
                break
            place = int(self._numbers(directory + place // BLOCK * 4, 1, "<u4")[0]) + int(flags[:place % BLOCK].sum())
        return value

    def segment(self, k: int) -> np.ndarray:
        """All ids of a segment."""
        layout = self._layout(k)
        values, shift, which = None, 0, None
        for level, (bits, kind) in enumerate(LEVELS):
            n, chunks, _, bitmap = layout[level]
            found = self._numbers(chunks, n, kind).astype(np.uint32) << np.uint32(shift)
            if values is None:
                values, which = found, np.arange(n)
            else:
                values[which] |= found
            shift += bits
            if level < len(LEVELS) - 1:
                flags = np.unpackbits(np.frombuffer(self._read(bitmap, -(-n // BLOCK) * BLOCK // 8), np.uint8), bitorder="little")
                which = which[flags[:n].astype(bool)]
        return values

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first place, ids, CRC-32) of every document in order, a segment at a time."""
        held, now = -1, np.zeros(0, np.uint32)
        for first in range(0, self.n_docs, 4096):
            n = min(4096, self.n_docs - first)
            starts = self.starts(first, n + 1).tolist()
            for doc_id, a, b in zip(self.doc_ids(first, n), starts, starts[1:]):
                at, crc = a, 0
                while at < b:
                    if at // SEGMENT != held:
                        held = at // SEGMENT
                        now = self.segment(held)
                    to = min(b, (held + 1) * SEGMENT)
                    crc = crc32(now[at - held * SEGMENT:to - held * SEGMENT], crc)
                    at = to
                yield doc_id, a, b - a, crc


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Spark names it, and the path in it."""
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Files of the documents' ids below `folder`; (part, file, start, n_docs, n_tokens) of each, in order.

    Rows are split by ranges of doc_id, so the files in order have all documents in order. A file
    gets its name when it is whole, and an attempt that is run again writes the same one.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        target = None
        writer = None
        for batch in slices(batches, 1, SLICE):
            if writer is None:
                target, base = store(folder)
                target.create_dir(base, recursive=True)
                name = f"tokens-{context.partitionId():06d}.dac"
                draft = posixpath.join(base, f".{name}-{context.taskAttemptId()}")
                writer = Writer(target.open_output_stream(draft))
            ids, sizes = encoder(path).encode([t.as_py() or "" for t in batch.column(1)])
            ends = np.cumsum(sizes)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                writer.add(doc_id, ids[a:b])
        if writer is not None:
            writer.close()
            target.move(draft, posixpath.join(base, name))
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.doc_ids)]),
                 pa.array([writer.total])], ["part", "file", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    # Numbers beside the text keep the sort from touching it.
    ordered = rows.withColumn("_hash", F.xxhash64("text"))
    keys = ["doc_id", "_hash", "_row"]
    ordered = ordered.repartitionByRange(shards(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    written = ordered.select("doc_id", "text").mapInArrow(run, "part int, file string, n_docs bigint, n_tokens bigint")
    files = settled(written, "tokens")
    # One row for each file.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint")
    return files.select("part", "file", start.alias("start"), "n_docs", "n_tokens")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target, path = store(file)
                rows = []
                with target.open_input_file(path) as source:
                    for doc_id, at, n, crc in Reader(source).documents():
                        rows.append((doc_id, start + at, n, crc))
                        if len(rows) == 20_000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    spread = files.select("file", "start").repartition(shards(files.sparkSession))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the files into the session's shared folder and reads them back."""
    return read(settled(write(docs, scratch_dir(docs.sparkSession, "tokens"), vocabulary), "tokens"))
