"""URL filter over a sorted array of digests.

A list of rules (host and path prefix, verdict) is kept as 64-bit xxhash keys in ascending order
beside the rules' texts. A worker writes these arrays to files of its own once and maps them
into memory, so that a list costs pages of the file cache and not a heap. For a url every host
suffix is tried with every length of path prefix that the list has: all candidates of a batch
are looked up by one vectorised binary search, and a hit counts only if the stored text is the
same, since digests may collide. The longest rule wins, of equally long ones the one with the
longer host; without a rule the verdict is `default`.

The list travels to the workers by broadcast while its bytes are at most `MOST_BYTES`; a larger
one stays a table and meets the candidates in a join on digest and text (`judge_by_join`).

Cases: null urls and such without "://" have empty host and path and fit only a rule with an
empty host; null or repeated ids pass through row by row; an empty list gives every row the
default; of rules with the same text and different verdicts "block" counts. Other columns are
ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import settled

MOST_BYTES = 64 << 20
CAPITALS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def split(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "#?":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(CAPITALS), slash + path


def candidates(host: str, path: str, lengths: Sequence[int]) -> Iterator[tuple[int, str]]:
    """(length of the host part, text) of every rule that could fit, the best first among equally long ones."""
    suffix = host
    while True:
        for n in lengths:
            if n <= len(path):
                yield len(suffix), suffix + path[:n]
        _, dot, suffix = suffix.partition(".")
        if not dot:
            return


def path_lengths(rules: Sequence[tuple[str, str]]) -> list[int]:
    """Lengths of the rules' paths: what follows the host, which has no slash."""
    return sorted({len(text) - text.find("/") if "/" in text else 0 for text, _ in rules})


class Index:
    """The sorted arrays of a list of (rule, verdict), as bytes."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        verdicts: dict[str, str] = {}
        for text, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            verdicts[text] = "block" if "block" in (verdict, verdicts.get(text)) else "allow"
        self.lengths = path_lengths(list(verdicts.items()))
        texts = sorted(verdicts, key=lambda t: (xxhash.xxh64_intdigest(t), t))
        encoded = [t.encode() for t in texts]
        self.files = {
            "digests": np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).tobytes(),
            "ends": np.cumsum([0] + [len(t) for t in encoded]).astype(np.int64).tobytes(),
            "blocked": np.array([verdicts[t] == "block" for t in texts], np.uint8).tobytes(),
            "texts": b"".join(encoded),
        }

    def size(self) -> int:
        return sum(map(len, self.files.values()))


class Mapped:
    """An index in files of this process, mapped into memory."""

    def __init__(self, index: Index):
        self.lengths = index.lengths
        self.folder = tempfile.TemporaryDirectory(prefix="urls-")
        self.digests = self._map(index, "digests", np.uint64)
        self.ends = self._map(index, "ends", np.int64)
        self.blocked = self._map(index, "blocked", np.uint8)
        self.texts = self._map(index, "texts", np.uint8)

    def _map(self, index: Index, name: str, kind: type) -> np.ndarray:
        if not index.files[name]:
            return np.zeros(0, kind)
        path = os.path.join(self.folder.name, name)
        with open(path, "wb") as out:
            out.write(index.files[name])
        return np.memmap(path, kind, "r")

    def look_up(self, texts: Sequence[str]) -> np.ndarray:
        """The place of each text in the list, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
        at = np.searchsorted(self.digests, keys)
        found = np.full(len(texts), -1, np.int64)
        inside = at < len(self.digests)
        hits = np.flatnonzero(inside)[self.digests[at[inside]] == keys[inside]]
        for i in hits.tolist():
            own, place = texts[i].encode(), int(at[i])
            while place < len(self.digests) and self.digests[place] == keys[i]:
                if self.texts[self.ends[place]:self.ends[place + 1]].tobytes() == own:
                    found[i] = place
                    break
                place += 1
        return found


_MAPPED: dict[str, Mapped] = {}


def _mapped(key: str, index: Index) -> Mapped:
    """The process's own copy; one list at a time."""
    if key not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[key] = Mapped(index)
    return _MAPPED[key]


def _judge_batch(index: Mapped, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
    parts = [split(u) for u in urls]
    owners, tried = [], []
    for i, (host, path) in enumerate(parts):
        for host_length, text in candidates(host, path, index.lengths):
            owners.append((i, len(text), host_length))
            tried.append(text)
    best: dict[int, tuple[int, int, int]] = {}
    found = index.look_up(tried) if tried else np.zeros(0, np.int64)
    for k in np.flatnonzero(found >= 0).tolist():
        i, length, host_length = owners[k]
        best[i] = max(best.get(i, (-1, -1, -1)), (length, host_length, k))
    out = []
    for i, (host, path) in enumerate(parts):
        if i in best:
            k = best[i][2]
            out.append((host, path, tried[k], "block" if index.blocked[found[k]] else "allow"))
        else:
            out.append((host, path, None, default))
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages`; a list above `most_bytes` goes by join."""
    index = Index(rules)
    if index.size() > most_bytes:
        return judge_by_join(pages, rules_table(pages.sparkSession, rules), index.lengths, default)
    shared = pages.sparkSession.sparkContext.broadcast(index)
    key = xxhash.xxh64_hexdigest(b"".join(index.files.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = _mapped(key, shared.value)
        for batch in batches:
            if batch.num_rows:
                columns = zip(*_judge_batch(mapped, batch.column(1).to_pylist(), default))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, lengths: Sequence[int], default: str = "allow") -> DataFrame:
    """`judge` for a list that is a table (rule, verdict) of any size; `lengths` are those of its paths."""
    found = T.ArrayType(T.StructType([T.StructField("host_length", T.IntegerType()), T.StructField("text", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_row", "page_id", "host", "path", "_tried"]
        kind = pa.list_(pa.struct([("host_length", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            parts = [split(u) for u in batch.column(2).to_pylist()]
            tried = [[{"host_length": n, "text": t} for n, t in candidates(h, p, lengths)] for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for h, _ in parts], pa.string()),
                 pa.array([p for _, p in parts], pa.string()), pa.array(tried, kind)], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = settled(
        pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url")
        .mapInArrow(run, f"_row bigint, page_id {kind}, host string, path string, _tried {found.simpleString()}"), "urls")
    tried = rows.select("_row", F.explode("_tried").alias("_t")).select("_row", "_t.host_length", F.col("_t.text").alias("rule"))
    verdicts = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    keyed = verdicts.withColumn("_digest", F.xxhash64("rule"))
    hits = tried.withColumn("_digest", F.xxhash64("rule")).join(keyed, ["_digest", "rule"])
    best = hits.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("_b"))
    return rows.join(best, "_row", "left").select(
        "page_id", "host", "path", F.col("_b.rule").alias("rule"), F.coalesce("_b.verdict", F.lit(default)).alias("verdict"))
