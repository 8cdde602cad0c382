"""Quality of documents by logistic regression on hashed n-grams, trained by follow-the-regularised-leader.

Rows are those of `ngrams`, and a constant. The leader's state is two numbers for each hashed
n-gram; its weight follows from them and is zero while the sum of the gradients is small. A row
is scored by a sparse dot product with the weights, which are one array of 2^bits numbers.

Training takes a bounded sample of the labelled rows: each with probability `most_rows` over
their number, drawn by a hash of the id, so that about `most_rows` are taken however many there
are. The sample's rows are hashed by the tasks that read the texts and dealt to learners of about
`learner_rows` rows. In each pass every learner starts from the common state and goes through its
rows one by one; the states of all learners, weighted by their rows, are averaged into the next
common state. A learner holds the state and a batch of rows; what comes to the driver is the
state, which 2^bits bounds. All documents are scored, whole.

Cases: null, empty and blank texts have no n-grams and get the score of the constant; a document
labelled more than once counts as good only if all labels say so; null labels, labels of unknown
documents and of null ids do not count; rows that repeat an id are each trained on and scored; a
table without labels scores 0.5; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import settled, slices, unit_hash
from gantry.llm.ngrams import BITS, sparse_rows

SLICE = 2 << 20
#: Bounds: labelled rows that are trained on, in the mean, and rows of one learner.
MOST_ROWS = 32_768
LEARNER_ROWS = 4_096


@dataclass(frozen=True)
class Settings:
    """Of the learner: step size, its smoothing, both penalties; passes over the sample; width of the hash."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    passes: int = 6
    bits: int = BITS


class Learner:
    """State z, n of 2^bits numbers and, last, of the constant."""

    def __init__(self, settings: Settings, z: np.ndarray | None = None, n: np.ndarray | None = None):
        size = (1 << settings.bits) + 1
        self.settings = settings
        self.z = np.zeros(size) if z is None else z.copy()
        self.n = np.zeros(size) if n is None else n.copy()

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        s, z = self.settings, self.z[at]
        scale = (s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2
        return -np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0) / scale

    def learn(self, numbers: np.ndarray, values: np.ndarray, label: float) -> None:
        at, x = np.append(numbers, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
        before = self.n[at]
        after = before + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / self.settings.alpha * w
        self.n[at] = after


def held_out(folds: int = 4, fold: int = 2) -> Column:
    """Rows that are never trained on: by crc32 of the id as text; a null id is not held out."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(remainder == fold, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, bits: int = BITS, seed: int = 0) -> DataFrame:
    """(draw, label, numbers, values) of about `most_rows` labelled rows that are not held out, written as a table.

    The labels that are drawn are a table of three numbers a row and of that many rows, which is
    broadcast: its size is bounded by `most_rows`, and the texts need no shuffle.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    good = settled(good.groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("label")), "classifier")
    rate = min(1.0, most_rows / max(1, good.count()))
    drawn = good.select("*", unit_hash(seed, "doc_id").alias("draw")).where(F.col("draw") < rate)
    drawn = settled(drawn.coalesce(1), "classifier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            offsets, numbers, values = sparse_rows([t or b"" for t in batch.column(2).to_pylist()], bits)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(a)) for a in (numbers, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["draw", "label", "numbers", "values"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("draw", "label", "text")
    return settled(rows.mapInArrow(run, "draw double, label double, numbers array<int>, values array<float>"), "classifier")


def train(sample: DataFrame, settings: Settings = Settings(), learner_rows: int = LEARNER_ROWS) -> np.ndarray:
    """The weights, the constant's last."""
    spark = sample.sparkSession
    n_rows = sample.count()
    learners = max(1, math.ceil(n_rows / learner_rows))
    shared = Learner(settings)
    # The learner and the place within it follow from the draw and what the row holds, so reruns agree.
    order = F.xxhash64("draw", "label", "numbers", "values")
    dealt = settled(
        sample.withColumn("_at", order).repartition(learners, F.pmod("_at", F.lit(learners))).sortWithinPartitions("_at").drop("_at"),
        "classifier") if learners > 1 else sample.coalesce(1).sortWithinPartitions(order)
    for _ in range(settings.passes if n_rows else 0):
        state = spark.sparkContext.broadcast((shared.z, shared.n))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            learner, rows = Learner(settings, *state.value), 0
            for batch in batches:
                numbers, values = batch.column(2), batch.column(3)
                ends = numbers.offsets.to_numpy()
                flat = numbers.values.to_numpy(zero_copy_only=False), values.values.to_numpy(zero_copy_only=False)
                for label, a, b in zip(batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    learner.learn(flat[0][a:b], flat[1][a:b], label)
                rows += batch.num_rows
            if rows:
                used = np.flatnonzero(learner.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array(learner.z[used] * rows), pa.array(learner.n[used] * rows)], ["at", "z", "n"])

        states = dealt.mapInArrow(run, "at bigint, z double, n double").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        found = states.toArrow()  # at most 2^bits + 1 rows
        shared = Learner(settings)
        at = found["at"].to_numpy()
        shared.z[at], shared.n[at] = found["z"].to_numpy() / n_rows, found["n"].to_numpy() / n_rows
        state.destroy()
    return shared.weights()


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of `docs`: the chance of label 1."""
    bits = (len(weights) - 1).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in slices(batches, 1, SLICE):
            offsets, numbers, values = sparse_rows([t or b"" for t in batch.column(1).to_pylist()], bits)
            sums = np.concatenate(([0.0], np.cumsum(w[numbers] * values)))
            margin = sums[offsets[1:]] - sums[offsets[:-1]] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-margin)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, settings: Settings = Settings(),
    most_rows: int = MOST_ROWS, learner_rows: int = LEARNER_ROWS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    weights = train(training_sample(docs, labels, most_rows, settings.bits), settings, learner_rows)
    return score(docs, weights).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
