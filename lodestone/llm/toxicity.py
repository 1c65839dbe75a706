"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, the words cut to their first 4 and 5 bytes, its word pairs and its
pairs with one word between, hashed to 2**bits coordinates. Every coordinate has its own rate and an L1 threshold, so
few weights are not zero; those are broadcast as two arrays of at most 2**bits entries.

Training takes at most `max_train` labelled rows, the ones of least hash, a documented bound on the sample; they are
dealt into shards. In each epoch every shard goes on from the common state and the coordinates' states are averaged.
The bias is one more coordinate, without L1. Scores cover every row and whole texts.

Defined cases: null and empty texts have the bias alone; null labels or ids are not learned from; several labels of a
document are all examples; without any example every score is 0; an empty table gives no rows. Columns other than
those named are not read, and only text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, map_batches, materialize, text_slices

_RESULT = "doc_id long, score double"
_STATE = "coordinate int, z float, n float"
#: Rows that one FTRL update takes together.
MINI_BATCH = 16
#: A shard has so many examples at least.
SHARD_ROWS = 5000


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0
    epochs: int = 3
    shards: int = 6

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The proximal step: zero inside the L1 threshold. The last entry is the bias."""
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0.0
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1 * (1 + 0.5 * np.sqrt(n)), 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def features(texts: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct coordinates of each text, offset of each text and the total); only those that wanted marks, if given."""
    words = textvec.find_words(texts, textvec.ALNUM, lower=True)
    n, docs = len(words), words.texts()
    h = words.hashes()
    found, owner = [h], [docs]
    lens = words.ends - words.starts
    for k in (4, 5):
        cut = lens > k
        found.append(textvec.hash_spans(words.data, words.starts[cut], words.starts[cut] + k, seed=k))
        owner.append(docs[cut])
    for step in (1, 2):
        if n > step:
            same = docs[step:] == docs[:-step]
            found.append(textvec.mix(h[:-step] * np.uint64(2 * step + 1) + h[step:] * np.uint64(0x9E3779B97F4A7C15))[same])
            owner.append(docs[step:][same])
    parts = []
    for h, doc in zip(found, owner, strict=True):
        at = (h >> np.uint64(64 - bits)).astype(np.int64)
        if wanted is not None:
            use = np.flatnonzero(wanted[at])
            at, doc = at[use], doc[use]
        parts.append(doc.astype(np.int64) << bits | at)
    place = np.unique(np.concatenate(parts))
    return place & ((1 << bits) - 1), np.searchsorted(place, np.arange(len(texts) + 1) << bits)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl_pass(model: Ftrl, z: np.ndarray, n: np.ndarray, at: np.ndarray, off: np.ndarray, labels: np.ndarray) -> None:
    """One pass over examples, z and n changed in place."""
    bias = len(z) - 1
    for i in range(0, len(labels), MINI_BATCH):
        own = off[i : i + MINI_BATCH + 1]
        flat, y = at[own[0] : own[-1]], labels[i : i + MINI_BATCH]
        coordinate, back = np.unique(flat, return_inverse=True)
        coordinate = np.append(coordinate, bias)
        w = model.weights(np.append(z[coordinate], 0.0)[:-1], n[coordinate])
        error = sigmoid(_sums(w[back], own - own[0]) + w[-1]) - y
        g = np.append(np.bincount(back, np.repeat(error, np.diff(own)), len(coordinate) - 1), error.sum())
        g2 = np.append(np.bincount(back, np.repeat(error**2, np.diff(own)), len(coordinate) - 1), (error**2).sum())
        sigma = (np.sqrt(n[coordinate] + g2) - np.sqrt(n[coordinate])) / model.alpha
        z[coordinate] += g - sigma * w
        n[coordinate] += g2


def fit(examples: DataFrame, model: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero, the bias as coordinate 2**bits; examples: text, label."""
    spark, size = examples.sparkSession, (1 << model.bits) + 1
    schema = arrow_schema(_STATE)
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(model.epochs):
        state = spark.sparkContext.broadcast((np.flatnonzero(n), z[n > 0], n[n > 0]))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own_z, own_n = np.zeros(size), np.zeros(size)
            own_z[state.value[0]], own_n[state.value[0]] = state.value[1], state.value[2]
            met = np.zeros(size, bool)
            for batch in text_slices(batches):
                labels = batch.column("label").to_numpy().astype(np.float64)
                at, off = features(batch.column("text"), model.bits)
                ftrl_pass(model, own_z, own_n, at, off, labels)
                met[at] = met[-1] = True
            used = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((used.astype(np.int32), own_z[used].astype(np.float32), own_n[used].astype(np.float32)), schema, strict=True)], schema=schema)

        # A shard that hasn't met a coordinate leaves its state to those that have.
        mean = map_batches(examples, run, _STATE).groupBy("coordinate").agg(F.avg("z").alias("z"), F.avg("n").alias("n"))
        rows = mean.toArrow()  # at most 2**bits + 1 rows
        at = rows["coordinate"].to_numpy()
        z[at], n[at] = rows["z"].to_numpy(), rows["n"].to_numpy()
        state.unpersist()
    w = model.weights(z, n)
    if not n.any():
        w[-1] = -40.0
    used = np.flatnonzero(w)
    return used, w[used]


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    schema = arrow_schema(_RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1)
        w[shared.value[0]] = shared.value[1]
        used = w[:-1] != 0
        for batch in text_slices(batches):
            at, off = features(batch.column("text"), bits, used)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(_sums(w[at], off) + w[-1]))], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, run, _RESULT)


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, model: Ftrl = Ftrl(), threshold: float = 0.3, max_train: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs; labels of held-out rows are not learned from."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out)
    order = F.xxhash64("doc_id")
    total = known.count()
    if total > max_train:  # ids of hash up to the wanted share, whatever their order in the table
        known = known.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * max_train / total))
    shards = max(1, min(model.shards, total // SHARD_ROWS))
    examples = materialize(source.join(known, "doc_id").select("text", "label", order.alias("k")).repartition(shards, "k").sortWithinPartitions("k", "label"), "toxicity-examples").coalesce(shards)
    weights = fit(examples.select("text", "label"), model)
    return score(source, weights, model.bits).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
