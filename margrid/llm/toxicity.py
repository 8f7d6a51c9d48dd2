"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings (so that inflected words share a term), hashed to
``BUCKETS`` places. The score is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so pairs of words count beyond the sum of their weights.
It is fitted on a bounded sample of the labelled rows and scores every text where it lies.

Terms come into the machine by two screens: those whose own label rate is far off, and then those that are far too
frequent in the toxic texts that the machine misses so far. The latter may be neutral alone and toxic only together;
their factors learn that.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import CHUNK_BYTES, giving_back, in_tasks, mix, slices, stored, word_hashes, workers_find_package

BUCKETS = 1 << 22
# Labelled rows that the fit may read at most (smallest hashes of doc_id first): the bound of the fit.
SAMPLE = 16_000
# Bytes of the word beginnings that are terms beside the whole words.
STEMS = (4, 5, 6)
# A bucket needs this many sampled documents, and a screen's rate must be this many deviations off, to get weights; the
# others are noise that a linear or pairwise weight would learn by heart.
LEAST_DOCUMENTS = 3
DEVIATIONS = 4.0
FACTORS = 4
EPOCHS = 12
BATCH = 128
RATE = 0.05
DECAY = 2e-3
FACTOR_RATE = 1.0
SPREAD = 0.05
THRESHOLD = 0.3

# ASCII bytes that part words, so "idiot," is "idiot"; all but digits and letters.
GAPS = np.zeros(256, bool)
GAPS[:0x80] = True
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
# Bytes of text whose terms are held at a time.
SLICE = CHUNK_BYTES


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may read: crc32 of the id as text leaves 2 by 4 (ids that are null are not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets_of(column: pa.Array) -> list[np.ndarray]:
    """Distinct buckets of each text."""
    terms = []
    for most in (None, *STEMS):
        hashes, first = word_hashes(column, most, GAPS)
        terms.append(mix(hashes + np.uint64(most or 0)) & np.uint64(BUCKETS - 1))
    places = np.stack(terms, axis=1).astype(np.int64)
    return [np.unique(places[first[i]:first[i + 1]]) for i in range(len(column))]


class Machine:
    """Weights of the buckets that the fit has seen: ``known`` ascending, the bias, linear weights and factors."""

    def __init__(self, known: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.known, self.bias, self.linear, self.factors = known, bias, linear, factors

    def score(self, buckets: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(buckets), self.bias)
        if len(self.known):
            for i, b in enumerate(buckets):
                at = np.searchsorted(self.known, b)
                at[at == len(self.known)] = 0
                at = at[self.known[at] == b]
                if len(at):
                    v = self.factors[at]
                    total = v.sum(axis=0)
                    out[i] += self.linear[at].sum() + 0.5 * (total @ total - (v * v).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _descend(machine: Machine, rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Adaptive-gradient descent of the log loss in small batches, with decay of the weights."""
    linear, factors, bias = machine.linear, machine.factors, machine.bias
    seen_linear = np.full(len(linear), 1e-6)
    seen_factors = np.full(factors.shape, 1e-6)
    seen_bias = 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = [i for i in order[start:start + BATCH] if len(rows[i])]
            if not some:
                continue
            sizes = np.array([len(rows[i]) for i in some])
            flat = np.concatenate([rows[i] for i in some])
            ends = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = factors[flat]
            total = np.add.reduceat(v, ends, axis=0)
            square = np.add.reduceat((v * v).sum(axis=1), ends)
            raw = bias + np.add.reduceat(linear[flat], ends) + 0.5 * ((total * total).sum(axis=1) - square)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]
            spread = np.repeat(error, sizes)
            touched, back = np.unique(flat, return_inverse=True)
            g_linear = np.bincount(back, spread, len(touched)) / len(some) + DECAY * linear[touched] / len(order)
            pull = spread[:, None] * (np.repeat(total, sizes, axis=0) - v)
            g_factors = np.stack([np.bincount(back, pull[:, f], len(touched)) for f in range(FACTORS)], axis=1)
            g_factors = g_factors / len(some) + DECAY * factors[touched] / len(order)
            seen_linear[touched] += g_linear**2
            seen_factors[touched] += g_factors**2
            linear[touched] -= RATE * 4 * g_linear / np.sqrt(seen_linear[touched])
            factors[touched] -= RATE * FACTOR_RATE * g_factors / np.sqrt(seen_factors[touched])
            g_bias = error.mean()
            seen_bias += g_bias**2
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    machine.bias = float(bias)


def fit(buckets: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine over the terms of the first screen, and if it misses toxic texts over those of both."""
    rng = np.random.default_rng(seed)
    number, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for b, label in zip(buckets, labels, strict=True):
        number[b] += 1
        toxic[b] += int(label)
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 1e-3
    often = np.flatnonzero(number >= LEAST_DOCUMENTS)
    off = np.abs(toxic[often] - rate * number[often]) / np.sqrt(number[often] * rate * (1 - rate))
    wanted = often[off >= DEVIATIONS]
    bias = float(np.log(rate / (1 - rate)))

    def fitted(known: np.ndarray) -> Machine:
        name = np.full(BUCKETS, -1, np.int32)
        name[known] = np.arange(len(known))
        machine = Machine(known, bias, np.zeros(len(known)), rng.normal(0, SPREAD, (len(known), FACTORS)))
        if len(known):
            _descend(machine, [name[b][name[b] >= 0] for b in buckets], labels, rng)
        else:
            machine.factors[:] = 0
        return machine

    if not len(labels) or not 0 < labels.sum() < len(labels):
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    machine = fitted(wanted)
    missed = np.flatnonzero((machine.score(buckets) < 0.5) & (labels > 0))
    held = np.zeros(BUCKETS, np.int32)
    for i in missed:
        held[buckets[i]] += 1
    # among the missed texts a term is expected at its rate in all texts
    often = np.flatnonzero(held >= LEAST_DOCUMENTS)
    share = number[often] / len(labels)
    far = (held[often] - len(missed) * share) / np.sqrt(np.maximum(len(missed) * share * (1 - share), 1e-9))
    more = np.setdiff1d(often[far >= DEVIATIONS], wanted)
    if not len(more):
        return machine
    return fitted(np.union1d(wanted, more))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, most=SLICE):
            packed = [b.astype("<i4").tobytes() for b in buckets_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(packed, pa.binary())],
                names=["doc_id", "toxic", "buckets"],
            )


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["doc_id"], r["toxic"], r["buckets"]) for batch in batches for r in batch.to_pylist()]
    rows.sort()
    model = fit(
        [np.frombuffer(b, "<i4") for _, _, b in rows], np.array([t for _, t, _ in rows], float)
    )
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows that are not held out.

    Rows of the sample are those whose ids hash lowest. A document with several labels is toxic if one says
    so; null labels and labels without a document teach nothing. Without both classes every score is the
    rate of the sample.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample is bounded by its parameter, so every executor may hold it
    rows = rows.join(F.broadcast(stored(chosen)), "doc_id").dropDuplicates(["doc_id", "text"]).select(
        "doc_id", "text", "toxic"
    )
    features = stored(in_tasks(rows, _buckets, "doc_id long, toxic int, buckets binary"))
    state = in_tasks(features.repartition(1), _fit, "model binary").first()["model"]
    return Machine(**pickle.loads(state))


def _scorer(machine: Machine):
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [
                machine.score(buckets_of(some.column("text")))
                for some in slices(pa.record_batch({"text": texts}), most=SLICE)
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return giving_back(scores)(batches)

    return score


def _with_score(docs: DataFrame, machine: Machine, name: str) -> DataFrame:
    """A column more; only the text goes to the Python workers, and only the score comes back."""
    workers_find_package(docs.sparkSession)
    return docs.withColumn(name, _scorer(machine)(F.coalesce(F.col("text"), F.lit(""))))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on).

    Only the text is an input of a score; null and empty texts get the score of no words. Repeated rows are
    scored each; without labels all scores are equal.
    """
    machine = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_score(rows, machine, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score stays below the threshold, all columns kept."""
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = _with_score(docs, train(docs, labels, sample), name)
    return scored.where(F.col(name) < THRESHOLD).select(docs.columns)
