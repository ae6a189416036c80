"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the byte n-grams of the lower-cased text with white space as one blank, hashed into
2^20 slots. Over the labelled rows, each slot gets the log ratio of its smoothed shares among
positive and negative rows; slots whose ratio is large and surely not zero stay. A logistic
regression then learns one weight for each slot that stayed; a feature's value is the ratio times
log2(1 + how often the text has the n-gram). Scoring is one pass over whole texts without a
shuffle: all documents are hashed by numpy, and only n-grams in kept slots count.

LEAST_RATIO, LEAST_ERRORS, the counts and the penalty were chosen by cross-validation among the
learnt rows of a scale factor of 0.1 (three folds): 285 of 305 toxic rows were found with 8 of 2,331 clean
ones flagged; without counts 241 and 15. The regression goes on until it tells the rows apart or
gets no better.

Defined cases: a null, empty or very short text has no n-grams and scores as the bias says; labels
that are null or missing are not learnt from; without both classes among the labelled rows every
score is the smoothed share of positives; repeated rows are learnt from and scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import as_bytes, extended, flat, fresh, slices

SLOT_BITS = 20
ORDERS = (4, 5, 6)
#: White space becomes a blank, A-Z lower-case.
FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in range(256)], np.uint8)
#: The fit is on at most so many labelled rows, those whose ids have the least hashes; it is the documented bound.
MAX_TRAIN_ROWS = 16_000
#: A model has at most so many slots, those whose log-count ratios are most standard errors from zero.
MAX_FEATURES = 4_000
#: Slots whose log-count ratio is nearer to zero, or within so many standard errors of it, tell the classes apart too little to be learnt.
LEAST_RATIO, LEAST_ERRORS = 0.7, 3.0
#: Every LOOK steps the regression looks at its mean loss: it ends below LEAST_LOSS, or where the loss has not fallen by that share, at the latest after ROUNDS.
LOOK, LEAST_LOSS, LEAST_FALL, ROUNDS = 50, 0.004, 0.002, 3_000
CHUNKS = 64


@dataclass
class Model:
    slots: np.ndarray  # kept slots, ascending
    weights: np.ndarray  # of each, times its log-count ratio
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        doc, slot, times = occurring(column, self.slots)
        z = np.full(n, self.bias)
        z += np.bincount(doc, self.weights[slot] * np.log2(1 + times), minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hashed(data: np.ndarray, order: int) -> np.ndarray:
    """The slot of the n-gram that starts at each byte."""
    code = data[: len(data) - order + 1].astype(np.uint64)
    for k in range(1, order):
        code |= data[k : len(data) - order + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= np.uint64(order)
    code *= np.uint64(0xD6E8FEB86659FD93)
    return (code >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def occurring(column: pa.Array, slots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row and slot that occur, and how often; with slots, only those, by their place in it."""
    data, at = flat(as_bytes(column))
    data = FOLD[data]
    place = None
    if slots is not None:
        place = np.full(1 << SLOT_BITS, -1, np.int32)
        place[slots] = np.arange(len(slots), dtype=np.int32)
    found = []
    for order in ORDERS:
        if len(data) < order:
            continue
        slot = _hashed(data, order)
        if place is not None:
            slot = place[slot]
            where = np.flatnonzero(slot >= 0)
            slot = slot[where]
        else:
            where = np.arange(len(slot))
        row = np.searchsorted(at, where, side="right") - 1
        inside = where + order <= at[row + 1]
        found.append((row[inside].astype(np.int64) << SLOT_BITS) | slot[inside])
    pairs, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1), times


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positive and negative rows of this task have each slot, in chunks of slots."""
    seen = np.zeros((2, 1 << SLOT_BITS), np.int32)
    any_row = False
    for batch in slices(batches, "text", 1 << 18):
        row, slot, _ = occurring(batch.column("text"), None)
        label = np.asarray(batch.column("label").to_pylist(), np.int64)
        for k in (0, 1):
            seen[k] += np.bincount(slot[label[row] == k], minlength=1 << SLOT_BITS).astype(np.int32)
        any_row = True
    if any_row:
        for chunk, (neg, pos) in enumerate(zip(np.split(seen[0], CHUNKS), np.split(seen[1], CHUNKS), strict=True)):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "neg": [neg.tobytes()], "pos": [pos.tobytes()]})


def _summed(key, parts):
    """The counts of one chunk of slots, summed over the tasks."""
    width = (1 << SLOT_BITS) // CHUNKS
    neg, pos, chunk = np.zeros(width, np.int64), np.zeros(width, np.int64), key[0].as_py()
    for a, b in zip(parts.column("neg"), parts.column("pos"), strict=True):
        neg += np.frombuffer(a.as_py(), np.int32)
        pos += np.frombuffer(b.as_py(), np.int32)
    there = np.flatnonzero(neg + pos)
    return pa.table({"slot": pa.array(there + chunk * width, pa.int32()), "neg": neg[there], "pos": pos[there]})


def fit(labelled: DataFrame, *, row_id: str, text: str, label: str, max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_FEATURES, smoothing: float = 1.0, min_support: int = 3, ridge: float = 1e-3, rounds: int = ROUNDS) -> Model:
    """Learns from the labelled rows; see the module for what it does without both classes."""
    rows = labelled.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    # The bound is on ids, which are few and small; texts meet them where they are read.
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(max_rows).distinct()
    sample = rows.join(F.broadcast(chosen.withColumnRenamed("id", "_id")), F.col("id") == F.col("_id"), "left_semi").repartition(12, "id").persist()
    try:
        size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        n_neg, n_pos = size.get(0, 0), size.get(1, 0)
        prior = float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
        if not n_neg or not n_pos:
            return Model(np.zeros(0, np.int32), np.zeros(0), prior)
        sums = sample.select("text", "label").mapInArrow(_counts, "chunk int, neg binary, pos binary").groupBy("chunk").applyInArrow(_summed, "slot int, neg long, pos long")
        ratio = F.log((F.col("pos") + smoothing) / (n_pos + 2 * smoothing)) - F.log((F.col("neg") + smoothing) / (n_neg + 2 * smoothing))
        error = F.sqrt(1 / (F.col("pos") + smoothing) + 1 / (F.col("neg") + smoothing))
        kept = sums.where(F.col("pos") + F.col("neg") >= min_support).withColumn("ratio", ratio).where((F.abs("ratio") > LEAST_RATIO) & (F.abs("ratio") > LEAST_ERRORS * error)).orderBy(F.desc(F.abs("ratio") / error), "slot").limit(max_features)
        features = sorted((r["slot"], r["ratio"]) for r in kept.collect())
        slots, ratios = np.array([s for s, _ in features], np.int32), np.array([r for _, r in features])
        shared = sample.sparkSession.sparkContext.broadcast(slots)

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 18):
                row, slot, times = occurring(batch.column("text"), shared.value)
                label = np.asarray(batch.column("label").to_pylist(), np.int8)
                yield pa.RecordBatch.from_pydict({"labels": [label.tobytes()], "sizes": [np.bincount(row, minlength=batch.num_rows).astype(np.int32).tobytes()], "places": [slot.astype(np.int32).tobytes()], "times": [times.astype(np.int32).tobytes()]})

        # At most max_rows rows, each with at most max_features places.
        parts = sample.select("text", "label").mapInArrow(indexed, "labels binary, sizes binary, places binary, times binary").collect()
    finally:
        sample.unpersist()
    y, sizes, places, times = (np.concatenate([np.frombuffer(p[c], kind) for p in parts]) for c, kind in (("labels", np.int8), ("sizes", np.int32), ("places", np.int32), ("times", np.int32)))
    # In an order of their own, so that the sums do not depend on how rows were dealt.
    cuts = np.cumsum(sizes)[:-1]
    rows = sorted(zip(y.tolist(), (x.tobytes() for x in np.split(places, cuts)), (x.tobytes() for x in np.split(times, cuts)), strict=True))
    weights, bias = _regress([np.frombuffer(x, np.int32) for _, x, _ in rows], [np.log2(1 + np.frombuffer(x, np.int32)) for _, _, x in rows], np.array([k for k, _, _ in rows], float), ratios, prior, ridge, rounds)
    return Model(slots, weights * ratios, bias)


def _regress(rows: list[np.ndarray], times: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, bias: float, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps until it gets no better."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate(rows) if len(doc) else np.zeros(0, np.int32)
    value = ratios[place] * (np.concatenate(times) if len(doc) else np.zeros(0))
    step = 4 / max(1.0, np.bincount(doc, value**2, minlength=len(rows)).mean() * 4)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w, old, b, old_b, last = np.ones(len(ratios)) * 0.05, np.ones(len(ratios)) * 0.05, bias, bias, np.inf
    for k in range(rounds):
        ahead = k / (k + 3)
        v, c = w + ahead * (w - old), b + ahead * (b - old_b)
        z = np.bincount(doc, v[place] * value, minlength=len(rows)) + c
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        old, old_b = w, b
        w = v - step * (np.bincount(place, error[doc] * value, minlength=len(ratios)) + ridge * v)
        b = c - step * error.sum()
        if k % LOOK == LOOK - 1:
            loss = float((balance * np.logaddexp(0, np.where(y == 1, -z, z))).mean())
            if loss < LEAST_LOSS or last - loss < LEAST_FALL * loss:
                break
            last = loss
    return w, float(b)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with the probability that they are toxic, in a column of that name or, if taken, the name behind underscores."""
    name = fresh(docs.columns, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            yield extended(batch, **{name: pa.array(shared.value.scores(batch.column(text)))})

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that are kept from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **named) -> Model:
    """Fits on labelled documents that are not held out. The labels' ids decide which texts are shuffled at all."""
    known = labels.select(F.col(doc_id), F.col(label).alias("label")).where(F.col("label").isNotNull() & ~held_out(doc_id)).orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id, "label").limit(named.get("max_rows", MAX_TRAIN_ROWS))
    return fit(docs.select(doc_id, text).join(F.broadcast(known), doc_id), row_id=doc_id, text=text, label="label", **named)
