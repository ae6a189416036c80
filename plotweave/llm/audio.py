"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

A recording (16-bit little-endian mono samples) becomes frames of a short-time Fourier transform,
each folded into twelve pitch classes and smoothed. Sixteen rectangle filters over the integral
image of that chroma plane compare sums of areas, and two Gray-coded bits of each give a packed
32-bit integer per frame. Alignment: codes of queries meet equal codes of all recordings, each
meeting votes for an offset, and the offsets with most votes are verified by the share of bits that
differ over the whole overlap.

Codes of near-silence or one held tone repeat frame after frame; such a run of frames counts once, by
its first frame, so a held tone costs a row per recording, not the square of its frames. A code that
comes again later is a run of its own, and every offset that gathers enough votes is verified.

Defined cases: null, empty or too short samples have no codes and align with nothing; an odd last
byte is ignored; equal recordings all align, at offset 0 first; repeated rows are recordings each, under one id; a null id aligns with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import settle

RATE = 5512
FRAME, HOP = 2048, 512
PITCH = 12
#: kind, first pitch class, height, width of the filters; kinds as in `_filtered`.
FILTERS = [(kind, first, height, width) for kind, height, width in ((0, 3, 15), (1, 4, 14), (2, 4, 15), (3, 8, 4)) for first in (0, 2, 4, 3 if height == 8 else 8)]
WIDEST = max(w for *_, w in FILTERS)


@lru_cache(maxsize=4)
def _bins(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform's bins from 60 Hz to 2 kHz, and the pitch class of each."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hertz >= 60) & (hertz <= min(2000, rate / 2 - 1)))
    return use, np.round(PITCH * np.log2(hertz[use] / 440)).astype(int) % PITCH


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One row of twelve shares of energy per frame."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCH))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), FRAME)[::HOP]
    use, pitch = _bins(rate)
    power = np.abs(np.fft.rfft(frames * np.hamming(FRAME), axis=1)[:, use]) ** 2
    fold = np.zeros((len(use), PITCH))
    fold[np.arange(len(use)), pitch] = 1
    plane = power @ fold
    weight = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    padded = np.pad(plane, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + len(plane)] for k, w in enumerate(weight))
    size = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-2, smooth / np.maximum(size, 1e-12), 0.0)


def _filtered(area, kind: int, first: int, height: int, width: int) -> np.ndarray:
    """The log ratio of the sums of two areas for each frame; area(a, b, p, q): frames a to b, pitches p to q."""
    last = min(first + height, PITCH)
    half_w, half_h = width // 2, (last - first) // 2
    if kind == 0:  # level against nothing
        one, two = area(0, width, first, last), 0.0
    elif kind == 1:  # upper pitches against lower ones
        one, two = area(0, width, first, first + half_h), area(0, width, first + half_h, last)
    elif kind == 2:  # earlier against later
        one, two = area(0, half_w, first, last), area(half_w, width, first, last)
    else:  # checkerboard
        one = area(0, half_w, first, first + half_h) + area(half_w, width, first + half_h, last)
        two = area(half_w, width, first, first + half_h) + area(0, half_w, first + half_h, last)
    return np.log((1 + one) / (1 + two))


#: The three cuts of each filter kind between its four levels.
CUTS = {0: (1.2, 1.6, 1.95), 1: (-0.6, 0.0, 0.6), 2: (-0.35, 0.0, 0.35), 3: (-0.15, 0.0, 0.15)}


def codes(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One packed 32-bit integer for each frame that has the widest filter's frames after it."""
    plane = chroma(samples, rate)
    n = len(plane) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(plane) + 1, PITCH + 1))
    image[1:, 1:] = plane.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(a: int, b: int, p: int, q: int) -> np.ndarray:
        return image[at + b, q] - image[at + a, q] - image[at + b, p] + image[at + a, p]

    out = np.zeros(n, np.uint32)
    for kind, first, height, width in FILTERS:
        level = np.searchsorted(CUTS[kind], _filtered(area, kind, first, height, width))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


#: Recordings are large: this many are handled, and handed on, at a time.
AT_ONCE = 32


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def _fingerprinted(media_id: str, samples: str, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some(batches):
            found = [codes(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"), rate).view(np.int32) for raw in (v.as_py() or b"" for v in part.column(samples))]
            yield pa.RecordBatch.from_arrays([part.column(media_id), pa.array(found, pa.list_(pa.int32()))], names=[media_id, "codes"])

    return run


def fingerprint(media: DataFrame, *, media_id: str, samples: str, rate: int = RATE, prepare=None) -> DataFrame:
    """media_id, codes (array of ints); `prepare` may turn batches of other columns into samples first, in the same pass.

    Set spark.sql.execution.arrow.maxRecordsPerBatch so that a batch of recordings fits a worker's memory.
    """
    one = _fingerprinted(media_id, samples, rate)
    kind = media.schema[media_id].dataType.simpleString()
    if prepare is None:
        return media.select(media_id, samples).mapInArrow(one, f"`{media_id}` {kind}, codes array<int>")
    return media.mapInArrow(lambda batches: one(prepare(batches)), f"`{media_id}` {kind}, codes array<int>")


def align(queries: DataFrame, prints: DataFrame, *, media_id: str, least_votes: int = 4, most_error: float = 0.2, least_overlap: int = 8) -> DataFrame:
    """query_id, media_id, offset, votes, overlap, bit_error of every recording that a query aligns with.

    offset is the recording's frame at which the query's first frame lies. All of a pair's offsets
    with `least_votes` or more are verified; the one with the least error is kept.
    """

    def runs(df: DataFrame, name: str) -> DataFrame:
        first = F.filter(F.transform("codes", lambda c, i: F.struct(i.alias("at"), c.alias("code"), F.get("codes", i - 1).alias("before"))), lambda x: x["before"].isNull() | (x["before"] != x["code"]))
        return df.where(F.col(media_id).isNotNull()).select(F.col(media_id).alias(name), F.inline(first)).drop("before")

    met = runs(queries, "query_id").join(runs(prints, "media_id").withColumnRenamed("at", "there"), "code")
    votes = met.groupBy("query_id", "media_id", (F.col("there") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least_votes)
    with_codes = votes.join(queries.select(F.col(media_id).alias("query_id"), F.col("codes").alias("q")), "query_id").join(prints.select(F.col(media_id).alias("media_id"), F.col("codes").alias("m")), "media_id")
    low, high = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("q"), F.size("m") - F.col("offset"))
    lapped = with_codes.withColumn("overlap", high - low).where(F.col("overlap") >= least_overlap)
    q, m = F.slice("q", low + 1, F.col("overlap")), F.slice("m", low + F.col("offset") + 1, F.col("overlap"))
    wrong = F.aggregate(F.zip_with(q, m, lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda n, x: n + x)
    judged = lapped.withColumn("bit_error", wrong / (32.0 * F.col("overlap"))).where(F.col("bit_error") <= most_error)
    first = W.partitionBy("query_id", "media_id").orderBy("bit_error", F.desc("votes"), "offset")
    return judged.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("query_id", "media_id", "offset", "votes", "overlap", "bit_error")


def _cut(media_id: str, samples: str, start: int, length: int, gain: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            cut = [(np.frombuffer(v.as_py() or b"", "<i2")[start : start + length] * gain).astype("<i2").tobytes() for v in batch.column(samples)]
            yield pa.RecordBatch.from_arrays([batch.column(media_id), pa.array(cut, pa.binary())], names=[media_id, samples])

    return run


def excerpts(media: DataFrame, *, media_id: str, samples: str, start: int, length: int, gain: float = 0.6) -> DataFrame:
    """A quieter cut of each recording, from sample start on: what a query against the archive looks like."""
    return media.select(media_id, samples).mapInArrow(_cut(media_id, samples, start, length, gain), f"`{media_id}` {media.schema[media_id].dataType.simpleString()}, `{samples}` binary")


def _played(vec_id: str, vector: str, seconds: float, rate: int):
    n = int(seconds * rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(n) / rate
        for batch in _some(batches):
            tunes = []
            for v in batch.column(vector).to_pylist():
                x = np.array([np.nan if y is None else y for y in (v or [])], float)
                ok = np.isfinite(x)
                pitch = np.where(ok, np.floor(np.abs(np.where(ok, x, 0)) * 997) % 24, 0)
                wave = np.sin(2 * np.pi * 220 * 2 ** (pitch[:, None] / 12) * time) * ok[:, None]
                tunes.append((12000 * wave * np.hanning(n)).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(vec_id), pa.array(tunes, pa.binary())], names=[vec_id, "pcm"])

    return run


def played(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", seconds: float = 0.1, rate: int = RATE) -> DataFrame:
    """vec_id, pcm: each vector as a tune, a note for each of its numbers; stands in for a media column.

    A null or empty vector is silence without samples; a number that is null or not finite is a rest.
    """
    return vectors.select(vec_id, vector).mapInArrow(_played(vec_id, vector, seconds, rate), f"`{vec_id}` {vectors.schema[vec_id].dataType.simpleString()}, pcm binary")


def search_excerpts(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, seconds: float = 0.1) -> DataFrame:
    """Excerpts of every 20th recording (its id is divisible) against all recordings; samples never leave their task.

    The recordings are synthetic, each vector played as a tune.
    """
    own = vectors.select(vec_id, vector)
    play, cut = _played(vec_id, vector, seconds, RATE), _cut(vec_id, "pcm", 14 * HOP, 4 * RATE, 0.6)
    prints = settle(fingerprint(own, media_id=vec_id, samples="pcm", prepare=play), "audio-prints")
    queries = settle(fingerprint(own.where(F.col(vec_id) % every == 0), media_id=vec_id, samples="pcm", prepare=lambda batches: cut(play(batches))), "audio-queries")
    return align(queries, prints, media_id=vec_id)
