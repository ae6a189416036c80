"""Periodic runs in texts by Karp-Miller-Rosenberg naming: stretches of words that repeat with a period.

The words of many documents lie in one vector, so that every step is a NumPy operation. At level k
every window of 2**k words has a name, the first place where the same window of the same document
starts; the names of a level are those of pairs of names of the level below. Two places agree for
as long as their names do, tried by descending levels.

A run of period p and length n agrees with itself, shifted by p, over n - p words, at least
m = max(p, least - p). Places in steps small enough that each such stretch holds a whole window of
a power of two at one of them form a grid; where the names at a place of the grid and p further on
are the same, the stretch is followed in both directions. Grid places whose stretch the place
before has entered are passed over. There are about n log n places in all, no hashes and no sorted suffixes.

Defined cases: a null or empty text has no words, no runs and collapses to ''; repeated rows and
null ids are each reported; an empty table gives no rows; a text is handled whole, in one task, with
about 4 log2(words) bytes for each word; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from plotweave.llm.common import as_bytes, extended, fresh, slices

#: Pairs of places that are compared at a time.
PAIRS = 1 << 20

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def white_space_words(_, text: bytes) -> list[bytes]:
    """What lies between the ASCII characters of white space."""
    return text.split()


def first_names(docs: list[list[bytes]]) -> np.ndarray:
    """Level 0: for each word the last place of that word in its document, places counted over all documents."""
    names, base = [], 0
    for words in docs:
        last = dict(zip(words, range(base, base + len(words)), strict=True))
        names += map(last.__getitem__, words)
        base += len(words)
    return np.array(names, np.int32)


def named_levels(first: np.ndarray, highest: int) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, .. 2**highest words that start at each place; a window that occurs once, or does not fit, is named by its place."""
    levels, n = [first], len(first)
    for k in range(highest):
        below, half = levels[-1], 1 << k
        names = np.arange(n, dtype=np.int32)
        often = np.bincount(below, minlength=n)[below] > 1
        at = np.flatnonzero(often[: max(0, n - half)] & often[half:])
        at = at[at + 2 * half <= n]
        if len(at):
            _, where, group = np.unique(below[at].astype(np.int64) * n + below[at + half], return_index=True, return_inverse=True)
            names[at] = at[where[group]]
        levels.append(names)
    return levels


def agreement(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray, backwards: bool = False) -> np.ndarray:
    """How many words from places one and two on (or before them) are the same."""
    n, got = len(levels[0]), np.zeros(len(one), np.int64)

    def more(rows: np.ndarray, k: int) -> np.ndarray:
        size = 1 << k
        a, b = (one[rows] - got[rows] - size, two[rows] - got[rows] - size) if backwards else (one[rows] + got[rows], two[rows] + got[rows])
        fits = (a >= 0) if backwards else (b < n)
        rows = rows[fits]
        rows = rows[levels[k][a[fits]] == levels[k][b[fits]]]
        got[rows] += size
        return rows

    rows = np.arange(len(one))
    while len(rows):
        rows = more(rows, len(levels) - 1)
    for k in range(len(levels) - 2, -1, -1):
        more(np.arange(len(one)), k)
    return got


def window_level(stretch: np.ndarray) -> np.ndarray:
    """The level of the largest window of which one lies in any stretch at a step of at least its size."""
    return np.floor(np.log2((stretch + 1) // 2)).astype(np.int64)


def grid(sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Periods, places, window levels and steps to compare, by period and place; sizes: words of each document, descending."""
    longest = int(sizes[0]) // 2 if len(sizes) and sizes[0] >= least else 0
    periods = np.arange(1, longest + 1)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    # Documents long enough for a period lie in front of all others.
    reach = ends[np.searchsorted(-sizes, -np.maximum(least, 2 * periods), side="right")]
    stretch = np.maximum(periods, least - periods)
    level = window_level(stretch)
    step = stretch - (1 << level) + 1
    count = np.maximum(0, (reach - periods - (1 << level)) // step + 1)
    start = 0
    while start < longest:
        stop = start + max(1, int(np.searchsorted(np.cumsum(count[start : start + PAIRS]), PAIRS, side="right")))
        part = slice(start, min(stop, longest))
        c = count[part]
        number = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        steps = np.repeat(step[part], c)
        yield np.repeat(periods[part], c), number * steps, np.repeat(level[part], c), steps
        start = stop


def runs_of(docs: list[list[bytes]], least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents in descending order of their sizes: document, start, length and period, in that order of sorting but for length."""
    sizes = np.array([len(d) for d in docs], np.int64)
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes[0] < least:
        return none, none, none, none
    top = int(window_level(np.array([max(int(sizes[0]) // 2, least)]))[0])
    stacked = np.stack(named_levels(first_names(docs), top))
    levels, last = list(stacked), stacked.shape[1] - 1
    found = []
    for period, place, level, step in grid(sizes, least):
        hit = stacked[level, place] == stacked[level, place + period]
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        # The stretch from a hit reaches the next place of the grid if windows that cover the way agree too.
        p, g, k, h = period[at], place[at], level[at], step[at]
        w = 1 << k
        on = np.ones(len(at), bool)
        for further in (np.minimum(w, h - w), h - w):
            on &= stacked[k, g + further] == stacked[k, np.minimum(g + further + p, last)]
        entered = np.zeros(len(at), bool)
        entered[1:] = (np.diff(at) == 1) & (p[1:] == p[:-1]) & on[:-1]
        p, g = p[~entered], g[~entered]
        start = g - agreement(levels, g, g + p, backwards=True)
        stop = g + p + agreement(levels, g, g + p)
        good = stop - start >= np.maximum(least, 2 * p)
        found.append(np.stack([start[good], stop[good], p[good]]))
    if not found:
        return none, none, none, none
    start, stop, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    # One stretch is found for multiples of its period too: the smallest one counts.
    own = np.ones(len(start), bool)
    own[1:] = (np.diff(start) != 0) | (np.diff(stop) != 0)
    start, stop, period = start[own], stop[own], period[own]
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.searchsorted(ends, start, side="right") - 1
    return doc, start - ends[doc], stop - start, period


def without_repeats(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run has after its first period."""
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, start + period, 1)
    np.add.at(over, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(over[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 12, words: Callable[[object, bytes], list[bytes]] = white_space_words) -> tuple[DataFrame, str, str, str]:
    """The documents with three more columns, whose names are returned too: words, runs, and the collapsed text.

    Runs are array<struct<start,length,period>> over word numbers from 0, by start, then period; the
    collapsed text has the words that no run repeats, joined by spaces. `words` makes a row's words of its id and text.
    """
    n_words, runs, collapsed = (fresh(docs.columns, x) for x in ("n_words", "periodic_runs", "collapsed_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            cut = [words(key, value.as_py()) for key, value in zip(batch.column(doc_id).to_pylist(), as_bytes(batch.column(text)), strict=True)]
            order = sorted(range(len(cut)), key=lambda i: -len(cut[i]))
            doc, start, length, period = runs_of([cut[i] for i in order], least)
            bounds = np.searchsorted(doc, np.arange(len(cut) + 1))
            offsets, texts = np.zeros(len(cut) + 1, np.int32), [b""] * len(cut)
            place = np.argsort(np.array(order, np.int64))  # of each row of the batch among the sorted ones
            rows = [np.arange(bounds[k], bounds[k + 1]) for k in place.tolist()]
            for i, own in enumerate(rows):
                offsets[i + 1] = offsets[i] + len(own)
                texts[i] = b" ".join(without_repeats(cut[i], start[own], length[own], period[own]) if len(own) else cut[i])
            taken = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([start[taken], length[taken], period[taken]], names=["start", "length", "period"]))
            yield extended(batch, **{n_words: pa.array([len(c) for c in cut], pa.int64()), runs: spans.cast(RUNS), collapsed: pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())})

    more = StructType.fromDDL(f"`{n_words}` long, `{runs}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed}` string")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more.fields])), n_words, runs, collapsed
