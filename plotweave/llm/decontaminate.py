"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once per bounded shard of items and shipped to the tasks;
every document streams its words through it, the automaton keeps the longest suffix that occurs in
an item, and wherever that reaches the window length the words of the window are hit. Documents
are never shuffled. Items beyond one shard's bound are handled by further passes over the same
rows, which are written between the passes: one shard's automaton is all that the driver or a task
holds at a time, however large the benchmark.

Defined cases: a null or empty text has no words and no hit; an item without words has no window;
an item shorter than the window is a window of its own; a null item id counts as the item ''; equal
items and repeated document rows are each reported; columns of the documents are passed on
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import as_bytes, fresh, settle

#: Lower-case digits and letters and all bytes beyond ASCII stay; everything else parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SHARD_WORDS = 250_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences; a state stands for all substrings with the same ends."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        #: Items by the state that holds their window of full length, and short items by the state that holds them.
        self.items_at: dict[int, set] = {}
        self.short_at: dict[int, list[tuple[int, object]]] = {}
        for item, ids in coded:
            v = length = 0
            for c in ids:
                v, length = self._next(v, length, c)
                if length >= window:
                    self.items_at.setdefault(v, set()).add(item)
            if len(ids) < window:
                self.short_at.setdefault(self._holding(v, len(ids)), []).append((len(ids), item))

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the substrings that p's longest one gives; q keeps the longer ones."""
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _walk(self, v: int, length: int, c: int) -> tuple[int, int]:
        while v and c not in self.step[v]:
            v = self.link[v]
            length = self.length[v]
        to = self.step[v].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def _holding(self, v: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[v]] >= length:
            v = self.link[v]
        return v

    def _next(self, v: int, length: int, c: int) -> tuple[int, int]:
        """A step that forgets what lies beyond the window, so that no later step climbs over it again."""
        v, length = self._walk(v, length, c)
        return (self._holding(v, self.window), self.window) if length >= self.window else (v, length)

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of words, merged and in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        get = self.vocab.get
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        # A window lies within a run of words that items have: all other words are passed over at once.
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if stop - start >= self.shortest:
                self._run(ids[start:stop].tolist(), start, spans, found)
        return merged(spans), found

    def _run(self, ids: list[int], start: int, spans: list[tuple[int, int]], found: set) -> None:
        v = length = 0
        window, links, short = self.window, self.link, self.short_at
        for i, c in enumerate(ids, start + 1):
            v, length = self._next(v, length, c)
            if length >= window:
                spans.append((i - window, i))
                found |= self.items_at.get(v, set())
            if short:
                u = v
                while u > 0:
                    for n, item in short.get(u, ()):
                        if n <= length:
                            spans.append((i - n, i))
                            found.add(item)
                    u = links[u]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def matches(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, str, str, str]:
    """The documents with three more columns, whose names are returned too: words, hit spans, items found.

    The spans column is array<struct<start,stop>> over word numbers; items are strings in order.
    """
    keys = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("words")).where("words is not null")
    total = keys.select(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // (6 * shard_words)))
    n_words, spans, found = (fresh(docs.columns, x) for x in ("n_words", "hit_spans", "hit_items"))
    out = docs.withColumns({n_words: F.lit(0).cast("long"), spans: F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"), found: F.lit(None).cast("array<string>")})
    for k in range(shards):
        if k:
            out = settle(out, "decontaminated")
        part = keys if shards == 1 else keys.where(F.pmod(F.xxhash64("words"), F.lit(shards)) == k)
        automaton = ItemAutomaton([(r["item"], words_of(bytes(r["words"]))) for r in part.collect()], window)
        out = out.mapInArrow(_streamer(docs.sparkSession.sparkContext.broadcast(automaton), text, n_words, spans, found), out.schema)
    return out, n_words, spans, found


def _streamer(shared, text: str, n_words: str, spans: str, found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            sizes, all_spans, all_items = [], [], []
            for value, had, items in zip(as_bytes(batch.column(text)), batch.column(spans).to_pylist(), batch.column(found).to_pylist(), strict=True):
                words = words_of(value.as_py())
                new, hit = automaton.stream(words)
                sizes.append(len(words))
                all_spans.append(merged([*((s["start"], s["stop"]) for s in had or []), *new]))
                all_items.append(sorted({*(items or []), *hit}))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[n_words] = pa.array(sizes, pa.int64())
            columns[spans] = pa.array([[{"start": a, "stop": b} for a, b in x] for x in all_spans], batch.schema.field(spans).type)
            columns[found] = pa.array(all_items, batch.schema.field(found).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def report(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13, one_in: int = 20, **named) -> DataFrame:
    """One row per document: words, hit words, items found, their digest, and whether one word in `one_in` is hit."""
    hit, n_words, spans, found = matches(docs.select(doc_id, text), items, text=text, window=window, **named)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return hit.select(
        doc_id,
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col(n_words))).alias("contaminated"),
        F.col(spans).alias("hit_spans"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", window: int = 13, one_in: int = 20, longest: int | None = None, **named) -> DataFrame:
    """The documents without contamination, with the columns they came with.

    A document of which one word in `one_in` is hit goes as a whole. In the others, spans of more
    than `longest` words are cut from the text (None: they stay, and the text is unchanged).
    """
    hit, n_words, spans, _ = matches(docs, items, text=text, window=window, **named)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    kept = hit.where((n_hit == 0) | (n_hit * one_in < F.col(n_words)))
    if longest is None:
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    names, at = docs.columns, docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[: len(names)]
            long = [[s for s in had if s["stop"] - s["start"] > longest] for had in batch.column(spans).to_pylist()]
            if any(long):
                old = columns[at].to_pylist()
                columns[at] = pa.array([_without(t.encode(), s).decode() if s else t for t, s in zip(old, long, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(cut, docs.schema)


def _without(raw: bytes, spans: list[dict]) -> bytes:
    at = [m.span() for m in WORD.finditer(raw)]
    out, done = [], 0
    for s in spans:
        out.append(raw[done : at[s["start"]][0]])
        done = at[s["stop"] - 1][1]
    return b"".join([*out, raw[done:]])
