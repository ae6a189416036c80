"""SimHash near-duplicates: fingerprints, multi-index hashing, and components of linked documents.

A fingerprint has bit b set where more than half of the document's shingle hashes have it. Equal
fingerprints are one node from then on, so copies cost nothing. Two fingerprints that differ in at
most d bits differ in at most d/2 bits of one of two 32-bit segments; for d <= 5 that is a distance
of 2, so both lie in the radius-1 ball of some value of that segment. Every node therefore
enumerates the 33 values around each of its segments, nodes that meet at a value are compared
whole, and every value hands on a spanning forest of the links it has verified, not all pairs.
The work per node does not depend on how large its group is. Components follow by alternating
large-star and small-star steps on the links.

Defined cases: a null or blank text has fingerprint 0, linked like any other; a text of fewer words
than a shingle is one shingle; rows that repeat a document id each have a fingerprint, and their
components are those of the id's links; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import among, as_bytes, settle, slices, without

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The bits of a byte, each in a lane of eight bits.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
MOST_BITS = 5


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; a text of fewer words is one shingle."""
    words, digest = text.translate(LOWER).split(), xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(line, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashed: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits that more than half of them have; 0 for an empty one."""
    n = np.array([len(x) for x in hashed], np.int64)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    spread = LANES[np.concatenate(hashed).view(np.uint8).reshape(-1, 8)]
    # A lane counts to 255 at most, so each document is summed in blocks of 255 shingles.
    blocks = -(-n[full] // 255)
    first = np.concatenate(([0], np.cumsum(n[full])[:-1]))
    inner = np.arange(blocks.sum()) - np.repeat(np.concatenate(([0], np.cumsum(blocks)[:-1])), blocks)
    sums = np.add.reduceat(spread, np.repeat(first, blocks) + 255 * inner, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.concatenate(([0], np.cumsum(blocks)[:-1])), axis=0)
    out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(column: pa.Array, shingle: int, seed: int) -> np.ndarray:
    return majority([shingle_hashes(value.as_py(), shingle, seed) for value in as_bytes(column)])


def fingerprint(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            found = fingerprints(batch.column(text), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(found.view(np.int64))], names=[doc_id, "fingerprint"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, fingerprint long")


def links(prints: DataFrame, *, most_bits: int = 4) -> DataFrame:
    """a < b: links between different fingerprints that connect all that differ in most_bits or fewer."""
    if not 1 <= most_bits <= MOST_BITS:
        raise ValueError(f"most_bits is from 1 to {MOST_BITS}")
    nodes = prints.select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(32)))
    low, high = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fingerprint", 32)
    # A segment's value takes 32 bits, the segment's number one more.
    balls = F.concat(F.transform(flips, lambda f: low.bitwiseXOR(f)), F.transform(flips, lambda f: high.bitwiseXOR(f).bitwiseOR(F.lit(1 << 32))))
    probes = nodes.select("fingerprint", F.explode(balls).alias("value"))
    met = probes.repartition("value").sortWithinPartitions("value", "fingerprint")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_v, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            v = np.concatenate((rest_v, batch.column("value").to_numpy()))
            f = np.concatenate((rest_f, batch.column("fingerprint").to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(v, v[-1])) if len(v) else 0
            yield from _found(v[:cut], f[:cut], most_bits)
            rest_v, rest_f = v[cut:], f[cut:]
        yield from _found(rest_v, rest_f, most_bits)

    return met.mapInArrow(forests, "a long, b long").distinct()


def _found(v: np.ndarray, f: np.ndarray, most_bits: int) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.diff(v, prepend=v[:1] - 1)) if len(v) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(v)))
    out_a, out_b = [], []
    two = starts[sizes == 2]
    near = np.bitwise_count(f[two] ^ f[two + 1]) <= most_bits
    out_a.append(f[two][near])
    out_b.append(f[two + 1][near])
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        a, b = forest(f[start : start + size], most_bits)
        out_a.append(a)
        out_b.append(b)
    a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
    if len(a):
        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def forest(f: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the verified distances connect, found by growing trees: no pair is kept."""
    waiting = f
    out_a, out_b = [], []
    while len(waiting):
        border, waiting = waiting[:1], waiting[1:]
        while len(border) and len(waiting):
            here, border = border[0], border[1:]
            near = np.bitwise_count(waiting ^ here) <= most_bits
            if near.any():
                reached, waiting = waiting[near], waiting[~near]
                out_a.append(np.full(len(reached), here))
                out_b.append(reached)
                border = np.concatenate((border, reached))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the links with the least node that it is connected to."""
    edges = settle(edges.select("a", "b"), "links")
    while not _stars(edges):  # every round moves a link to a lesser node
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: a node's larger neighbours link to its least neighbour or itself. The least are a
        # table, so that Spark can split the rows of a node with very many links.
        least = settle(both.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower.select("a", F.col("m").alias("b"))).distinct()
        edges = settle(small, "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a lesser node, and that one has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.when(F.col("a") <= F.col("b"), 2).otherwise(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, most_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id: the least document id that is reachable by links."""
    prints = settle(fingerprint(docs, doc_id=doc_id, text=text, shingle=shingle, seed=seed), "prints")
    firsts = settle(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first")), "firsts")
    # Fingerprints are named by their least documents from here on, so a root is a component's least document.
    roots = components(between_firsts(links(prints, most_bits=most_bits), firsts).where("a is not null and b is not null"))
    named = firsts.join(roots, F.col("first") == F.col("node"), "left").select(F.col("fingerprint").alias("_print"), F.coalesce("root", "first").alias("component_id"))
    return prints.join(named, F.col("fingerprint") == F.col("_print")).select(doc_id, "fingerprint", "component_id")


def between_firsts(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links of fingerprints (a, b) as links of the documents (fingerprint, first) that name them."""
    ends = [firsts.select(F.col("fingerprint").alias(f"_{side}"), F.col("first").alias(f"first_{side}")) for side in "ab"]
    return found.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))


# Near copies by similarity. Documents with equal sets of shingles are one node. Nodes whose SimHash
# fingerprints are linked by multi-index hashing are candidates; but at a similarity of 0.8 fingerprints
# differ in ten bits on average, more than segments can answer for. So nodes also meet where a band of
# least hashes (MinHash) of their shingles is the same; two of similarity 0.8 share none of the bands in
# one of 20,000 cases. Sizes and sketches of two bits for each least hash rule most of what meets out;
# what is left is verified on whole sets of shingles. Where several meet, a spanning tree is verified
# first; then what no verified link connects yet is compared at the places where it meets, and only
# links that connect something are handed on: what is left out is known to be redundant.

SEED = 42
BANDS, ROWS = 25, 5
_DRAWN = np.random.default_rng(2042).integers(0, 1 << 63, (2, BANDS * ROWS)).astype(np.uint64)
FACTORS, SHIFTS = 2 * _DRAWN[0] + 1, _DRAWN[1]
SKETCH = ["k0", "k1", "k2", "k3"]
PAIRS_OF_BITS = np.uint64(0x5555555555555555)
#: What an estimate from sketches may be short of the similarity; its deviation at 0.8 is 0.043.
SLACK = 0.2
#: Trees are grown over at most so many nodes at a time, the first of which all blocks of a place share.
BLOCK = 1024
#: Nodes of one place that a task compares with each other; where more meet, several tasks share the work.
AT_ONCE = 4_000


def shingle_set(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The hashes of a text's different shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle, seed))


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The least of each of BANDS * ROWS hash functions over each set; zeros for an empty one."""
    sizes = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(sizes)
    least = np.zeros((len(sets), BANDS * ROWS), np.uint64)
    if len(full):
        hashes, starts = np.concatenate([sets[k] for k in full]), np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k in range(BANDS * ROWS):
            least[full, k] = np.minimum.reduceat(hashes * FACTORS[k] + SHIFTS[k], starts)
    return least


def meeting_places(least: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One value for each band of least hashes, none for an empty set."""
    digest = xxhash.xxh64_intdigest
    values = [digest(row[k * ROWS : (k + 1) * ROWS].tobytes(), k) for row in least[sizes > 0] for k in range(BANDS)]
    ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(values, np.uint64).view(np.int64)))


def sketches(least: np.ndarray) -> np.ndarray:
    """Two bits of each least hash in four integers."""
    bits = np.zeros((len(least), 256), np.uint8)
    for k in (0, 1):
        bits[:, k : 2 * least.shape[1] : 2] = (least >> np.uint64(20 + k)) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def may_be_similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes (n, m) and sketches (a, b; four integers in the last axis) allow the similarity, and how many hashes differ."""
    x = a ^ b
    differing = np.bitwise_count((x | (x >> np.uint64(1))) & PAIRS_OF_BITS).sum(axis=-1)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m)) & (differing <= BANDS * ROWS * 0.75 * (1 - similarity + SLACK)), differing


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets of hashes."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _runs(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[list[np.ndarray]]:
    """The named columns of every run of two rows or more with one key, of batches sorted by the key."""

    def cut(columns: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        v = columns[0]
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(v)))
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            yield [x[start : start + size] for x in columns[1:]]

    rest = [np.zeros(0, np.int64) for _ in (key, *names)]
    for batch in batches:
        rest = [np.concatenate((x, batch.column(n).to_numpy())) for x, n in zip(rest, (key, *names), strict=True)]
        done = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        yield from cut([x[:done] for x in rest])
        rest = [x[done:] for x in rest]
    yield from cut(rest)


def _in_batches(pairs: Iterator[np.ndarray], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Arrays of pairs (two rows) as batches of a <= b."""
    waiting, n = [np.zeros((2, 0), np.int64)], 0
    for x in pairs:
        waiting.append(x)
        n += x.shape[1]
        if n > most:
            a, b = np.concatenate(waiting, axis=1)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            waiting, n = [np.zeros((2, 0), np.int64)], 0
    a, b = np.concatenate(waiting, axis=1)
    if len(a):
        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def tree(near: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Pairs of places: the shortest trees over the pairs that are near, by the matrix of how far they differ."""
    away = np.where(near, differing, 255)
    best, link = np.full(len(near), 255), np.full(len(near), -1)
    inside = np.zeros(len(near), bool)
    out = []
    for _ in range(len(near)):
        here = int(np.argmin(np.where(inside, 256, best)))
        if link[here] >= 0:
            out.append((link[here], here))
        inside[here] = True
        closer = ~inside & (away[here] < best)
        best[closer], link[closer] = away[here][closer], here
    return np.array(out, np.int64).reshape(-1, 2).T


def that_meet(nodes: DataFrame) -> DataFrame:
    """The nodes that meet another one anywhere; only their numbers are shuffled for all nodes."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            v, d = batch.column("value").to_numpy(), batch.column("doc").to_numpy()
            if not len(v):
                continue
            if last is not None:
                v, d = np.concatenate((last[0], v)), np.concatenate((last[1], d))
            same = v[1:] == v[:-1]
            meets = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield pa.RecordBatch.from_pydict({"_doc": d[meets]})
            last = v[-1:], d[-1:]

    values = nodes.select(F.explode("places").alias("value"), "doc").repartition("value").sortWithinPartitions("value", "doc")
    return nodes.join(values.mapInArrow(some, "_doc long").distinct(), F.col("doc") == F.col("_doc"), "left_semi")


def crowds(nodes: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """_value, _first, _parts: the places where more than `at_once` nodes meet, their least node, and how many parts they are dealt into."""
    values = nodes.select(F.explode("places").alias("_value"), "doc")
    return values.groupBy("_value").agg(F.min("doc").alias("_first"), F.count("*").alias("n")).where(F.col("n") > at_once).select("_value", "_first", F.ceil(F.col("n") / at_once).cast("int").alias("_parts"))


def in_parts(meetings: DataFrame, parts: DataFrame, *, pairs: bool) -> DataFrame:
    """place, parts and the columns of meetings (value, doc, ...), rows of one place in a row.

    A value that is not among the parts is one place. The nodes of the others are dealt by hash. With `pairs`
    each part meets each other part at a place; otherwise each part is a place, at which the first node is as well.
    """
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    if pairs:
        places = F.array_distinct(F.transform(every, lambda other: F.xxhash64("value", F.least(own, other), F.greatest(own, other))))
    else:
        places = F.transform(F.when(F.col("doc") == F.col("_first"), every).otherwise(F.array(own)), lambda k: F.xxhash64("value", k))
    told = meetings.join(parts, F.col("value") == F.col("_value"), "left").withColumn("parts", F.coalesce("_parts", F.lit(1)))
    return told.select(F.explode(places).alias("place"), "parts", *meetings.columns)


def candidates(nodes: DataFrame, crowded: DataFrame, similarity: float) -> DataFrame:
    """a < b: nodes (doc, places, sketch, size) that meet and may be similar, the shortest trees of them.

    The nodes of places with three or more come as rows of a = b as well: their other pairs are open.
    Nodes of crowded places meet in parts.
    """

    def pairs(parts: np.ndarray, d: np.ndarray, size: np.ndarray, *sketch: np.ndarray) -> Iterator[np.ndarray]:
        k = np.stack(sketch, axis=1).view(np.uint64)
        if len(d) == 2 and parts[0] == 1:
            near, _ = may_be_similar(k[0], k[1], size[0], size[1], similarity)
            yield d.reshape(2, 1)[:, : int(near)]
            return
        yield np.stack((d, d))
        for start in range(1, len(d), BLOCK - 1):
            part = np.concatenate(([0], np.arange(start, min(len(d), start + BLOCK - 1))))
            near, differing = may_be_similar(k[part, None], k[part], size[part, None], size[part], similarity)
            yield d[part[tree(near, differing)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(x for columns in _runs(batches, "place", ["parts", "doc", "size", *SKETCH]) for x in pairs(*columns))

    meetings = nodes.select(F.explode("places").alias("value"), "doc", "size", *SKETCH)
    dealt = in_parts(meetings, crowded, pairs=False).drop("value").repartition("place").sortWithinPartitions("place", "doc")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def open_meetings(nodes: DataFrame, crowded: DataFrame, several: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """value, doc, group: nodes among `several` that, at a value, meet one that may be similar and that links (node, root) do not connect to them."""
    again = nodes.join(several.select(F.col("doc").alias("_doc")), F.col("doc") == F.col("_doc"), "left_semi").join(roots, F.col("doc") == F.col("node"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, d, group, size, *sketch in _runs(batches, "place", ["value", "doc", "group", "size", *SKETCH]):
            if (group != group[0]).any() and (open_here := open_ones(group, size, np.stack(sketch, axis=1).view(np.uint64), similarity)).any():
                yield pa.RecordBatch.from_pydict({"value": value[open_here], "doc": d[open_here], "group": group[open_here]})

    meetings = again.withColumn("group", F.coalesce("root", "doc")).select(F.explode("places").alias("value"), "doc", "group", "size", *SKETCH)
    dealt = in_parts(meetings, crowded, pairs=True).drop("parts").repartition("place").sortWithinPartitions("place", "group")
    return dealt.mapInArrow(run, "value long, doc long, group long").distinct()


def open_ones(group: np.ndarray, size: np.ndarray, k: np.ndarray, similarity: float, block: int = 256) -> np.ndarray:
    """Which nodes, in order of their groups, may be similar to one of another group; nodes of a group are not compared."""
    out = np.zeros(len(group), bool)
    for start in range(0, len(group), block):
        here = slice(start, start + block)
        after = int(np.searchsorted(group, group[start], side="right"))
        for other in range(after if after >= start + block else start, len(group), 4096):
            there = slice(other, other + 4096)
            near = may_be_similar(k[here, None], k[there], size[here, None], size[there], similarity)[0] & (group[here, None] != group[there])
            out[here] |= near.any(axis=1)
            out[there] |= near.any(axis=0)
    return out


def linked(meetings: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, at_once: int = AT_ONCE) -> DataFrame:
    """Links a, b that connect the groups of what meets (value, doc, group), verified on sets of shingles (doc, hashes).

    Nodes that meet at a value are compared in one task with their sets, and only a link that
    connects two groups anew is handed on. Where more than `at_once` meet, each of several parts
    of them meets each other part in a task of its own.
    """
    # Only values where many meet are parted: few, so that the meetings themselves need not move for it.
    parts = settle(meetings.groupBy(F.col("value").alias("_value")).agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("_value", F.ceil(F.col("n") / at_once).cast("int").alias("_parts")), "parts")
    dealt = in_parts(meetings, parts, pairs=True).select("place", "doc", "group")
    told = nodes.select(F.col("doc").alias("_doc"), "size", *SKETCH).join(sets.select(F.col("doc").alias("_of"), "hashes"), F.col("_doc") == F.col("_of"))
    rows = dealt.join(told, F.col("doc") == F.col("_doc")).select("place", "doc", "group", "size", *SKETCH, "hashes").repartition("place").sortWithinPartitions("place", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(connecting(t, similarity) for t in _tables(batches, "place"))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _tables(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by key."""
    rest = None
    for batch in batches:
        table = pa.concat_tables([*([] if rest is None else [rest]), pa.Table.from_batches([batch])])
        k = table.column(key).to_numpy()
        starts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def connecting(table: pa.Table, similarity: float) -> np.ndarray:
    """Pairs of docs of one place, similar by their sets of shingles, that connect its groups as far as such pairs do."""
    d, size = (table.column(c).to_numpy() for c in ("doc", "size"))
    k = np.stack([table.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)
    group = np.unique(table.column("group").to_numpy(), return_inverse=True)[1]
    sets = [_read(x.as_py()) for x in table.column("hashes")]
    out = []
    for i in range(len(d) - 1):
        near, _ = may_be_similar(k[i], k[i + 1 :], size[i], size[i + 1 :], similarity)
        others = i + 1 + np.flatnonzero(near & (group[i + 1 :] != group[i]))
        if not len(others):
            continue
        whole = np.concatenate([sets[j] for j in others])
        held = sets[i][np.minimum(np.searchsorted(sets[i], whole), size[i] - 1)] == whole
        shared = np.add.reduceat(held.astype(np.int64), np.concatenate(([0], np.cumsum(size[others])[:-1])))
        for j in others[shared / (size[i] + size[others] - shared) >= similarity].tolist():
            if group[j] != group[i]:
                out.append((d[i], d[j]))
                group[group == group[j]] = group[i]
    return np.array(out, np.int64).reshape(-1, 2).T


def shingle_sets(docs: DataFrame, ids: DataFrame, *, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc, hashes: the sets of shingles of the documents whose ids are asked for, five bytes for each shingle."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            found = [_written(shingle_set(t.as_py(), shingle, SEED)) for t in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(found, pa.binary())], names=["doc", "hashes"])

    return among(docs.select(doc_id, text), doc_id, ids).mapInArrow(sets, "doc long, hashes binary").dropDuplicates(["doc"])


def _written(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray((hashes >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _read(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose documents' sets of shingles (doc, hashes) are that similar."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("one"), batch.column("two"), strict=True)
            keep = pa.array([similarity_of(_read(x.as_py()), _read(y.as_py())) >= similarity for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    one, two = (sets.select(F.col("doc").alias(f"_{side}"), F.col("hashes").alias(name)) for side, name in (("a", "one"), ("b", "two")))
    both = edges.select("a", "b").join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "one", "two")
    return both.mapInArrow(judged, "a long, b long")


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, component_id: the least id that chains of near copies reach, of documents with equal contents or verified similarity.

    `at_once` is how many nodes of one place a task compares; it does not change the classes.
    """
    all_docs = settle(_contents(docs, doc_id, text, shingle), "contents")
    columns = ("fingerprint", "places", "size", *SKETCH)
    nodes = settle(all_docs.groupBy("content").agg(F.min(doc_id).alias("doc"), *(F.first(c).alias(c) for c in columns)), "nodes")
    # By fingerprints: linked ones by their least nodes, and nodes of equal fingerprints.
    firsts = settle(nodes.groupBy("fingerprint").agg(F.min("doc").alias("first")), "firsts")
    same = nodes.join(firsts.withColumnRenamed("fingerprint", "_print"), F.col("fingerprint") == F.col("_print")).where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    by_prints = between_firsts(links(nodes), firsts).unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    meeting = settle(that_meet(nodes).select("doc", *columns), "meeting")
    crowded = settle(crowds(meeting, at_once), "crowds")
    found = settle(candidates(meeting, crowded, similarity).unionByName(by_prints).distinct(), "candidates")
    sets = settle(shingle_sets(docs, found.select("a").union(found.select("b")).distinct(), doc_id=doc_id, text=text, shingle=shingle), "sets")
    edges = settle(verified(found.where("a < b"), sets, similarity), "verified")
    roots = components(edges)
    several = found.where("a = b").select(F.col("a").alias("doc"))
    if not several.isEmpty():
        meetings = settle(open_meetings(meeting, crowded, several, roots, similarity), "meetings")
        more = settle(linked(meetings, meeting, sets, similarity, at_once), "more")
        if not more.isEmpty():
            roots = merged_roots(roots, more)
    named = nodes.join(roots, F.col("doc") == F.col("node"), "left").select(F.col("content").alias("_content"), F.coalesce("root", "doc").alias("component_id"))
    return all_docs.select(doc_id, "content").join(named, F.col("content") == F.col("_content")).select(doc_id, "component_id")


def merged_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root after more links: classes are joined by their roots, of which few are concerned."""
    held = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    one = more.join(held, F.col("a") == F.col("_node"), "left").select(F.coalesce("_root", "a").alias("a"), "b")
    two = one.join(held, F.col("b") == F.col("_node"), "left").select("a", F.coalesce("_root", "b").alias("b")).where("a <> b").distinct()
    above = settle(components(two).select(F.col("node").alias("_of"), F.col("root").alias("_above")), "above")
    moved = roots.join(above, F.col("root") == F.col("_of"), "left").select("node", F.coalesce("_above", "root").alias("root"))
    return moved.unionByName(above.select(F.col("_of").alias("node"), F.col("_above").alias("root")))


def _contents(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, content (the hash of the set of shingles), fingerprint, places, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            sets = [shingle_set(t.as_py(), shingle, SEED) for t in as_bytes(batch.column(text))]
            sizes, least = np.array([len(x) for x in sets], np.int64), least_hashes(sets)
            content = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            sketch = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sketches(least).T]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), content, pa.array(majority(sets).view(np.int64)), meeting_places(least, sizes), pa.array(sizes), *sketch], names=[doc_id, "content", "fingerprint", "places", "size", *SKETCH])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, content binary, fingerprint long, places array<long>, size long, {', '.join(f'{k} long' for k in SKETCH)}")


def first_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies of a document with a smaller id, with the columns they came with.

    A null document id is no one's copy: such rows stay.
    """
    found = near_copies(docs.where(F.col(doc_id).isNotNull()), doc_id=doc_id, text=text, shingle=shingle, similarity=similarity)
    losers = settle(found.where(F.col(doc_id) != F.col("component_id")).select(doc_id).distinct(), "losers")
    return without(docs, doc_id, losers)


def as_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
