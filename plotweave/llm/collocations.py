"""Phrases whose words meet more often than chance: generalised suffix automata by shard, counts reduced over all.

A shard is a bounded part of a task's texts of one language. Its automaton has a state for all
phrases of at most `depth` words that end at the same places; it is built level by level in NumPy
(a phrase of k + 1 words is a phrase of k words and a word), the states are those chains of
suffixes that occur equally often, and a state's link is its longest suffix that occurs at more
places. The phrases of a shard are enumerated from its states with their number of end places and summed over all shards.

Longer phrases are counted only where both phrases one word shorter are frequent. What is frequent
reaches the tasks as a sieve, a bitmap of bounded size which lets too much through, never too
little, so the counts that matter are exact. A link and its mirror image, the phrase without its
last word, lead from each candidate to the shorter ones it may make superfluous.

Defined cases: a null text has no words; a null language is 'und', like that language itself;
repeated rows count again; an empty table gives no rows; a text is counted whole, in one task;
languages with fewer phrases than asked for give what they have; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import as_bytes, settle

#: Text of one shard; its automaton takes about ten times as much memory.
SHARD_BYTES = 8 << 20
#: Text for each bucket of phrases; a bucket takes about ten times as much memory.
BUCKET_BYTES = 4 << 20
#: The sieve's bits for each frequent phrase, and its largest size: 64 MB.
BITS_EACH, MOST_BITS = 32, 1 << 29
#: A byte that no UTF-8 text has stands for what ends a piece.
BARRIER = b"\xff"
#: A-Z to lower case, `[.,;:!?\x0A-\x0D]` to the barrier, tabs to spaces.
PIECE_BYTES = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_and_barriers(text: bytes) -> list[bytes]:
    return (text.translate(PIECE_BYTES) + BARRIER).replace(BARRIER, b" \xff ").split()


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys by one number each: a place that has it, the number at each place, and how many places have it."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.empty(len(keys), np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return order[starts], group, np.diff(np.append(starts, len(keys))).astype(np.int32)


class ShardAutomaton:
    """The states of all phrases of at most `depth` words of a sequence of word numbers; 0 parts phrases.

    `length`, `times`, `end`, `link`: of each state its longest phrase's words, at how many places
    it ends, one of those places, and the state of its longest suffix that ends at more (-1: none).
    `wanted(k, ends)`: which phrases of k words, given by a place where each ends, may be part of
    longer ones. Phrases of k + 1 words are only looked at where both their parts of k words may.
    """

    def __init__(self, words: np.ndarray, depth: int, wanted=None):
        n, base = len(words), 0
        node = np.full(n, -1, np.int32)  # of the phrase of k words that starts at a place
        at, keys, below = np.flatnonzero(words > 0), words[words > 0], None
        times, end, length, suffix = [], [], [], []
        for k in range(1, depth + 1):
            first, group, counts = named(keys)
            node[at] = group
            ends = at[first] + k - 1
            times.append(counts)
            end.append(ends.astype(np.int32))
            length.append(np.full(len(counts), k, np.int8))
            # The suffix one word shorter starts one place later; on the first level there is none.
            suffix.append(below[at[first] + 1] + base if k > 1 else np.full(len(counts), -1, np.int32))
            base += len(times[-2]) if k > 1 else 0
            if k == depth:
                break
            below, passed = node, np.ones(len(counts) + 1, bool) if wanted is None else np.append(wanted(k, ends), False)
            passed[-1] = False  # -1 finds the last one
            node = np.full(n, -1, np.int32)
            may = passed[below]
            # Two phrases of k words that overlap in all but one word are one of k + 1 words.
            at = np.flatnonzero(may[:-1] & may[1:])
            keys = below[at].astype(np.int64) * (len(counts) + 1) + below[at + 1]
        self.times, self.end, self.length = (np.concatenate(x) for x in (times, end, length))
        suffix = np.concatenate(suffix)
        # A phrase is in the state of the phrase one word longer that it is a suffix of, if both end equally often.
        top = np.arange(len(suffix), dtype=np.int32)
        same = np.flatnonzero(suffix >= 0)
        same = same[self.times[suffix[same]] == self.times[same]]
        top[suffix[same]] = same
        for _ in range(depth - 1):
            top = top[top]
        self.shortest = self.length.copy()
        np.minimum.at(self.shortest, top, self.length)
        link = suffix
        for _ in range(depth - 1):
            inside = np.flatnonzero(link >= 0)
            inside = inside[top[link[inside]] == top[inside]]
            link[inside] = suffix[link[inside]]
        states = np.flatnonzero(top == np.arange(len(top)))
        number = np.full(len(top) + 1, -1, np.int32)
        number[states] = np.arange(len(states))
        self.link = number[np.where(link[states] >= 0, top[link[states]], -1)]
        self.times, self.end, self.length, self.shortest = (x[states] for x in (self.times, self.end, self.length, self.shortest))

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A place where each phrase of k words ends, and at how many it does."""
        held = (self.shortest <= k) & (k <= self.length)
        return self.end[held], self.times[held]


def spelled(vocabulary: pa.Array, words: np.ndarray, ends: np.ndarray, k: int) -> pa.Array:
    """The phrases of k words that end at those places, joined by spaces, as bytes."""
    parts = [vocabulary.take(pa.array(words[ends - j])) for j in range(k - 1, -1, -1)]
    return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


def sieve_place(lang: bytes, phrases: list[bytes], bits: int) -> np.ndarray:
    head = zlib.crc32(lang + b"\n")
    crc = zlib.crc32
    return np.fromiter((crc(p, head) for p in phrases), np.int64, len(phrases)) & (bits - 1)


def sieve_of(frequent: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the phrases' hashes, at most MOST_BITS, and its number of bits."""
    total = frequent.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * total).bit_length()))
    place = F.pmod(F.crc32(F.concat("lang", F.lit("\n"), "phrase").cast("binary")), F.lit(bits)) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).toArrow()
    sieve = np.zeros(bits >> 3, np.uint8)
    for bucket, bitmap in zip(rows.column("bucket").to_pylist(), rows.column("bitmap").to_pylist(), strict=True):
        start = (bucket - 1) * 4096
        sieve[start : start + 4096] = np.frombuffer(bitmap, np.uint8)[: len(sieve) - start]
    return sieve, bits


#: A row is what a shard has for a bucket of phrases: their bytes laid end to end, their sizes, and how often each occurs.
PACKED = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("phrases", pa.binary()), ("sizes", pa.binary()), ("times", pa.binary())])


def word_codes(known) -> np.ndarray:
    """A number for each word that does not depend on the shard."""
    return np.fromiter(map(zlib.crc32, known), np.uint64, len(known))


def phrase_codes(codes: np.ndarray, words: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(ends), k, np.uint64)
    for j in range(k - 1, -1, -1):
        out = (out ^ codes[words[ends - j]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def shard_counts(docs: DataFrame, lengths: tuple[int, ...], buckets: int, sieve: tuple[np.ndarray, int] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """How often each phrase of those numbers of words is in a shard, packed by buckets of phrases.

    The number of all words of a language comes with the phrase ''.
    """
    shared = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)

    def counted(lang: bytes, known: defaultdict, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        vocabulary, codes = pa.array(list(known), pa.large_binary()), word_codes(known)

        def wanted(k: int, ends: np.ndarray) -> np.ndarray:
            bitmap, bits = shared.value
            place = sieve_place(lang, spelled(vocabulary, words, ends, k).to_pylist(), bits)
            return (bitmap[place >> 3] >> (place & 7)) & 1 > 0

        automaton = ShardAutomaton(words, max(lengths), None if shared is None else wanted)
        if shared is None:
            yield row(lang, [0], [b""], [np.zeros(1, np.int32)], [np.array([np.count_nonzero(words)], np.int64)])
        for k in lengths:
            ends, times = automaton.phrases(k)
            bucket = (phrase_codes(codes, words, ends, k) >> np.uint64(16)).astype(np.int64) % buckets
            order = np.argsort(bucket)
            ends, times, bucket = ends[order], times[order].astype(np.int64), bucket[order]
            text = spelled(vocabulary, words, ends, k)
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2] or b"")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
            pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            for some in range(0, len(pairs), 64):
                part = pairs[some : some + 64]
                yield row(lang, [int(bucket[a]) for a, _ in part], [bytes(data[at[a] : at[b]]) for a, b in part], [np.diff(at[a : b + 1]).astype(np.int32) for a, b in part], [times[a:b] for a, b in part])

    def row(lang: bytes, bucket: list[int], phrases: list[bytes], sizes: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(bucket), pa.string()), pa.array(bucket, pa.int64()), pa.array(phrases, pa.binary()), pa.array([x.tobytes() for x in sizes], pa.binary()), pa.array([x.tobytes() for x in times], pa.binary())], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> defaultdict:
            known = defaultdict(count().__next__)
            known[BARRIER]  # is number 0
            return known

        known, read, size = defaultdict(empty), defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(as_bytes(batch.column("lang")), as_bytes(batch.column("text")), strict=True):
                key, raw = lang.as_py(), text.as_py()
                words = words_and_barriers(raw)
                read[key].append(np.fromiter(map(known[key].__getitem__, words), np.int32, len(words)))
                size += len(raw)
                if size >= shard_bytes:
                    for key in list(read):
                        yield from counted(key, known.pop(key), np.concatenate(read.pop(key)))
                    size = 0
        for key in list(read):
            yield from counted(key, known.pop(key), np.concatenate(read.pop(key)))

    return docs.mapInArrow(run, "lang string, bucket long, phrases binary, sizes binary, times binary")


def reduced(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f: the sums over all shards that reach `least`, and those of the phrase ''."""

    def run(key, table):
        sizes, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("sizes", np.int32), ("times", np.int64)))
        at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        data = b"".join(table.column("phrases").to_pylist())
        phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
        sums = pa.table({"phrase": phrases, "f": times}).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
        kept = sums.filter(pc.or_(pc.greater_equal(sums.column("f_sum"), least), pc.equal(sums.column("phrase"), pa.scalar(b"", pa.large_binary()))))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(kept), pa.string()), "phrase": kept.column("phrase").cast(pa.large_string()).cast(pa.string()), "f": kept.column("f_sum")})

    return rows.groupBy("lang", "bucket").applyInArrow(run, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, *, max_words: int = 3, least: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, phrase, f of all phrases that occur `least` times or more in their language; with phrase '' all words' number."""
    # Buckets follow the bytes of text, so that each fits a task's memory.
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    found = settle(reduced(shard_counts(docs, tuple(range(1, min(2, max_words) + 1)), buckets, None, shard_bytes), least), "phrases")
    for k in range(3, max_words + 1):
        longer = settle(reduced(shard_counts(docs, (k,), buckets, sieve_of(found.where("phrase <> ''")), shard_bytes), least), "phrases")
        found = found.unionByName(longer)
    return found


def first_words(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def last_words(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), -k)


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two words or more.

    a, l, r: how often the phrase, its first part and its last part occur, where the cut is the one
    with the lowest score, floor(10**6 * a * a / (l * r)); n: all words of the language. A phrase
    goes if a longer one that holds it occurs at least `share` times in a hundred of its own.
    """
    asked = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    frequent = frequent_phrases(asked, max_words=max_words, least=least, shard_bytes=shard_bytes)
    counted = frequent.where("phrase <> ''")
    words = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    candidates = counted.withColumn("k", words).where("k >= 2")
    # Only what one word more gives counts: phrases longer still are no more frequent than those between.
    whole = F.col("k")
    shorter = candidates.where("k >= 3").select("lang", F.explode(F.array(last_words(F.col("phrase"), whole - 1), first_words(F.col("phrase"), whole - 1))).alias("phrase"), "f")
    held = shorter.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), whole - 1)).alias("cut"))
    parts = cuts.select("*", first_words(F.col("phrase"), F.col("cut")).alias("first"), last_words(F.col("phrase"), F.col("k") - F.col("cut")).alias("rest"))
    firsts = counted.select(F.col("lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = counted.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = {x: F.col(x).cast("decimal(19,0)") for x in "alr"}
    both = parts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * (wide["a"] * wide["a"]), "down": wide["l"] * wide["r"]})
    scored = both.select("lang", "phrase", "a", F.struct(F.expr("up div down").alias("score"), "cut", "l", "r").alias("way"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min("way").alias("way")).select("lang", "phrase", "a", "way.l", "way.r", "way.score")
    # A language's best of its best: no task sorts all its phrases.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for parting in ([F.pmod(F.xxhash64("phrase"), F.lit(64))], [F.pmod(F.xxhash64("phrase"), F.lit(8))], []):
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", *parting).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
