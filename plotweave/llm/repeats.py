"""Removal of byte strings that an earlier document has: suffixes are radix-sorted down to the threshold depth.

Every suffix of `depth` bytes (a window) is assigned by its most significant digit: its anchor, the
16-byte string in it with the least hash. Equal windows have equal anchors at equal places, so each
pass works on one anchor's windows alone. Windows in a row with one anchor are a unit; units with
equal text are one from the first pass on, and an anchor that only one document has is dropped
before any text moves. A unit that an earlier document has goes whole. Where an anchor has several
units, their first documents' texts are split on by passes of eight bytes, from the first to the
last, groups of one document going at each pass; the groups that are left at the threshold depth
are exactly the repeated windows, and none is sorted any deeper.

What is shuffled: per anchor (one in 18 bytes) about 20 bytes; the documents once, by id, which both
later joins use; and texts of units that differ around one anchor. Anchors that a large share of
very many documents has are not gathered: they go row by row through sums of first documents and
joins, which Spark splits where they are uneven.

Defined cases: null is an empty text; texts shorter than the depth lose nothing; a null id is not
before or after any other, so its row loses nothing and removes nothing; rows that share an id do
not remove from each other, each being judged against smaller ids: their different texts are numbered,
up to MOST_TEXTS of one id; ids are integers, or strings that spell one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import as_bytes, flat, settle, slices

ANCHOR = 16
#: A unit is of up to 2 * depth - 16 bytes, which 12 bits count.
MOST_DEPTH = 2000
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 8 << 20
#: A range is one number: the number of a text among those of its id, where it starts (texts have less than 2 GB), its length.
MARK_BITS, PLACE_BITS, SIZE_BITS = 20, 31, 12
MOST_TEXTS = 1 << MARK_BITS
#: With more documents than this, anchors that HOT_SHARE of a sample of documents has take the way by rows.
#: The sample routes rows only; either way gives the same result.
HOT, HOT_SHARE, HOT_SAMPLE = 400_000, 0.01, 64


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = x * np.uint64(by)
    x ^= x >> np.uint64(29)
    return x


def windows(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, in texts laid end to end: text, first window, number of windows, anchor's hash.

    Places count from the start of the whole.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - depth + 1
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    code = data.astype(np.uint64)
    for step in (1, 2, 4):
        code = code[:-step] | code[step:] << np.uint64(8 * step)
    hashed = _mixed(_mixed(code[:-8], 0x9E3779B97F4A7C15) + code[8:], 0xC2B2AE3D27D4EB4F)
    # The least hash wins, the first one of equals; its place is in the low half.
    least = (hashed >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashed), dtype=np.uint64)
    reach, span = depth - ANCHOR + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: n], least[reach - span : reach - span + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at), 0))[:n]
    whole = np.arange(n) + depth <= at[text + 1]
    starts = np.flatnonzero(whole & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1])))
    ends = np.flatnonzero(whole & np.concatenate(((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~whole[1:], [True]))) + 1
    return text[starts], starts, ends - starts, _mixed(hashed[anchor[starts]], 0xD6E8FEB86659FD93)


def _planes(x: np.ndarray, size: int) -> bytes:
    """Integers as planes of bytes, the lowest first, `size` of them: alike bytes lie together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :size].T.tobytes()


def _unplaned(raw: bytes, size: int, kind) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    wide = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    wide[:, :size] = planes.T
    return wide.view(kind).ravel()


def _parts(batch: pa.RecordBatch, depth: int):
    """Documents, their marks, and the units of a batch: text, start, windows, anchor, and hash of the unit's text."""
    column = as_bytes(batch.column("text"))
    data, at = flat(column)
    text, start, n, key = windows(data, at, depth)
    return batch.column("doc").to_numpy(), batch.column("mark").to_numpy(), data, at, text, start, n, key


def _hashes(data: np.ndarray, start: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    return np.array([digest(whole[a:b]) for a, b in zip(start.tolist(), (start + n + depth - 1).tolist(), strict=True)], np.uint64)


def _rows(bucket: np.ndarray, buckets: int, doc: np.ndarray, marks: np.ndarray, text: np.ndarray, columns) -> pa.RecordBatch | None:
    """Units dealt to buckets: per bucket one row of packed columns, documents and marks once for each run of a text."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        mine = order[cut[b] : cut[b + 1]]
        first = np.flatnonzero(np.diff(text[mine], prepend=-1))
        owner = text[mine[first]]
        counts = np.diff(np.append(first, len(mine))).astype(np.int32)
        rows.append({"bucket": b, "docs": doc[owner].tobytes(), "marks": marks[owner].astype(np.uint32).tobytes(), "counts": counts.tobytes()} | columns(mine))
    return pa.RecordBatch.from_pylist(rows, schema=ROWS) if rows else None


ROWS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "marks", "counts", "keys", "units", "places", "sizes", "texts"))])
ROWS_DDL = "bucket int, docs binary, marks binary, counts binary, keys binary, units binary, places binary, sizes binary, texts binary"


def _unpacked(table) -> tuple[np.ndarray, ...]:
    """docs, marks, keys, places, sizes of a bucket's rows."""
    counts = [np.frombuffer(c.as_py(), np.int32) for c in table.column("counts")]
    each = lambda c, kind: np.concatenate([np.repeat(np.frombuffer(x.as_py(), kind), k) for x, k in zip(table.column(c), counts, strict=True)])
    planes = lambda c, size, kind: np.concatenate([_unplaned(x.as_py(), size, kind) for x in table.column(c)])
    return each("docs", np.int64), each("marks", np.uint32), planes("keys", 6, np.uint64), planes("places", 5, np.int64), planes("sizes", 2, np.int64)


def _anchors(depth: int, buckets: int, hot: np.ndarray):
    """Packed units of all documents but those with hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            doc, marks, data, at, text, start, n, key = _parts(batch, depth)
            if len(hot):
                use = ~np.isin(key & KEY_BITS, hot)
                text, start, n, key = text[use], start[use], n[use], key[use]
            unit, place = _hashes(data, start, n, depth), (start - at[text]).astype(np.int64)
            out = _rows((_mixed(key, 0xA0761D6478BD642F) >> np.uint64(32)).astype(np.int64) % buckets, buckets, doc, marks, text, lambda m: {"keys": _planes(key[m], 6), "units": unit[m].tobytes(), "places": _planes(place[m], 5), "sizes": _planes(n[m].astype(np.int64), 2), "texts": None})
            if out is not None:
                yield out

    return run


#: Anchors travel as the low 48 bits of their hashes; the rest of the bits chose the bucket.
KEY_BITS = np.uint64((1 << 48) - 1)


def _sorted_out(depth: int):
    """Of one bucket: ranges that go whole (key is null), and first occurrences of units whose anchor has others."""

    def run(group, table):
        docs, marks, keys, places, sizes = _unpacked(table)
        units = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("units")])
        order = np.lexsort((docs, units, keys))
        docs, marks, keys, places, sizes, units = (x[order] for x in (docs, marks, keys, places, sizes, units))
        new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
        new_unit = new_key | np.concatenate(([True], units[1:] != units[:-1]))
        at_unit, of_unit = np.flatnonzero(new_unit), np.cumsum(new_unit) - 1
        first = docs[at_unit][of_unit]
        at_key, of_key = np.flatnonzero(new_key), np.cumsum(new_key) - 1
        several = (np.add.reduceat(new_unit.astype(np.int64), at_key) > 1) & (np.minimum.reduceat(docs, at_key) < np.maximum.reduceat(docs, at_key))
        whole, look = docs > first, (docs == first) & several[of_key]
        none = np.zeros(int(whole.sum()), bool)
        key = np.concatenate((np.zeros(len(none), np.int64), keys[look].view(np.int64)))
        mask = np.concatenate((~none, np.zeros(int(look.sum()), bool)))
        value = _packed(marks, places, sizes + depth - 1)
        return pa.table({"doc": np.concatenate((docs[whole], docs[look])), "value": np.concatenate((value[whole], value[look])), "key": pa.array(key, mask=mask)})

    return run


def _asked(batches: Iterator[pa.RecordBatch], depth: int):
    """Documents with the units that are asked for: row of the batch, mark, start, windows, anchor."""
    for batch in slices(batches, "text", 2 << 20):
        column = as_bytes(batch.column("text"))
        data, at = flat(column)
        marks = batch.column("mark").to_numpy().astype(np.int64)
        asked = batch.column("asked")
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.append(0, np.cumsum([len(x) for x in asked]))))
        flat_asked = asked.flatten()
        value, key = (np.asarray(flat_asked.field(k)) for k in (0, 1))
        mark, place, size = _unpacked_range(value)
        own = mark == marks[row]
        row, key = row[own], key[own]
        yield batch, data, at, marks, row, at[row] + place[own], size[own] - depth + 1, key.astype(np.int64).view(np.uint64)


def _texts(depth: int, buckets: int):
    """The texts of the asked units, in buckets of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at, marks, row, start, n, key in _asked(batches, depth):
            whole, place = data.tobytes(), (start - at[row]).astype(np.int64)
            spread = _mixed(key, 0x9E3779B97F4A7C15) >> np.uint64(32)
            texts = lambda m: b"".join([whole[a:b] for a, b in zip(start[m].tolist(), (start + n + depth - 1)[m].tolist(), strict=True)])
            out = _rows(spread.astype(np.int64) % buckets, buckets, batch.column("doc").to_numpy(), marks, row, lambda m: {"keys": _planes(key[m], 6), "units": None, "places": _planes(place[m], 5), "sizes": _planes(n[m].astype(np.int64), 2), "texts": texts(m)})  # noqa: B023
            if out is not None:
                yield out

    return run


def _packed(mark: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A removed range of a document in one number: the text's mark, where it starts, its length."""
    return (mark.astype(np.int64) << (PLACE_BITS + SIZE_BITS)) | (start.astype(np.int64) << SIZE_BITS) | size.astype(np.int64)


def _unpacked_range(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return value >> (PLACE_BITS + SIZE_BITS), value >> SIZE_BITS & ((1 << PLACE_BITS) - 1), value & ((1 << SIZE_BITS) - 1)


def radix_groups(texts: np.ndarray, places: np.ndarray, group: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """The least doc that has each window's text, by passes from the first bytes to the last.

    texts: all bytes, windows start at places; group: what parts them so far. A group of one
    document is not sorted any further: its windows keep their own doc.
    """
    least = doc.copy()
    live = np.arange(len(places))
    for done in range(0, depth, 8):
        if not len(live):
            break
        digit = np.zeros(len(live), np.uint64)
        for k in range(min(8, depth - done)):
            digit |= texts[places[live] + done + k].astype(np.uint64) << np.uint64(8 * (7 - k))
        order = np.lexsort((digit, group[live]))
        live, digit = live[order], digit[order]
        new = np.flatnonzero(np.concatenate(([True], (digit[1:] != digit[:-1]) | (group[live[1:]] != group[live[:-1]]))))
        size = np.diff(np.append(new, len(live)))
        group[live] = np.repeat(np.arange(len(new)), size)
        d = doc[live]
        low = np.minimum.reduceat(d, new)
        keep = np.repeat(low < np.maximum.reduceat(d, new), size)
        if done + 8 >= depth:
            least[live] = np.repeat(low, size)
        live = live[keep]
    return least


def _ranges(depth: int):
    """Ranges of one bucket's units that earlier documents have in part."""

    def run(group, table):
        docs, marks, keys, places, sizes = _unpacked(table)
        texts = np.frombuffer(b"".join(x.as_py() for x in table.column("texts")), np.uint8)
        length = sizes + depth - 1
        row = np.repeat(np.arange(len(docs)), sizes)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = (np.cumsum(length) - length)[row] + inner
        _, which = np.unique(keys, return_inverse=True)
        gone = radix_groups(texts, at, which[row].copy(), docs[row], depth) < docs[row]
        edge = np.concatenate(([True], row[1:] != row[:-1]))
        starts = np.flatnonzero(gone & (edge | ~np.concatenate(([False], gone[:-1]))))
        ends = np.flatnonzero(gone & np.concatenate((edge[1:] | ~gone[1:], [True])))
        return pa.table({"doc": docs[row[starts]], "value": _packed(marks[row[starts]], places[row[starts]] + inner[starts], ends - starts + depth)})

    return run


def _hot_keys(known: DataFrame, depth: int, hot: int) -> np.ndarray:
    """Anchors that a large share of documents has: at most as many as documents have anchors, over that share."""
    if known.count() <= hot:
        return np.zeros(0, np.uint64)
    sample = known.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(HOT_SAMPLE if hot >= HOT else 1)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            _, _, _, _, text, _, _, key = _parts(batch, depth)
            both = np.unique(np.stack(((key & KEY_BITS).view(np.int64), text)), axis=1)
            found, n = np.unique(both[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": found, "n": n})

    counts = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(2, HOT_SHARE * sample.count())
    return np.array(sorted(r["key"] for r in counts.where(F.col("n") >= least).collect()), np.int64).view(np.uint64)


def _hot_units(depth: int, hot: np.ndarray):
    """Each unit with a hot anchor as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            doc, marks, data, at, text, start, n, key = _parts(batch, depth)
            use = np.isin(key & KEY_BITS, hot)
            text, start, n, key = text[use], start[use], n[use], key[use] & KEY_BITS
            value = _packed(marks[text], start - at[text], n + depth - 1)
            yield pa.RecordBatch.from_pydict({"doc": doc[text], "key": key.view(np.int64), "unit": _hashes(data, start, n, depth).view(np.int64), "value": value})

    return run


def _hot_windows(depth: int):
    """Each window of the asked units under the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at, marks, row, start, n, _ in _asked(batches, depth):
            whole, owner = data.tobytes(), np.repeat(row, n)
            begin = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashed = [hashlib.blake2b(whole[s : s + depth], digest_size=16).digest() for s in begin.tolist()]
            yield pa.RecordBatch.from_pydict({"window": pa.array(hashed, pa.binary()), "doc": batch.column("doc").to_numpy()[owner], "value": _packed(marks[owner], begin - at[owner], np.full(len(begin), depth))})

    return run


def covered(values: list[int] | None, mark: int, size: int) -> np.ndarray:
    """Which bytes of a text of that size the ranges with its mark cover."""
    edges = np.zeros(size + 1, np.int64)
    marks, start, length = _unpacked_range(np.array(values or [], np.int64))
    start, length = start[marks == mark], length[marks == mark]
    np.add.at(edges, start, 1)
    np.add.at(edges, np.minimum(start + length, size), -1)
    return np.cumsum(edges[:-1]) > 0


def marked(docs: DataFrame) -> DataFrame:
    """The documents (doc, text) with `mark`, the number of a text among the different ones of its id.

    Ids have one text each as a rule, and then no text moves. Otherwise the texts are told apart by
    two hashes of 64 bits, numbered, and met by their hashes; the table is written once.
    """
    repeated = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    if repeated.isEmpty():
        return docs.withColumn("mark", F.lit(0))
    both = docs.withColumns({"one": F.xxhash64(F.coalesce("text", F.lit(""))), "two": F.xxhash64(F.octet_length(F.coalesce("text", F.lit(""))), F.reverse(F.coalesce("text", F.lit(""))))})
    several = both.join(repeated, "doc", "left_semi").select("doc", "one", "two").distinct()
    place = F.row_number().over(W.partitionBy("doc").orderBy("one", "two")) - 1
    few = F.when(place < MOST_TEXTS, place).otherwise(F.raise_error(F.lit(f"an id has more than {MOST_TEXTS} different texts")).cast("int"))
    numbers = several.select("doc", "one", "two", few.alias("mark"))
    return settle(both.join(numbers, ["doc", "one", "two"], "left").select("doc", "text", F.coalesce("mark", F.lit(0)).alias("mark")), "marked")


def repeated_ranges(docs: DataFrame, *, depth: int = 50, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, text, mark) that have an id, and (doc, value) rows of what they lose."""
    if not ANCHOR < depth <= MOST_DEPTH:
        raise ValueError(f"depth is over {ANCHOR} and at most {MOST_DEPTH}")
    known = marked(docs.where(F.col("doc").isNotNull()))
    # Buckets follow the bytes of text, so that each fits a task's memory whatever the number of partitions.
    buckets = min((1 << 31) - 1, 1 + (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    hot_keys = _hot_keys(known, depth, hot)
    rows = known.mapInArrow(_anchors(depth, buckets, hot_keys), ROWS_DDL)
    found = settle(rows.groupBy("bucket").applyInArrow(_sorted_out(depth), "doc long, value long, key long"), "anchors")

    def with_asked(units: DataFrame) -> DataFrame:
        asked = units.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("value", "key")).alias("asked"))
        return known.join(asked, F.col("doc") == F.col("_doc")).select("doc", "text", "mark", "asked")

    parts = with_asked(found.where("key is not null")).mapInArrow(_texts(depth, buckets), ROWS_DDL)
    ranges = found.where("key is null").select("doc", "value").unionByName(parts.groupBy("bucket").applyInArrow(_ranges(depth), "doc long, value long"))
    if len(hot_keys):
        units = settle(known.mapInArrow(_hot_units(depth, hot_keys), "doc long, key long, unit long, value long"), "hot-units")
        first = units.groupBy(F.col("key").alias("_key"), F.col("unit").alias("_unit")).agg(F.min("doc").alias("_first"))
        several = first.groupBy(F.col("_key").alias("_several")).agg(F.count("*").alias("_n")).where("_n > 1").select("_several")
        met = units.join(first, (F.col("key") == F.col("_key")) & (F.col("unit") == F.col("_unit")))
        looked = met.where("doc = _first").join(F.broadcast(several), F.col("key") == F.col("_several"), "left_semi")
        each = settle(with_asked(looked).mapInArrow(_hot_windows(depth), "window binary, doc long, value long"), "hot-windows")
        least = each.groupBy(F.col("window").alias("_window")).agg(F.min("doc").alias("_least"), F.max("doc").alias("_most")).where("_least < _most")
        ranges = ranges.unionByName(met.where("doc > _first").select("doc", "value")).unionByName(each.join(least, F.col("window") == F.col("_window")).where("doc > _least").select("doc", "value"))
    return known, ranges


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (array of start, stop), kept (binary): whole texts without what earlier documents have."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    known, ranges = repeated_ranges(plain, depth=depth, hot=hot)
    lost = ranges.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("value").alias("values"))
    both = known.join(lost, F.col("doc") == F.col("_doc"), "left").select("doc", "text", "mark", "values")
    both = both.unionByName(plain.where(F.col("doc").isNull()).withColumns({"mark": F.lit(0), "values": F.lit(None).cast("array<long>")}))
    schema = pa.schema([(doc_id, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc, raw, mark, values in zip(batch.column("doc").to_pylist(), as_bytes(batch.column("text")), batch.column("mark").to_pylist(), batch.column("values").to_pylist(), strict=True):
                raw = raw.as_py()
                gone = covered(values, mark, len(raw))
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edge) else raw
                out.append({doc_id: doc, "n_bytes": len(raw), "n_removed": int(gone.sum()), "removed": [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()], "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return both.mapInArrow(run, f"`{doc_id}` long, n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, kept binary")
