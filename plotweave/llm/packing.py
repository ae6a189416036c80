"""Token ids as fixed-width bit-packed blocks, written and read back as a table of binary blocks.

File format. A token file is a Parquet table with one row per block; a block holds whole
documents in order, `bits` bits for each id, the least vocabulary bits that fit, the first id in
the lowest bits of the payload's first byte. `ends` are the ids of the block up to each document's
end (little-endian int64), `keys` the document ids (int64; the first `n_null` of a block are null), so any document is found by one
subtraction and any id by one multiplication; `shard` and `block` give the order, and `before` the
ids of the shard in front of the block. Blocks unpack with numpy alone, without a loop over ids.

Defined cases: ids are integers, of any width up to 64 bits, or strings that spell one; a null or empty text gives the end id only; rows that repeat a document id follow
each other by their texts; a null document id comes first and is read back as null; a document longer than a block is a block of its own; an empty table gives no block.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import shared_dir, without_collector
from plotweave.llm.pretokens import BYTE_SIGNS, Cutter, is_plain

BLOCK_IDS = 1 << 18
#: How many pieces of text, and pre-tokens, a worker remembers the ids of: the first ones, which all frequent ones are among.
REMEMBERED_PIECES, REMEMBERED_TOKENS = 500_000, 900_000
#: What stands for a blank; the other printable ASCII characters stand for themselves.
BLANK_SIGN = BYTE_SIGNS[32]
BLOCK_SCHEMA = "shard int, block int, before long, n_docs int, n_null int, n_ids long, bits int, keys binary, ends binary, payload binary"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a payload, as uint32; only their bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-stop * bits // 8)
    lead = start * bits - first * 8
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")[lead : lead + (stop - start) * bits]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :bits] = flags.reshape(-1, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the pre-tokens above, remembering what it has encoded.

    No pre-token reaches over the start of a space between two other characters, so a text is cut
    before each such space. Pieces that are new are cut into pre-tokens, and only new pre-tokens
    are encoded. Texts with two white-space characters in a row are encoded as a whole, and so are
    texts that hold the content of an added token, which the tokenizer finds before it cuts, and all
    texts where the file is none whose pre-tokens are encoded on their own (pretokens.is_plain).
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.pieces: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.double = re.compile(r"\s\s").search
        self.cutter = Cutter(self.tokenizer) if is_plain(path) else None
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")

    def _pre_tokens(self, piece: str) -> list[str]:
        """What the pattern finds; words, alone or before one mark, need no search for it."""
        word = piece[1:]
        if word.isalpha() and piece[0] == " ":
            return [piece]
        if word[:-1].isalpha() and piece[0] == " " and word[-1] in ".,;:!?":
            return [piece[:-1], word[-1]]
        return self.cutter.pre_tokens(piece)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        # Code points without a class are left to the library, piece by piece.
        odd = [] if self.cutter.classed("".join(pieces)) else [p for p in pieces if not self.cutter.classed(p)]
        whole = dict(zip(odd, (array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch(odd, add_special_tokens=False)), strict=True))
        if odd:
            rest = [p for p in pieces if p not in whole]
            whole |= dict(zip(rest, self._learn(rest), strict=True))
            return [whole[p] for p in pieces]
        cut = [[p] if p[:1] == " " and p[1:].isalpha() else self._pre_tokens(p) for p in pieces]
        model, code, tokens = self.tokenizer.model.tokenize, self.code, self.tokens
        new = tokens if len(tokens) < REMEMBERED_TOKENS else {}
        for t in {t for c in cut for t in c if t not in tokens}:
            # A pre-token goes to the model as the tokenizer's byte-level step would hand it over.
            signs = t.replace(" ", BLANK_SIGN) if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(BYTE_SIGNS)
            new[t] = array(code, [x.id for x in model(signs)]).tobytes()
        get = tokens.__getitem__ if new is tokens else lambda t: new.get(t) or tokens[t]
        return [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of the smallest kind that holds the vocabulary."""
        # A text's first piece has no space in front; a line feed, which no other piece starts with, tells it apart.
        parts = [None if self.cutter is None or self.cutter.holds_added(t) or self.double(t) else f"\n{t}".split(" ") for t in texts]
        found = [None if p is None else list(map(self.pieces.get, p)) for p in parts]
        open_at = [[i for i, y in enumerate(f) if y is None] if f else () for f in found]
        new = list({p[i] for p, at in zip(parts, open_at, strict=True) for i in at})
        learnt = dict(zip(new, self._learn([x[1:] if x[:1] == "\n" else f" {x}" for x in new]), strict=True))
        if len(self.pieces) < REMEMBERED_PIECES:
            self.pieces.update(learnt)
        whole = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, parts, strict=True) if p is None], add_special_tokens=False))
        out = []
        for p, f, at in zip(parts, found, open_at, strict=True):
            if p is None:
                out.append(array(self.code, next(whole).ids).tobytes())
            else:
                for i in at:
                    f[i] = learnt[p[i]]
                out.append(b"".join(f))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """The encoder of a Python worker, which serves many tasks: what it has encoded helps the next."""
    return PieceEncoder(path)


def encode_blocks(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None, block_ids: int = BLOCK_IDS, vocab_size: int | None = None, keep_encoder: bool = True) -> DataFrame:
    """The blocks of the documents in ascending order of their ids; shard numbers follow that order.

    keep_encoder: what a worker has encoded helps its next task too, at the price of memory that it
    holds from then on; without it each task starts anew, which suits jobs that go on to other work.
    """
    tokens = vocab_size or _tokenizer(path).get_vocab_size()
    bits = bits_for(max(tokens, (end_id or 0) + 1))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), (_encoder if keep_encoder else PieceEncoder)(path)
        end = b"" if end_id is None else np.array([end_id], coder.kind).tobytes()
        width, block, before = np.dtype(coder.kind).itemsize, 0, 0
        keys, parts, n = [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), coder.kind)
            ends = np.cumsum([len(p) // width for p in parts])
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "before": before, "n_docs": len(keys), "n_null": keys.count(None), "n_ids": len(ids), "bits": bits, "keys": np.array([k or 0 for k in keys], "<i8").tobytes(), "ends": ends.astype("<i8").tobytes(), "payload": pack(ids, bits)}], schema=BLOCKS)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                with without_collector():
                    coded = coder.encode([x or "" for x in part.column(text).to_pylist()])
                for key, ids in zip(part.column(doc_id).to_pylist(), coded, strict=True):
                    keys.append(key)
                    parts.append(ids + end)
                    n += len(parts[-1]) // width
                    if n >= block_ids:
                        yield row()
                        block, before, keys, parts, n = block + 1, before + n, [], [], 0
        if keys:
            yield row()

    ordered = docs.select(F.col(doc_id).cast("long").alias(doc_id), text).repartitionByRange(doc_id).sortWithinPartitions(doc_id, text)
    return ordered.mapInArrow(blocks, BLOCK_SCHEMA)


BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("keys", pa.binary()), ("ends", pa.binary()), ("payload", pa.binary())])
#: A block that holds a document, and which of its ids are the document's.
HELD = pa.schema([("bits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, to: str | None = None, **named) -> str:
    """Writes the token file of the documents and returns where it is; `to` must be new."""
    to = to or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    encode_blocks(docs, path, **named).write.option("compression", "none").parquet(to)
    return to


def read_blocks(spark: SparkSession, at: str) -> DataFrame:
    """The blocks of a token file with the ids of all blocks in front of each, `first`."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(at)
    # One row for each shard, of which there are as many as the file was written by tasks.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = sizes.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("base"))
    return blocks.join(F.broadcast(base), "shard").withColumn("first", F.col("base") + F.col("before"))


def read_documents(spark: SparkSession, at: str, *, doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of a token file: where it starts, its ids' number and CRC-32, and on demand its ids."""
    schema = pa.schema([(doc_id, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ends = (np.frombuffer(batch.column(c)[r].as_py(), "<i8") for c in ("keys", "ends"))
                payload, bits, first = batch.column("payload")[r].as_py(), batch.column("bits")[r].as_py(), batch.column("first")[r].as_py()
                ids = unpack(payload, bits, 0, int(ends[-1])).astype("<u4")
                starts = np.concatenate(([0], ends[:-1]))
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(keys, mask=np.arange(len(keys)) < batch.column("n_null")[r].as_py()), pa.array(starts + first), pa.array(ends - starts), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = f"`{doc_id}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return read_blocks(spark, at).select("keys", "ends", "payload", "bits", "first", "n_null").mapInArrow(documents, ddl)


def document_ids(spark: SparkSession, at: str, key: int) -> np.ndarray:
    """Random access: the ids of one document; all other blocks are passed over by their `keys` alone."""
    hit = read_blocks(spark, at).mapInArrow(_holding(key), "bits int, start long, stop long, payload binary").first()
    return np.zeros(0, np.uint32) if hit is None else unpack(bytes(hit["payload"]), hit["bits"], hit["start"], hit["stop"])


def _holding(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ends = (np.frombuffer(batch.column(c)[r].as_py(), "<i8") for c in ("keys", "ends"))
                for i in np.flatnonzero((keys == key) & (np.arange(len(keys)) >= batch.column("n_null")[r].as_py()))[:1].tolist():
                    yield pa.RecordBatch.from_pylist([{"bits": batch.column("bits")[r].as_py(), "start": int(ends[i - 1]) if i else 0, "stop": int(ends[i]), "payload": batch.column("payload")[r].as_py()}], schema=HELD)

    return run
