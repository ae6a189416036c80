"""How many tokens texts have: a map-side lookup in two tiers, without a shuffle of pre-tokens.

The first tier is a table of the most frequent pre-tokens (with their blank, and the mark that may
follow) and their lengths in tokens, which is broadcast: at most `entries` of at most LONGEST_KEY characters each, so at most a few megabytes
whatever the corpus. It is made from the first texts of a few partitions, spread over the input;
what is in it changes how fast texts are counted, never the counts. The second tier is a bounded
cache in each Python worker: a pre-token that neither tier has is encoded by the library's model
and remembered there. Documents stay in their partitions.

Files whose texts cannot be cut (pretokens.is_plain), `.model` files, and single texts that cannot
are encoded whole by their library.

Defined cases: a null text counts as empty, with no bytes and no tokens; a null id stays null;
repeated rows are each counted; an empty table gives no rows; texts of any length are counted
whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import without_collector
from plotweave.llm.pretokens import Cutter, as_signs, is_plain

#: Entries of the broadcast table, the characters of a key, and the pre-tokens that a worker remembers; beyond, it starts anew.
ENTRIES, LONGEST_KEY, REMEMBERED = 1 << 16, 32, 500_000
#: Of how many partitions, for each power of two of partition numbers, the table's texts come, how many texts of each, and characters of a text.
SAMPLED_PER_OCTAVE, SAMPLED_ROWS, SAMPLED_CHARS = 16, 256, 20_000
#: The most frequent pre-tokens that one sampled partition hands in.
HANDED_IN = 4096


@lru_cache(maxsize=2)
def _library(path: str):
    """The file's tokenizer, and its function from texts to lists of tokens or ids."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return pieces, lambda texts: pieces.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, lambda texts: tokenizer.encode_batch(texts, add_special_tokens=False)


class TokenCounter:
    """Counts tokens of texts; keeps what it has encoded.

    No pre-token reaches over the start of a blank between two other characters, so a text without
    two characters of white space in a row is looked up by what lies between its blanks: mostly a
    pre-token with its blank, or that and a mark. Such a piece is cut further only if it is in neither tier.
    """

    def __init__(self, path: str):
        self.tokenizer, self.encode = _library(path)
        self.cutter = Cutter(self.tokenizer) if is_plain(path) else None
        self.seen: dict[str, int] = {}
        self.double = re.compile(r"\s\s").search

    def length(self, piece: str) -> int:
        """The tokens of a piece that begins where a pre-token does, by the library's merges of its pre-tokens."""
        known = self.seen.get(piece)
        if known is None:
            known = self._learnt(piece)
            if len(piece) <= 2 * LONGEST_KEY:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[piece] = known
        return known

    def _learnt(self, piece: str) -> int:
        if not self.cutter.classed(piece):
            return self._whole([piece])[0]
        pre_tokens = self.cutter.pre_tokens(piece)
        return sum(map(self.length, pre_tokens)) if len(pre_tokens) > 1 else len(self.tokenizer.model.tokenize(as_signs(piece)))

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        """The tokens of each text; `frequent` is the first tier, by pieces without the blank before them."""
        if self.cutter is None:
            return self._whole(texts)
        out, late = [], []
        for k, text in enumerate(texts):
            double = self.double(text)
            if self.cutter.holds_added(text) or double and not self.cutter.classed(text):
                late.append(k)
                out.append(0)
                continue
            if double:
                out.append(sum(map(self.length, self.cutter.pre_tokens(text))))
                continue
            pieces = text.split(" ")
            first = pieces.pop(0)
            found = list(map(frequent.get, pieces, repeat(0)))
            n = sum(found) + (self.length(first) if first else 0)
            if 0 in found:
                n += sum(self.length(f" {t}") for t, x in zip(pieces, found, strict=True) if not x)
            out.append(n)
        for k, n in zip(late, self._whole([texts[k] for k in late]), strict=True):
            out[k] = n
        return out

    def _whole(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):  # few texts at a time: encodings hold much more than ids
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) < 1 << 20:
                size, stop = size + len(texts[stop]), stop + 1
            out += [len(x) for x in self.encode(texts[at:stop])]
            at = stop
        return out


@lru_cache(maxsize=1)
def _counter(path: str) -> TokenCounter:
    """The counter of a Python worker, which serves many tasks."""
    return TokenCounter(path)


def is_sampled(partition: int, per_octave: int = SAMPLED_PER_OCTAVE) -> bool:
    """Evenly spread partition numbers, at most `per_octave` of those between one power of two and the next."""
    octave = 1 << max(partition.bit_length() - 1, 0)
    return (partition - octave) % max(1, octave // per_octave) == 0 if partition else True


def frequent_lengths(docs: DataFrame, path: str, *, text: str = "text", entries: int = ENTRIES) -> dict[str, int]:
    """The first tier: frequent pre-tokens of a bounded part of the texts, without their blank, with their lengths in tokens."""
    if not is_plain(path) or not entries:
        return {}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not is_sampled(TaskContext.get().partitionId()):
            return
        counter, seen, rows = _counter(path), Counter(), 0
        for batch in batches:
            for value in batch.column(0).slice(0, SAMPLED_ROWS - rows).to_pylist():
                part = (value or "")[:SAMPLED_CHARS]
                if not counter.cutter.holds_added(part) and not counter.double(part):
                    seen.update(t for t in part.split(" ")[1:] if len(t) <= LONGEST_KEY)
            rows += batch.num_rows
            if rows >= SAMPLED_ROWS:
                break
        top = seen.most_common(HANDED_IN)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([counter.length(f" {t}") for t, _ in top], pa.int64())], names=["pre_token", "n", "length"])

    total, lengths = Counter(), {}
    for batch in docs.select(text).mapInArrow(sample, "pre_token string, n long, length long").toArrow().to_batches():
        for t, n, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[t] += n
            lengths[t] = length
    return {t: lengths[t] for t, _ in islice(sorted(total.items(), key=lambda x: (-x[1], x[0])), entries)}


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512, entries: int = ENTRIES) -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, and over_limit, whether it has more than `limit` tokens."""
    asked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(asked, path, entries=entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, frequent = _counter(path), shared.value
        for batch in batches:
            with without_collector():
                counts = counter.count(batch.column("text").to_pylist(), frequent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = asked.withColumn("n_bytes", F.octet_length("text").cast("long"))
    key = asked.schema["doc_id"].dataType.simpleString()
    counted = sized.mapInArrow(run, f"doc_id {key}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
