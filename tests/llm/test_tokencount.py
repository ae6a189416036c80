import random
import sys

import pytest

from plotweave.llm import pretokens, tokencount
from plotweave.llm.queries import tokenizer_path

ODD = ["it's", "we'LL", "Ünder", "x1²", "12 345", "a,b", "end.", "\n\n", " \n x", "\t", "é", "<|endoftext|>", "日本語", "՘", "𐵰", "a b", "​", "\x00", "🙂" * 5, "zq" * 200, "…", "　"]


def library(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    return [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("entries", [0, 8, 65536])
def test_counts_are_the_librarys(spark, documents, name, entries):
    rng = random.Random(entries)
    texts = [" ".join(rng.choice([*ODD, "the", "quick", "over"]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", " ", "  two  spaces ", "long word " * 30_000, "x" * 20_000]
    rows = list(enumerate(texts)) + [(7, "again"), (None, "no id"), (9_000, None)]
    out = tokencount.token_counts(documents(rows).repartition(5), tokenizer_path(name), entries=entries)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len((t or "").encode()), n, n > 512) for (k, t), n in zip(rows, library(tokenizer_path(name), [t or "" for _, t in rows]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


def test_empty_table_string_ids_and_clashing_columns(spark, documents):
    assert tokencount.token_counts(documents([]), tokenizer_path()).count() == 0
    odd = spark.createDataFrame([("a", "one two", 5, 6)], "doc_id string, text string, n_tokens int, N_BYTES int")
    assert [tuple(r) for r in tokencount.token_counts(odd, tokenizer_path(), limit=1).collect()] == [("a", 7, 2, True)]


def test_cut_agrees_with_the_library_on_assigned_code_points():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    cutter, pre = pretokens.Cutter(tokenizer), tokenizer.pre_tokenizer.pre_tokenize_str
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    chars = [c for c in chars if ord(c) < 0x20000 and not cutter.whole(c)]
    for k in range(0, len(chars), 512):
        s = "".join(f"a{c}1{c}, {c}{c} x" for c in chars[k : k + 512])
        assert [s[a:b] for _, (a, b) in pre(s)] == cutter.pre_tokens(s)


def test_sampled_partitions_are_few_and_spread():
    taken = [p for p in range(100_000) if tokencount.is_sampled(p)]
    assert taken[:20] == list(range(20)) and len(taken) <= 17 * 16 and max(taken) > 90_000
    assert pretokens.is_plain(tokenizer_path()) and not pretokens.is_plain(tokenizer_path("word_bpe_49k.json")) and not pretokens.is_plain(tokenizer_path("piece_bpe_32k.model"))


def test_first_tier_is_bounded(spark, documents):
    docs = documents([(k, f"the cat {k} sat on the mat " + "y" * 50) for k in range(100)])
    first = tokencount.frequent_lengths(docs, tokenizer_path(), entries=5)
    assert len(first) == 5 and first["the"] == 1
