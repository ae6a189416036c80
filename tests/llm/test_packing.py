import random
import zlib

import numpy as np
import pytest

from plotweave.llm import packing as P
from plotweave.llm.queries import tokenizer_path


@pytest.mark.parametrize("vocab", [2, 3, 256, 257, 50_257, 70_000])
def test_round_trip_and_random_access(vocab):
    rng = np.random.default_rng(vocab)
    ids, bits = rng.integers(0, vocab, 1001), P.bits_for(vocab)
    packed = P.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and 2**bits >= vocab > 2 ** (bits - 1) or vocab == 2
    for a, b in ((0, 1001), (1000, 1001), (17, 17), (313, 700)):
        assert P.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


def test_files_against_the_tokenizer(spark, documents):
    rng = random.Random(1)
    words = ["the", "it's", "Ünder", "x1", "12", "a,b", "end.", "\n", "\n\n", " ", "é", "<|endoftext|>", "日本"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, " "), (103, "\nx \n y"), (5, "again"), (104, "long " * 20_000)]
    rng.shuffle(rows)
    at = P.write_tokens(documents(rows), tokenizer_path(), end_id=2, block_ids=500)
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in P.read_documents(spark, at).collect()}
    coder, start, want = P._tokenizer(tokenizer_path()), 0, {}
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, start] = (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert P.document_ids(spark, at, 102).tolist() == [*coder.encode(" ", add_special_tokens=False).ids, 2]
    assert len(P.document_ids(spark, at, 999)) == 0
    assert P.read_documents(spark, at, with_ids=True).where("doc_id = 101").first()["ids"] == [2]


def test_empty_table(spark, documents):
    assert P.read_documents(spark, P.write_tokens(documents([]), tokenizer_path())).count() == 0


def test_added_tokens_are_the_librarys(spark, documents):
    from tokenizers import Tokenizer

    texts = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b c", "two  spaces <|endoftext|>", "plain words"]
    fresh = Tokenizer.from_file(tokenizer_path())
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 1306]
    at = P.write_tokens(documents(list(enumerate(texts))), tokenizer_path())
    got = {r["doc_id"]: r["ids"] for r in P.read_documents(spark, at, with_ids=True).collect()}
    assert got == {k: fresh.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers_and_unassigned_code_points(spark, documents, name):
    from tokenizers import Tokenizer

    texts = ["the quick brown fox", "The  Quick\nfox", "a\u0558b \U00010975x", "\u0558", "plain again"]
    fresh = Tokenizer.from_file(tokenizer_path(name))
    at = P.write_tokens(documents(list(enumerate(texts))), tokenizer_path(name))
    got = {r["doc_id"]: r["ids"] for r in P.read_documents(spark, at, with_ids=True).collect()}
    assert got == {k: fresh.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_null_ids_and_the_least_one(spark, documents):
    at = P.write_tokens(documents([(None, "a b"), (-(1 << 63), "c"), (0, "d"), (None, None)]), tokenizer_path(), end_id=2)
    got = sorted(((r["start"], r["doc_id"]) for r in P.read_documents(spark, at).collect()))
    assert [d for _, d in got] == [None, None, -(1 << 63), 0]
    assert len(P.document_ids(spark, at, 0)) == len(P.document_ids(spark, at, -(1 << 63))) == 2


def test_a_full_memory_changes_nothing(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "REMEMBERED_PIECES", 3)
    monkeypatch.setattr(P, "REMEMBERED_TOKENS", 2)
    fresh, coder = Tokenizer.from_file(tokenizer_path()), P.PieceEncoder(tokenizer_path())
    for k in range(5):
        texts = [f"the cat {k} sat, on{k} the mat", f"dog{k} it's é ա the", "the", ""]
        assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
