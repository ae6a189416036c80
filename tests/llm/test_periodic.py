import hashlib
import random
import zlib

import numpy as np
import pytest

from plotweave.llm import periodic as P
from plotweave.llm.queries import op12_periodic_runs, repeated_words


def brute(words, least=12):
    """Every run by its definition: maximal stretches for each period, smallest period only."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(rng, n):
    out = []
    for _ in range(n):
        letters = rng.choice(["ab", "abc", "abcdefghij", "abcdefghijklmnopqrstuvwxyz"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at, size = rng.randint(0, len(words)), rng.randint(1, 20)
            words[at:at] = [rng.choice(letters) for _ in range(size)] * rng.randint(2, 6)
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    docs = sorted(([w.encode() for w in d] for d in texts(rng, 40)), key=len, reverse=True)
    doc, start, length, period = P.runs_of(docs)
    got = [[] for _ in docs]
    for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[d].append(tuple(r))
    assert got == [brute(d) for d in docs]


def test_small_pieces_of_the_grid_and_other_least_lengths(monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 7)
    rng = random.Random(99)
    docs = sorted(([w.encode() for w in d] for d in texts(rng, 12)), key=len, reverse=True)
    for least in (2, 3, 5, 12, 30):
        doc, start, length, period = P.runs_of(docs, least)
        got = sorted(zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True))
        assert got == [(d, *r) for d, words in enumerate(docs) for r in brute(words, least)]


def test_fibonacci_words_and_one_word_over_and_over():
    a, b = ["a"], ["a", "b"]
    while len(b) < 900:
        a, b = b, b + a
    for words in (b, ["x"] * 3000, ["x", "y"] * 700 + ["x"]):
        words = [w.encode() for w in words]
        doc, start, length, period = P.runs_of([words])
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == brute(words)


def test_agreement_by_levels():
    rng = np.random.default_rng(5)
    words = [bytes([97 + x]) for x in rng.integers(0, 2, 300)]
    levels = P.named_levels(P.first_names([words]), 4)
    one = rng.integers(0, 299, 200)
    two = one + 1 + rng.integers(0, 300, 200) % (299 - one + 0).clip(1)
    two = np.minimum(two, 299)
    for a, b, f, g in zip(one, two, P.agreement(levels, one, two), P.agreement(levels, one, two, backwards=True), strict=True):
        n = next((k for k in range(300) if b + k >= 300 or words[a + k] != words[b + k]), 300)
        m = next((k for k in range(301) if a - k - 1 < 0 or words[a - k - 1] != words[b - k - 1]), 300)
        assert a == b or (f, g) == (n, m)


def expected(key, text):
    words = (text or "").split()
    h = None if key is None else zlib.crc32(str(key).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    rest = hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, rest)


def test_query_against_the_definition(spark, documents, tmp_path):
    rng = random.Random(7)
    rows = [(k, " \t\n".join(t)) for k, t in enumerate(texts(rng, 200))] + [(500, None), (501, ""), (502, " \x0b "), (None, "a b " * 20), (3, "again " * 30), (503, "é ü " * 20), (504, "tick " * 5000)]
    documents(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_periodic_runs(spark, str(tmp_path))
    assert out.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    ascii_split = [(k, t if t is None else t.replace(" ", "⁠")) for k, t in rows]  # str.split would part at it
    want = [expected(k, t) if t is None or "⁠" not in t else None for k, t in ascii_split]
    got = sorted((tuple(r)[:8] for r in out.collect()), key=key)
    assert [r for r in got if r[0] != 503] == sorted((w for w in want if w), key=key)
    assert [r[1:5] for r in got if r[0] == 503] == [(1, 0, 20, 1)] or zlib.crc32(b"503") % 10 == 0


def test_the_rows_a_tenth_of_ids_repeats():
    words = [f"{k}".encode() for k in range(100)]
    changed = [k for k in range(1000) if repeated_words(k, b" ".join(words)) != words]
    assert changed == [k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0]


def test_empty_table(spark, documents):
    out, n_words, runs, text = P.periodic_runs(documents([]))
    assert out.count() == 0 and (n_words, runs, text) == ("n_words", "periodic_runs", "collapsed_text")
