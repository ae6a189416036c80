import random
import re
from collections import Counter

import numpy as np
import pytest

from plotweave.llm import collocations as C


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower)]


def brute(rows, max_words=3, least=10, share=50, top=2000):
    """Every count, cut and containment by its definition."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            f.update((lang, tuple(p[i : i + k])) for k in range(1, max_words + 1) for i in range(len(p) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and inside(q) for (g, q), b in candidates.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["new", "york", "city", "of", "The", "the", "é", "straße", "a\x00b", "日本", "x⁠y", "bees", "Honey", "big"]
    fixed = ["new york city", "New York", "honey bees", "of the big", "日本 é", "the the the the"]
    rows = []
    for _ in range(n):
        parts = [rng.choice([*fixed, rng.choice(words), rng.choice(words)]) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "?!"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("en", " \t . ,"), ("fr", "alone"), ("xx", "ping pong " * 20_000)]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_against_the_definition(spark, max_words):
    rows = corpus(max_words, 250)
    docs = spark.createDataFrame([(k, lang, text, "x") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, F string").repartition(3)
    got = C.collocations(docs, max_words=max_words, top=40, shard_bytes=2000)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["lang string", "rank bigint", "phrase string", "a bigint", "l bigint", "r bigint", "n bigint", "score bigint"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, max_words, top=40)


def test_states_are_classes_of_end_places():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 200).astype(np.int32)
    automaton = C.ShardAutomaton(words, 3)
    ends = {}
    for k in (1, 2, 3):
        for i in range(len(words) - k + 1):
            if (words[i : i + k] > 0).all():
                ends.setdefault(tuple(words[i : i + k].tolist()), set()).add(i + k - 1)
    classes = {}
    for phrase, places in ends.items():
        classes.setdefault(frozenset(places), []).append(phrase)
    states = {}
    for s, (length, end) in enumerate(zip(automaton.length, automaton.end, strict=True)):
        states[s] = tuple(words[end - length + 1 : end + 1].tolist())
    assert sorted(states.values()) == sorted(max(c, key=len) for c in classes.values())
    for s, longest in states.items():
        own = classes[frozenset(ends[longest])]
        assert automaton.times[s] == len(ends[longest]) and automaton.shortest[s] == min(map(len, own))
        link = min(own, key=len)[1:]
        assert (automaton.link[s] < 0) == (not link) and (not link or ends[states[automaton.link[s]]] == ends[link])
    for k in (1, 2, 3):
        at, times = automaton.phrases(k)
        got = {tuple(words[e - k + 1 : e + 1].tolist()): t for e, t in zip(at.tolist(), times.tolist(), strict=True)}
        assert got == {p: len(x) for p, x in ends.items() if len(p) == k} and len(got) == len(at)


def test_sieve_lets_all_frequent_phrases_through(spark):
    frequent = spark.createDataFrame([("en", f"w{k} é{k}") for k in range(3000)], "lang string, phrase string")
    bitmap, bits = C.sieve_of(frequent)
    passes = lambda phrases: (bitmap[(at := C.sieve_place(b"en", phrases, bits)) >> 3] >> (at & 7)) & 1
    assert passes([f"w{k} é{k}".encode() for k in range(3000)]).all()
    assert passes([f"v{k}".encode() for k in range(3000)]).mean() < 0.1


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(4 * 10**12, 5 * 10**12, 4 * 10**12 + 1)], "a long, l long, r long")
    wide = {x: f"cast({x} as decimal(19,0))" for x in "alr"}
    got = rows.selectExpr(f"cast(1000000 as decimal(7,0)) * ({wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']}) as s").first()["s"]
    assert got == 10**6 * (4 * 10**12) ** 2 // (5 * 10**12 * (4 * 10**12 + 1))


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
