import hashlib
import random
import re

import pytest

from plotweave.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, window):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("shard_words", [1_000_000, 6])
def test_report_against_brute_force(spark, documents, shard_words):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cd Éf g7 x-y".split()) for _ in range(n))
    items = [(k, text(rng.randint(1, 9))) for k in range(12)] + [(20, None), (21, ""), (22, "..."), (3, "ab cd ab cd ab"), (None, "ab g7 x"), (30, "ab " * 40)]
    docs = [(k, text(rng.randint(0, 40))) for k in range(40)] + [(40, None), (41, ""), (42, "!?"), (0, "ab"), (7, "ab cd Éf")]
    got = D.report(documents(docs), spark.createDataFrame(items, "item_id long, text string"), window=5, shard_words=shard_words)
    rows = sorted(tuple(r)[:6] for r in got.collect())
    assert rows == sorted(plain(docs, items, 5))


def test_decontaminate_drops_cuts_and_keeps_columns(spark, documents):
    passage = " ".join(f"w{k}" for k in range(13))
    docs = documents([(1, f"{passage} tail"), (2, "clean words only"), (3, "x " * 500 + passage + " end."), (4, None)])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [2, 3, 4]
    assert kept.where("doc_id = 3").first()["text"].count("w5") == 1
    cut = D.decontaminate(docs, items, longest=5).where("doc_id = 3").first()["text"]
    assert "w5" not in cut and cut.endswith(" end.")
    assert D.decontaminate(docs.limit(0), items).count() == 0 and D.decontaminate(docs, items.limit(0)).count() == 4
