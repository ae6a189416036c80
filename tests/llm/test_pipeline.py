"""The pipeline's stages in turn, each against a plain version on its own input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from plotweave.llm import mixing, toxicity
from plotweave.llm.queries import tokenizer_path

from .test_decontaminate import plain as plain_report
from .test_simhash import linked_by_brute_force


def tables(spark, base):
    rng = random.Random(31)
    words, bad = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"], ["rotten", "vermin", "dreck"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows, labels = text(20), [], []
    for d in range(260):
        w = text(rng.randint(20, 90))
        if d % 5 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        if d % 31 == 1:
            w[5:5] = passage
        if d % 9 == 2 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            w[rng.randrange(len(w))] = "changed"
        rows.append((d, " ".join(w), "en", f"s{d % 3}", 1))
        labels.append((d, int(any(b in w for b in bad))))
    rows += [(300, None, "en", "s0", 0), (301, "", None, None, 0), (302, rows[7][1], "en", "s1", 1), (303, "one <|endoftext|>", "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, "short item")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")


def plain_scores(model, rows):
    """n-grams one by one: each slot counts by the logarithm of how often the text has it."""
    weight, out = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True)), {}
    for d, t in rows:
        raw = bytes(toxicity.FOLD[np.frombuffer((t or "").encode(), np.uint8)])
        slots = Counter(int(toxicity._hashed(np.frombuffer(raw[i : i + n], np.uint8), n)[0]) for n in toxicity.ORDERS for i in range(len(raw) - n + 1))
        out[d] = 1 / (1 + np.exp(-(model.bias + sum(weight.get(s, 0.0) * np.log2(1 + k) for s, k in slots.items()))))
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    base = str(tmp_path / "sf")
    tables(spark, base)
    docs, seen = spark.read.parquet(f"{base}/documents.parquet"), {}
    names, columns = [n for n, _ in C.STAGES], docs.columns
    for name, stage in C.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, base)
        out.write.parquet(f"{base}/{len(seen)}")
        now = spark.read.parquet(f"{base}/{len(seen)}")
        seen[name] = (docs, before, now)
        assert name == names[-1] or now.columns == columns
        docs = now
    kept = lambda name: sorted(r["doc_id"] for r in seen[name][2].select("doc_id").collect())

    first, before, _ = seen["toxicity"]
    scores = plain_scores(toxicity.fit_on_labels(first, spark.read.parquet(f"{base}/labels.parquet")), before)
    assert kept("toxicity") == sorted(d for d, s in scores.items() if s < 0.7) and len(kept("toxicity")) < len(before)

    _, before, _ = seen["near-dedup"]
    roots = linked_by_brute_force([(d, t or "") for d, t in before])
    assert kept("near-dedup") == sorted({*roots.values()}) and len(kept("near-dedup")) < len(before)

    _, before, _ = seen["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    assert kept("benchmark decontamination") == sorted(r[0] for r in plain_report(before, items, 13) if not r[5]) and len(kept("benchmark decontamination")) < len(before)

    frame, before, out = seen["mixing sources"]
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(frame).collect()}
    assert kept("mixing sources") == sorted(d for d, n in wanted.items() for _ in range(n))
    size = mixing.word_count(F.col("text"))
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    for r in mixing.source_targets(frame.select("source", size.alias("size"))).collect():
        assert abs(taken.get(r["source"], 0) - r["target"]) <= 20

    _, before, out = seen["token packing"]
    coder, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t in sorted(before, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(want)
    assert re.match("doc_id", out.columns[0])


def test_run_is_the_stages_in_turn(spark, tmp_path):
    base = str(tmp_path / "sf")
    tables(spark, base)
    got = C.run(spark, base)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
