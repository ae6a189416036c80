import random

import numpy as np
from pyspark.sql import functions as F

from plotweave.llm import mixing as M
from plotweave.llm import toxicity as T


def test_learns_held_out_rows(spark, documents):
    rng = random.Random(6)
    words, bad = [f"{a}{b}o" for a in "bcdfg" for b in "aeiou"], ["rotten", "vermin", "dreck"]
    rows, labels = [], []
    for d in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "ab")]
    docs, marked = documents(rows), spark.createDataFrame([*labels, (2000, 1), (1, None)], "doc_id long, toxic int")
    scored = T.score(docs, T.fit_on_labels(docs, marked))
    assert scored.columns[-1] == "_score" and scored.columns[:-1] == docs.columns
    got = {r["doc_id"]: (r["held"], r["_score"]) for r in scored.withColumn("held", T.held_out()).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got.values())
    held = [(d % 5 == 0, s >= 0.7) for d, (h, s) in got.items() if h and d < 1000]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.95
    assert got[1000][1] == got[1001][1] < 0.7


def test_labels_of_held_out_rows_are_not_learnt(spark, documents):
    docs = documents([(d, f"text number {d} rotten" if d % 2 else f"text number {d}") for d in range(60)])
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit_on_labels(docs, labels), T.fit_on_labels(docs, flipped)
    assert a.bias == b.bias and a.weights.tolist() == b.weights.tolist()


def test_one_class_or_none(spark, documents):
    docs = documents([(1, "a few words"), (2, None)])
    for rows in ([], [(1, 0), (2, 0)]):
        model = T.fit_on_labels(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r["_score"] for r in T.score(docs, model).collect()} == {1 / (1 + np.exp(-model.bias))}


def test_targets_by_water_filling(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0), ("d", 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(sized).collect()}
    # Weights 1, 2, 3, 1, 2 over a, b, c, d, null; a, d and null are at their caps.
    assert got["a"] == 30 and got["d"] == 15 and got[None] == 0
    assert abs(got["b"] - 1970 * 2 / 5) < 1e-6 and abs(got["c"] - 1970 * 3 / 5) < 1e-6


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(5)
    size, fraction = rng.integers(1, 50, 300).astype(float), rng.random(300)
    out, left = M.pivot(size, fraction, rng.random(300))
    assert abs((out * size).sum() - (fraction * size).sum()) < 1e-6
    assert sum(0 < x < 1 for x in out) <= 1 and (left is None) == all(x in (0, 1) for x in out)
    mean = np.mean([M.pivot(np.array([3.0, 5.0, 2.0]), np.array([0.2, 0.5, 0.9]), rng.random(3))[0] for _ in range(4000)], axis=0)
    assert np.abs(mean - [0.2, 0.5, 0.9]).max() < 0.03


def test_pivot_by_halves_leaves_a_small_row():
    rng = np.random.default_rng(6)
    size = np.sort(np.concatenate(([900.0, 700.0, 650.0], rng.integers(1, 60, 400))))[::-1].astype(float)
    fraction = np.full(len(size), 0.4)
    runs = [M.pivot_by_halves(size, fraction, rng.random(len(size)), rng.random(len(size))) for _ in range(1500)]
    for out, left in runs[:50]:
        assert abs((out * size).sum() - (fraction * size).sum()) < 1e-6
        assert left is None or size[left] <= 5
    assert np.abs(np.mean([out[:5] for out, _ in runs], axis=0) - 0.4).max() < 0.06
    assert M.pivot_by_halves(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))[1] is None


def test_a_document_that_outweighs_its_source_is_made_up_for():
    size = np.array([1300.0] + [20.0] * 600 + [3.0] * 5)
    fraction = np.full(len(size), 0.078)
    rng = np.random.default_rng(7)
    for _ in range(20):
        out, left = M.pivot_by_halves(size, fraction, rng.random(len(size)), rng.random(len(size)))
        if left is not None:
            M.close_up(size, fraction, out, left)
        assert set(out) <= {0.0, 1.0} and abs(((out - fraction) * size).sum()) <= 10


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = random.Random(1)
    rows = [(d, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "c", None])) for d in range(900)] + [(2000, None, "a"), (2001, "", None), (7, "x y", "b"), (7, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kw = {"bucket_rows": 40, "fan_in": 2}
    copies = M.mix(docs, **kw)
    got = copies.collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    per = {}
    for r in got:
        per.setdefault(r["source"], [0, r["target"]])[0] += r["copies"] * r["size"]
    assert all(abs(taken - target) <= 30 for taken, target in per.values()), per
    again = M.mix(docs.repartition(7), **kw).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    out = M.repeat_rows(docs, copies)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert M.mix(docs.limit(0)).count() == 0
    clashing = docs.withColumns({c: F.lit(1) for c in ("_id", "_key", "_tie", "copies", "row_key", "mix_id", "mix_copies")})
    odd = M.repeat_rows(clashing, copies)
    assert odd.columns == clashing.columns and odd.count() == out.count()


def test_texts_of_a_rare_language_are_not_taken_for_toxic():
    """The regression goes on until a tenth of the rows, of other words than the rest, is told apart as well."""
    rng = np.random.default_rng(31)
    rows, y = [], []
    for k in range(1500):
        low = 3000 if k % 10 == 0 else 0
        toxic = k % 9 == 0
        rows.append(np.unique(np.concatenate((rng.integers(low, low + 3000, rng.integers(30, 600)), rng.integers(6000, 6008, 2 * toxic)))).astype(np.int32))
        y.append(float(toxic))
    y = np.array(y)
    seen = np.array([np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == k]), minlength=6008) for k in (0, 1)])
    ratios = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / ((1 - y).sum() + 2))
    w, b = T._regress(rows, [np.ones(len(r)) for r in rows], y, ratios, -2.0, 1e-3, T.ROUNDS)
    scores = np.array([1 / (1 + np.exp(-((w * ratios)[r].sum() + b))) for r in rows])
    assert ((scores >= 0.7) == (y == 1)).mean() > 0.995


def test_one_text_and_id_in_two_sources(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", "b"), (1, "one two three", None), (1, "one two three", "b")] + [(k, "w " * k, s) for k in range(2, 30) for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    copies = M.mix(docs)
    asked = {}
    for r in copies.collect():
        asked[r["doc_id"], r["source"]] = asked.get((r["doc_id"], r["source"]), 0) + r["copies"]
    got = {}
    for r in M.repeat_rows(docs, copies).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == {k: n for k, n in asked.items() if n}
