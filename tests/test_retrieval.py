import random
import re

import pytest

from plotweave.operators import retrieval, substrings


def words(text):
    return [w for w in re.sub(r"[^a-z0-9\s']", " ", text.lower()).split() if len(w) >= 2]


def score(question, text):
    own = set(words(question))
    whole = question.strip().lower()
    return sum(w in own for w in words(text)) + (2 if whole and whole in text.lower() else 0)


@pytest.mark.parametrize("rare", [1, 20, 10_000])
def test_best_matches_are_those_of_a_full_evaluation(spark, rare):
    rng = random.Random(rare)
    letters = ["the", "the", "the", "of", "of", "a1", "ink", "owl", "Sea", "it's", "cab", "dew", "elm", "fog"] + [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))), f"s{k % 3}") for k in range(150)] + [(500, None, "s0"), (501, "", "s1"), (502, "the of " * 300, "s2")]
    asked = [(k, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))) for k in range(40)] + [(900, None), (901, "The of"), (902, "nowhere zebra")]
    t = spark.createDataFrame(texts, "id long, body string, scene string")
    q = spark.createDataFrame(asked, "qid long, question string")
    got = retrieval.best_matches(q, t, question_key="qid", question="question", key="id", text="body", order=("scene",), rare_texts=rare)
    want = []
    for qid, question in asked:
        rows = sorted((-score(question, body), scene, k) for k, body, scene in texts if question and body and score(question, body) > 0)
        want += [(qid, k, -s, place) for place, (s, _, k) in enumerate(rows[:6], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_allowed_pairs_only(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(k, "owl owl" if k else "owl", k % 2) for k in range(9)], "id long, body string, kind int")
    q = spark.createDataFrame([(1, "owl", 0)], "qid long, question string, wanted int")
    got = retrieval.best_matches(q, t, question_key="qid", question="question", key="id", text="body", allowed=F.col("kind") == F.col("wanted"), most=3)
    assert sorted((r["id"], r["score"]) for r in got.collect()) == [(2, 4), (4, 4), (6, 4)]


def test_contained_needles(spark):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choice("abÄßc .") for _ in range(rng.randint(0, 40)))) for k in range(120)] + [(500, None), (501, "")]
    needles = [(k, "".join(rng.choice("abÄßc .") for _ in range(rng.randint(0, 5)))) for k in range(60)] + [(700, None), (701, "AB"), (702, "zzz"), (703, "abc"), (704, "ABC")]
    got = substrings.contained(spark.createDataFrame(needles, "n long, needle string"), spark.createDataFrame(texts, "id long, body string"), needle_key="n", needle="needle", key="id", text="body")
    want = sorted((n, k) for n, x in needles for k, t in texts if x and t and x.lower() in t.lower())
    assert sorted((r["n"], r["id"]) for r in got.collect()) == want
    assert substrings.contained(spark.createDataFrame([], "n long, needle string"), spark.createDataFrame(texts, "id long, body string"), needle_key="n", needle="needle", key="id", text="body").count() == 0


def test_needles_of_digits_meet_only_texts_that_have_them(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(substrings, "staged", lambda df, name: kept.setdefault(name, df))
    texts = spark.createDataFrame([(k, f"bolt #{k:09d}") for k in range(300)], "id long, body string")
    needles = spark.createDataFrame([(k, f"{k:05d}") for k in range(200, 220)], "n long, needle string")
    got = substrings.contained(needles, texts, needle_key="n", needle="needle", key="id", text="body")
    want = sorted((n, k) for n in range(200, 220) for k in range(300) if f"{n:05d}" in f"bolt #{k:09d}")
    assert sorted((r["n"], r["id"]) for r in got.collect()) == want
    assert kept["asked-postings"].count() == len(want)


def test_only_words_of_questions_are_written(spark, monkeypatch):
    kept, staged = {}, retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    t = spark.createDataFrame([(1, "owl owl fog dew"), (2, "fog dew")], "id long, body string")
    q = spark.createDataFrame([(1, "the owl")], "qid long, question string")
    got = retrieval.best_matches(q, t, question_key="qid", question="question", key="id", text="body")
    assert [tuple(r) for r in got.collect()] == [(1, 1, 2, 1)]
    assert [tuple(r) for r in kept["postings"].select("word", "key", "times", "size").collect()] == [("owl", 1, 2, 4)]


def test_few_needles_write_no_postings(spark, monkeypatch):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["The Harbour bar", "HARBOUR", None, "", "a.b"])], "id long, body string")
    needles = [(1, "harbour"), (2, "Bar"), (3, "harbour"), (4, ""), (5, None), (6, "gone"), (7, ".")]
    find = lambda rows, few=5: {tuple(r) for r in substrings.contained(spark.createDataFrame(rows, "n long, needle string"), texts, needle_key="n", needle="needle", key="id", text="body", few=few).collect()}
    by_postings = find(needles, few=3)
    monkeypatch.setattr(substrings, "staged", lambda *_: pytest.fail("postings of few needles were written"))
    assert find(needles) == by_postings == {(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (7, 4)}
    assert find([(4, "")]) == set()


@pytest.mark.parametrize(("most", "pass_words", "at_once"), [(6, 10_000, 1 << 20), (1, 10_000, 1), (6, 30, 1 << 20), (500, 10_000, 200)])
def test_passes_over_texts_give_the_lists_of_a_full_evaluation(spark, monkeypatch, most, pass_words, at_once):
    rng = random.Random(most)
    letters = ["the", "the", "of", "of", "a1", "ink", "Sea", "it's", "İx", "cab,", "é", "x-elm", "K"] + [f"w{k}" for k in range(30)]
    texts = [(k, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 40))), rng.choice(["s0", "s1", None])) for k in range(150)] + [(500, None, "s0"), (501, "", "s1"), (502, "the of " * 300, "s2"), (None, "the of", "s0")]
    asked = [(k, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))) for k in range(40)] + [(100 + k, t[3:-2]) for k, t, _ in texts[:40]] + [(900, None), (901, "The of"), (902, "nowhere zebra"), (903, ".")]
    t = spark.createDataFrame(texts, "id long, body string, scene string").repartition(3)
    q = spark.createDataFrame(asked, "qid long, question string")
    by_postings = retrieval.best_matches(q, t, question_key="qid", question="question", key="id", text="body", order=("scene",), most=most).collect()
    kept, staged = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: kept.append(name) or staged(df, name))
    monkeypatch.setattr(retrieval, "AT_ONCE", at_once)
    got = retrieval.best_matches(q, t, question_key="qid", question="question", key="id", text="body", order=("scene",), most=most, pass_words=pass_words)
    plan = got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_postings)) and len(by_postings) >= 50
    assert not {"postings", "near"} & {*kept} and (kept.count("matches") > 1) == (pass_words == 30)
    assert pass_words == 30 or plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1  # each task's best, nothing else


def test_passes_over_texts_look_at_allowed_pairs_only(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(k, "owl owl" if k else "owl", k % 2, [f"p{k % 3}"] if k % 4 else None) for k in range(9)], "id long, body string, kind int, who array<string>")
    q = spark.createDataFrame([(1, "owl", 0, []), (2, "owl", 1, ["p1"]), (3, "an owl", 1, ["p1"]), (4, "owl owl", None, None)], "qid long, question string, wanted int, ids array<string>")
    allowed = (F.col("kind") == F.col("wanted")) & ((F.size("ids") == 0) | F.arrays_overlap("who", "ids"))
    find = lambda allowed, **more: sorted(map(tuple, retrieval.best_matches(q, t, question_key="qid", question="question", key="id", text="body", allowed=allowed, most=3, **more).collect()))
    assert find(allowed, pass_words=100) == find(allowed, pass_words=1) == find(allowed) == [(1, 2, 4, 1), (1, 4, 4, 2), (1, 6, 4, 3), (2, 1, 4, 1), (2, 7, 4, 2), (3, 1, 2, 1), (3, 7, 2, 2)]
    assert find(F.col("kind") == 1, pass_words=100) == find(F.col("kind") == 1) != find(None, pass_words=100) == find(None)


@pytest.mark.parametrize("name", ["token_overlap_retrieval", "retrieval_of_benchmark"])
def test_queries_of_the_benchmark_shuffle_no_texts(spark, monkeypatch, name):
    from plotweave.plans import asked, catalog  # noqa: F401

    kept, staged = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: kept.append(name) or staged(df, name))
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert kept == ["asked-words"], "neither postings nor pairs are written"
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange ") == 1, "each task's best, and nothing else, is shuffled"
    assert found.count() > 0
