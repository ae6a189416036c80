import random
import re

import numpy as np
import xxhash

from plotweave.llm import simhash as S


def plain_print(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_operator_against_brute_force(documents):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(20)]
    rows = []
    for d in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((d, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "One"), (204, "one"), (205, "x " * 5000)]
    got = {r["doc_id"]: (r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in S.near_duplicates(documents(rows)).collect()}
    prints = {d: plain_print(t) for d, t in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(prints, linked)
    assert got == {d: (prints[d], want[d]) for d in prints}


def test_links_hold_at_the_limit(spark):
    rng = random.Random(8)
    nodes = []
    for _ in range(60):
        a = rng.getrandbits(64)
        nodes += [a, a ^ sum(1 << b for b in rng.sample(range(64), 4)), a ^ sum(1 << b for b in rng.sample(range(64), 5))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = S.links(spark.createDataFrame([(signed(x),) for x in nodes], "fingerprint long"))
    got = {r["node"]: r["root"] for r in S.components(edges).collect()}
    ids = [signed(x) for x in nodes]
    want = roots(ids, [(signed(a), signed(b)) for a in nodes for b in nodes if a != b and (a ^ b).bit_count() <= 4])
    classes = lambda m: {frozenset(k for k in ids if m.get(k, k) == v) for v in {m.get(k, k) for k in ids}}
    assert classes(got) == classes(want)


def test_components_of_a_long_chain(spark):
    got = S.components(spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 200
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_links_join_classes_by_their_roots(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(5, 6), (6, 7), (1, 2), (10, 11)]
    more = [(7, 2), (20, 11), (30, 31), (2, 1)]
    got = {r["node"]: r["root"] for r in S.merged_roots(S.components(frame(first)), frame(more)).collect()}
    want = roots([1, 2, 5, 6, 7, 10, 11, 20, 30, 31], first + more)
    assert {k: got.get(k, k) for k in want} == want


def test_near_copies_by_similarity(documents):
    rng = random.Random(2)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, other = text(300), text(300)
    near = base[:150] + ["changed"] + base[151:]
    far = base[:150] + text(150)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(other)), (5, " ".join(base)), (6, None), (7, ""), (8, "a b"), (None, " ".join(base))]
    docs = documents(rows)
    kept = S.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 8]
    assert S.first_of_each(documents([])).count() == 0


def test_trees_do_not_grow_with_pairs():
    f = np.array([1 << k for k in range(40)], np.uint64)
    assert len(S.forest(f, 4)[0]) == 39
    away = np.abs(np.arange(40)[:, None] - np.arange(40))
    assert S.tree(away <= 3, away).shape == (2, 39)
    assert {tuple(sorted(p)) for p in S.tree(away <= 3, away).T.tolist()} == {(k, k + 1) for k in range(39)}
    assert S.tree(away == 0, away).shape == (2, 0)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((shared, rng.integers(0, 1 << 63, 45).astype(np.uint64)))) for _ in range(80)]
    k = S.sketches(S.least_hashes(sets))
    near, differing = S.may_be_similar(k[:, None], k, np.full((80, 1), 445), np.full(80, 445), 0.8)
    assert near.all(), "all pairs have a similarity of 0.816"
    assert 12 < differing[np.triu_indices(80, 1)].mean() < 23
    far = S.sketches(S.least_hashes([rng.integers(0, 1 << 63, 445).astype(np.uint64) for _ in range(80)]))
    assert not S.may_be_similar(k, far, np.full(80, 445), np.full(80, 445), 0.8)[0].any()


def test_rows_are_sifted_by_their_ids(spark):
    from plotweave.llm import common

    docs = spark.createDataFrame([(k if k else None, f"t{k}", k) for k in range(2000)], "doc_id long, text string, sieve_bits long")
    ids = spark.createDataFrame([(k,) for k in range(0, 4000, 7)], "x long")
    assert sorted(r["sieve_bits"] for r in common.among(docs, "doc_id", ids).collect()) == list(range(7, 2000, 7))
    left = common.without(docs, "doc_id", ids)
    assert left.columns == docs.columns and sorted(r["sieve_bits"] for r in left.collect()) == [k for k in range(2000) if k == 0 or k % 7]
    assert common.without(docs, "doc_id", ids.limit(0)).count() == 2000 and common.among(docs, "doc_id", ids.limit(0)).count() == 0


def linked_by_brute_force(rows, similarity=0.8, shingle=5):
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}
    return roots(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])])


def test_every_pair_that_meets_is_verified(documents):
    """Families of texts around the limit: a pair counts however many less similar texts lie between."""
    rng = random.Random(12)
    rows = []
    for _ in range(12):
        base = [f"u{rng.randrange(10**6)}" for _ in range(160)]
        for _ in range(30):
            w = base[:]
            for k in rng.sample(range(160), rng.randint(0, 6)):
                w[k] = f"u{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    wanted = linked_by_brute_force(rows)
    for at_once in (S.AT_ONCE, 4):
        got = {r["doc_id"]: r["component_id"] for r in S.near_copies(documents(rows), at_once=at_once).collect()}
        assert got == wanted, f"{at_once} at once"


def test_open_nodes_are_those_of_a_plain_comparison():
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((shared, rng.integers(0, 1 << 63, int(n)).astype(np.uint64)))) for n in rng.integers(20, 400, 90)]
    size, k = np.array([len(x) for x in sets]), S.sketches(S.least_hashes(sets))
    for groups in (1, 3, 90):
        group = np.sort(rng.integers(0, groups, 90))
        near = S.may_be_similar(k[:, None], k, size[:, None], size, 0.8)[0] & (group[:, None] != group)
        for block in (4, 16, 256):
            assert (S.open_ones(group, size, k, 0.8, block) == near.any(axis=1)).all()


def test_places_in_parts_connect_the_same(spark):
    """Where many meet, parts of them are compared with each other: the classes are those of one comparison."""
    rng = random.Random(21)
    rows, base = [], [f"q{rng.randrange(10**6)}" for _ in range(120)]
    for d in range(60):
        w = base[:]
        for k in rng.sample(range(120), rng.randint(0, 5)):
            w[k] = f"q{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    sets = {d: S.shingle_set(t.encode(), 5, S.SEED) for d, t in rows}
    sizes, least = [len(sets[d]) for d, _ in rows], S.least_hashes([sets[d] for d, _ in rows])
    nodes = spark.createDataFrame([(d, n, *(int(x) for x in k.view(np.int64))) for (d, _), n, k in zip(rows, sizes, S.sketches(least), strict=True)], "doc long, size long, k0 long, k1 long, k2 long, k3 long")
    hashes = spark.createDataFrame([(d, S._written(x)) for d, x in sets.items()], "doc long, hashes binary")
    meetings = spark.createDataFrame([(7, d, d) for d, _ in rows] + [(8, d, d) for d in range(3)], "value long, doc long, group long")
    for at_once in (1000, 9):
        found = S.linked(meetings, nodes, hashes, 0.8, at_once)
        got = {r["node"]: r["root"] for r in S.components(found).collect()}
        assert {d: got.get(d, d) for d in sets} == linked_by_brute_force(rows)
    assert len(found.collect()) < 60 * 8, "links are handed on, not pairs"


def test_texts_of_one_repeated_line_are_no_copies(documents):
    rng = random.Random(5)
    line = "this same line stands here again always "
    rows = [(d, line * 60 + " ".join(f"own{rng.randrange(10**6)}" for _ in range(45))) for d in range(20)]
    rows += [(20 + d, "word " * 120 + " ".join(f"own{rng.randrange(10**6)}" for _ in range(100))) for d in range(10)]
    rows += [(40, rows[3][1]), (41, rows[25][1].upper())]
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(documents(rows)).collect()}
    assert got == {d: d for d in range(30)} | {40: 3, 41: 25}


def test_long_texts_are_judged_on_all_their_shingles(documents):
    """700 words with 15 changed are similar by 0.805, with 16 changed by 0.794."""
    rng, rows = random.Random(9), []
    for k in range(60):
        w = [f"z{rng.randrange(10**7)}" for _ in range(700)]
        rows.append((2 * k, " ".join(w)))
        for at in range(15 + k % 2):
            w[20 + 40 * at] = f"z{rng.randrange(10**7)}"
        rows.append((2 * k + 1, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(documents(rows)).collect()}
    assert got == linked_by_brute_force(rows) == {d: d - (d % 4 == 1) for d in range(120)}
