import random

import pytest

from plotweave.llm import repeats as R


def plain(rows, depth):
    """What each row loses: bytes in a string of that depth that also starts in a smaller document."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - depth + 1):
            s = b[i : i + depth]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < d:
                gone[i : i + depth] = [True] * depth
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("hot", [400_000, 3])
def test_against_brute_force(documents, hot):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    common = [" ".join(word() for _ in range(rng.randint(6, 40))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rng.choice(common) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((d, "|".join(parts)))
    rows += [(60, None), (61, ""), (62, "x"), (63, "z" * 400), (64, "z" * 300), (65, rows[4][1]), (66, rows[4][1][:-1]), (4, rows[4][1])]
    rng.shuffle(rows)
    got = R.without_repeats(documents(rows), hot=hot).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got) == plain(rows, 50)


def test_empty_table_and_null_ids(documents):
    assert R.without_repeats(documents([])).count() == 0
    text = "the same words over and over again in more than fifty bytes of text"
    got = R.without_repeats(documents([(None, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (2, len(text))]


def test_radix_groups_stop_at_the_depth():
    import numpy as np

    texts = np.frombuffer(b"abcdefghijklmnop" * 2 + b"abcdefghijklXXXX", np.uint8)
    least = R.radix_groups(texts, np.array([0, 16, 32]), np.zeros(3, np.int64), np.array([1, 2, 3]), 12)
    assert least.tolist() == [1, 1, 1]
    least = R.radix_groups(texts, np.array([0, 16, 32]), np.zeros(3, np.int64), np.array([1, 2, 3]), 16)
    assert least.tolist() == [1, 1, 3]


def test_the_greatest_depth(documents):
    import pytest

    rng = random.Random(11)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, shared), (2, "xx" + shared[100:2300] + "yy"), (3, shared[:1999]), (4, shared[4000:])]
    got = R.without_repeats(documents(rows), depth=R.MOST_DEPTH).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got) == plain(rows, R.MOST_DEPTH)
    with pytest.raises(ValueError):
        R.without_repeats(documents(rows), depth=R.MOST_DEPTH + 1)


def test_texts_of_one_id_lose_their_own_bytes_only(documents):
    """Two texts of id 2 with one CRC-32 in its low half: only the one that repeats document 1 loses bytes."""
    import zlib

    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(100))
    first = text()
    other = next(t for t in iter(text, None) if zlib.crc32(t.encode()) & 0xFFFF == zlib.crc32(first.encode()) & 0xFFFF)
    rows = [(1, first), (2, first), (2, other), (2, other), (2, "short"), (3, other + "!"), (2, None), (2, "")]
    got = R.without_repeats(documents(rows)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got) == plain(rows, 50)
