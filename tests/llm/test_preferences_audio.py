import numpy as np

from plotweave.llm import audio as A
from plotweave.llm import preferences as P

TURN = "pair_id long, turn long, role string, text string"


def test_common_prefix_masks_and_odd_cases(spark):
    chosen = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "and?"), (2, 0, "user", "same"), (3, 0, "user", None), (3, 1, None, "x"), (4, 0, "user", "alone")]
    rejected = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go awäy"), (2, 0, "user", "same"), (3, 0, "user", None), (3, 1, None, "y"), (5, 0, "user", "alone")]
    got = {r["pair_id"]: r for r in P.format_pairs(spark.createDataFrame(chosen, TURN), spark.createDataFrame(rejected, TURN)).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert r["n_prompt_turns"] == 2 and r["prompt"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    for side, said in (("chosen", "hello"), ("rejected", "go awäy")):
        text, spans = r[f"{side}_completion"], r[f"{side}_loss_spans"]
        assert [text[s["start"] : s["start"] + s["length"]] for s in spans] == [said + "<|im_end|>"]
    assert got[2]["chosen_completion"] == got[2]["rejected_completion"] == "" and got[2]["chosen_loss_spans"] == []
    assert got[3]["n_prompt_turns"] == 1 and got[3]["chosen_completion"] == "<|im_start|>unknown\nx<|im_end|>\n"
    none = spark.createDataFrame([], TURN)
    assert P.format_pairs(none, none).count() == 0


def test_swapped_replies(spark):
    turns = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "bye"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (4, 0, "user", "q4")]
    chosen, rejected = P.swapped_replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted(r["text"] for r in chosen.collect()) == ["a1", "q1"] and sorted(r["text"] for r in rejected.collect()) == ["a2", "q1"]


def tune(pitches, rate=A.RATE, seconds=0.25):
    t = np.arange(int(rate * seconds)) / rate
    return np.concatenate([(9000 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t)).astype("<i2") for p in pitches])


def test_chroma_names_the_pitch():
    plane = A.chroma(tune([0] * 8))
    assert plane.shape[1] == 12 and (plane.argmax(axis=1) == 0).all()
    assert len(A.codes(tune([0]))) == 0 and len(A.codes(np.zeros(0))) == 0
    steady = A.codes(np.zeros(50_000))
    assert len(set(steady.tolist())) == 1


def test_area_sums_equal_plain_sums():
    plane = np.random.default_rng(0).random((40, 12))
    image = np.zeros((41, 13))
    image[1:, 1:] = plane.cumsum(axis=0).cumsum(axis=1)
    assert np.isclose(image[15, 7] - image[5, 7] - image[15, 2] + image[5, 2], plane[5:15, 2:7].sum())


def test_excerpts_find_their_recordings(spark):
    rng = np.random.default_rng(3)
    rows = [(k, tune(rng.integers(0, 24, 24)).tobytes()) for k in range(12)]
    rows += [(12, None), (13, b""), (14, b"\x01"), (15, rows[2][1])]
    media = spark.createDataFrame(rows, "id long, pcm binary")
    prints = A.fingerprint(media, media_id="id", samples="pcm").persist()
    cut = A.excerpts(media.where("id in (2, 5, 12)"), media_id="id", samples="pcm", start=A.HOP * 14, length=A.RATE * 4)
    got = {(r["query_id"], r["media_id"]): r for r in A.align(A.fingerprint(cut, media_id="id", samples="pcm"), prints, media_id="id").collect()}
    assert {(2, 2), (2, 15), (5, 5)} <= set(got) and all(q == m or (q, m) == (2, 15) for q, m in got)
    assert all(r["offset"] == 14 and r["bit_error"] < 0.05 for r in got.values())
    assert A.align(prints.limit(0), prints, media_id="id").count() == 0


def test_alignment_against_brute_force(spark):
    """Recordings of few motifs in turn: every offset whose runs of equal codes vote often enough is looked at."""
    rng = np.random.default_rng(8)
    motifs = [rng.integers(0, 24, 5) for _ in range(4)]
    media = [(k, A.codes(tune(np.concatenate([motifs[m] for m in rng.integers(0, 4, 8)]))).view(np.int32).tolist()) for k in range(10)]
    media += [(10, None), (11, []), (None, media[0][1])]
    asked = [(k, media[k][1][30:70]) for k in (0, 3, 7)] + [(None, media[1][1]), (12, [])]
    frame = lambda rows: spark.createDataFrame(rows, "id long, codes array<int>")
    got = {(r["query_id"], r["media_id"]): (r["offset"], r["votes"], r["overlap"], round(r["bit_error"], 9)) for r in A.align(frame(asked), frame(media), media_id="id").collect()}

    def runs(c):
        return [(i, x) for i, x in enumerate(c or []) if not i or c[i - 1] != x]

    want = {}
    for q, a in asked:
        for m, b in media:
            votes = {}
            for i, x in runs(a):
                for j, y in runs(b):
                    if x == y:
                        votes[j - i] = votes.get(j - i, 0) + 1
            for offset, n in votes.items():
                low, high = max(0, -offset), min(len(a), len(b) - offset)
                if q is None or m is None or n < 4 or high - low < 8:
                    continue
                wrong = sum(((a[k] ^ b[k + offset]) & 0xFFFFFFFF).bit_count() for k in range(low, high)) / 32 / (high - low)
                if wrong <= 0.2:
                    want[q, m] = min(want.get((q, m), (9,)), (round(wrong, 9), -n, offset, high - low))
    assert got == {k: (o, -n, w, e) for k, (e, n, o, w) in want.items()}
    assert all(got[q, q][0] == 30 and got[q, q][3] == 0 for q in (0, 3, 7))
