import random

from plotweave.operators import cleaning, segment


def lines_of(spark, text, doc="d"):
    return cleaning.document_lines(spark.createDataFrame([(doc, text)], "doc_id string, text string"))


def test_blocks_scenes_and_sequences(spark):
    text = "\nOpening words here.\nINT. BAR - NIGHT - 1975\n\nMen drink.\nThey talk.\n\nFRANK V/O\n\nI knew him.\nWell enough.\n\nHe sits.\nRUSSELL\n(quietly)\nYou did fine.\nEXT. ROAD - DAY\n"
    lines = lines_of(spark, text)
    found = segment.blocks(lines).orderBy("block_id").collect()
    told = [(r["block_type"], r["scene_id"], r["sequence_in_scene"], r["text"]) for r in found]
    assert told == [
        ("action", "scene_0001", 1, "Opening words here."),
        ("scene_header", "scene_0002", 0, "INT. BAR - NIGHT - 1975"),
        ("action", "scene_0002", 1, "Men drink. They talk."),
        ("utterance", "scene_0002", 2, "I knew him. Well enough."),
        ("action", "scene_0002", 3, "He sits."),
        ("utterance", "scene_0002", 4, "(quietly) You did fine."),
        ("scene_header", "scene_0003", 0, "EXT. ROAD - DAY"),
    ]
    assert found[3]["speaker_cue_raw"] == "FRANK V/O" and found[3]["delivery_modifiers"] == ["voice_over"] and found[3]["utterance_id"] == "utt_000001"
    scenes = {r["scene_id"]: r for r in segment.scenes(segment.blocks(lines), lines).collect()}
    assert scenes["scene_0001"]["flags"] == ["synthetic_prelude_scene"] and scenes["scene_0002"]["year_explicit"] == 1975
    assert scenes["scene_0002"]["line_end"] + 1 == scenes["scene_0003"]["line_start"]
    assert {(r["measure"], r["name"]): r["n"] for r in segment.summary(segment.blocks(lines)).collect()}[("block_type", "utterance")] == 2


def automaton(symbols):
    """The plain four-state reading of a line stream: block numbers of lines."""
    state, out, block = "none", [], 0
    for s in symbols:
        if s == "B":
            if state in ("in", "action"):
                state = "none"
            out.append(None)
            continue
        if s in "HA":
            block += 1
            state = "none" if s == "H" else "wait"
        elif s == "P" and state in ("wait", "in"):
            block += 1
            state = "action"
        elif state == "wait":
            state = "in"
        elif state == "none":
            block += 1
            state = "action"
        out.append(block)
    return out


def test_windows_agree_with_an_automaton(spark):
    rng = random.Random(5)
    cases = ["".join(rng.choice("BHAPX") for _ in range(rng.randint(1, 16))) for _ in range(400)]
    rows = [(k, i + 1, s, s) for k, case in enumerate(cases) for i, s in enumerate(case)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string, symbol string")
    got = {(r["doc_id"], r["line_no"]): r["block_no"] if r["kind"] else None for r in segment.with_blocks(df).collect()}
    for k, case in enumerate(cases):
        assert [got[k, i + 1] for i in range(len(case))] == automaton(case), case


def test_cleaning_end_to_end(spark):
    text = "# T\n\n## Page 1\n\n```text\nINT.\n\nFRANK'S HOUSE - DAY\n\n\nA man walks in slow-\nmotion today\nand sits.\nFRANK\nHello there my friend. 1\n```\n\n## Page 2\n\n```text\n(MORE)\n2\nHe leaves.\n```\n"
    got = [r["line"] for r in cleaning.cleaned(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line_no").collect()]
    assert got[0] == "INT. FRANK'S HOUSE - DAY" and "A man walks in slow-motion today and sits." in got and "FRANK" in got and "(MORE)" not in got


def unwrapped(spark, *lines):
    rows = [("d", k, x) for k, x in enumerate(lines, 1)]
    return [r["line"] for r in cleaning.unwrapped(spark.createDataFrame(rows, "doc_id string, line_no int, line string")).orderBy("line_no").collect()]


def test_wrapped_lines(spark):
    assert unwrapped(spark, "he goes on here -", "more text", "well-", "known words", "and-", "And so") == ["he goes on here - more text well-known words and- And so"]
    assert unwrapped(spark, "He sits.", "FRANK", "I know", "him.", "EXT. ROAD - DAY", "CUT TO:") == ["He sits.", "", "FRANK", "I know him.", "", "EXT. ROAD - DAY", "", "CUT TO:"]
    assert unwrapped(spark, "FRANK", "(low)", "I know", "him.") == ["FRANK", "(low)", "I know him."]
    assert unwrapped(spark, "FRANK", "First words", "FRANK SHEERAN walks out", "JIM HOFFA stays here", "", "JIM HOFFA stays", "BOB SMITH goes") == [
        "FRANK", "First words", "FRANK SHEERAN walks out JIM HOFFA stays here", "", "JIM HOFFA stays BOB SMITH goes",
    ]
    assert unwrapped(spark, "", "INT. BAR") == ["", "INT. BAR"]


def test_faulty_pages_raise(spark):
    import pytest

    with pytest.raises(Exception, match="fence"):
        cleaning.paged_lines(spark.createDataFrame([(1, "## Page 1\nno fence")], "doc_id int, text string")).collect()


def test_empty_document(spark):
    assert segment.blocks(lines_of(spark, "")).count() == 0


def test_only_names_of_a_known_cast_are_cues(spark):
    rows = [("d", "# T\n\n## Page 1\n\n```text\n1USER\nFirst words.\nA.\nI am here. OK\n(MORE)\n1\nUSER V/O\nmore\n```\n")]
    page = spark.createDataFrame(rows, "doc_id string, text string")
    told = lambda **k: [r["line"] for r in cleaning.cleaned(page, **k).orderBy("line_no").collect()]
    assert told(cast=("USER",)) == ["USER", "First words. A. I am here. OK", "", "USER V/O", "more"]
    assert told() == ["USER", "First words.", "", "A.", "I am here.", "", "OK", "", "USER V/O", "more"]
