import pytest
from pyspark.sql import functions as F

from plotweave.operators import answers, quality, router, search


@pytest.fixture(scope="module")
def n(spark):
    person = "array<struct<entity_id:string,role:string>>"
    entities = spark.createDataFrame([("char_frank_sheeran", "character", "Frank Sheeran", ["FRANK"]), ("char_peggy_sheeran", "character", "Peggy Sheeran", ["PEGGY"]), ("char_jimmy_hoffa", "character", "Jimmy Hoffa", ["JIMMY"]), ("loc_bar", "location", "Bar", [])], "entity_id string, entity_type string, canonical_name string, aliases array<string>")
    aliases = spark.createDataFrame([("char_jimmy_hoffa", "Jim", "JIM", "manual_alias"), ("char_frank_sheeran", "zzz", "ZZZ", "utterance_cue")], "entity_id string, alias_raw string, alias_normalized string, source string")
    edges = spark.createDataFrame([("kg_1", "char_frank_sheeran", "family", "char_peggy_sheeran", "stable", ["scene:s1"]), ("kg_2", "char_jimmy_hoffa", "associated_with", "char_frank_sheeran", "stable", [])], "edge_id string, subject_id string, predicate string, object_id string, stability string, evidence_refs array<string>")
    events = spark.createDataFrame(
        [("evt_1", "s1", "talk", "question", "Frank asks Peggy", [("char_frank_sheeran", "speaker"), ("char_peggy_sheeran", "target")], ["where were you"], ["evref_1"], 1, 0.9), ("evt_2", "s2", "act", "shooting", "A shot", [("char_jimmy_hoffa", "participant")], ["gun fires"], ["evref_2"], 1, 0.8), ("evt_3", "s1", "talk", "statement", "Peggy leaves", [("char_peggy_sheeran", "speaker")], ["goodbye"], ["evref_3"], 2, 0.7)],
        f"event_id string, scene_id string, event_type_l1 string, event_type_l2 string, summary string, participants {person}, snippets array<string>, evidence_refs array<string>, sequence_in_scene int, confidence double",
    )
    scenes = spark.createDataFrame([("s1", 1, "INT. BAR - 1975", "BAR", 1975, None), ("s2", 2, "EXT. ROAD", "ROAD", None, 1980)], "scene_id string, scene_index int, header_raw string, location_raw string, year_explicit int, year_inferred int")
    changes = spark.createDataFrame([("sc_1", "char_peggy_sheeran", "char_frank_sheeran", "trust", "decrease", "explicit", "low", 0.8, "s1", ["evt_3", "evt_9", "evt_1"], ["evref_3"], ["r1"])], "state_change_id string, subject_id string, object_id string, state_dimension string, direction string, claim_type string, magnitude string, confidence double, scene_id string, trigger_event_ids array<string>, evidence_refs array<string>, rule_ids array<string>")
    temporal = spark.createDataFrame([("evt_1", "evt_3", "precedes")], "from_event string, to_event string, relation string")
    blocks = spark.createDataFrame([("blk_1", "s1", "utterance", 1, "FRANK", "where were you"), ("blk_2", "s2", "action", 1, None, "A road at night")], "block_id string, scene_id string, block_type string, sequence_in_scene int, speaker_cue_raw string, text string")
    return answers.Narrative(entities, aliases, edges, events, scenes, changes, temporal, blocks)


def test_limits_and_counts(n):
    assert [search.clamped(x, 200) for x in (None, 0, 1, 501)] == [200, 1, 1, 500]
    got = search.list_entities(n.entities, q="sheeran", limit=1).collect()
    assert len(got) == 1 and got[0]["filtered"] == 2
    assert search.list_entities(n.entities, q="peggy", entity_type="location").count() == 0
    assert [r["entity_id"] for r in search.list_entities(n.entities, q="jimm").collect()] == ["char_jimmy_hoffa"]


def test_event_searches(n):
    ids = lambda **k: [r["event_id"] for r in search.trace_events(n.events, n.scenes, **k).orderBy("place").collect()]
    assert ids() == ["evt_1", "evt_3", "evt_2"]
    assert ids(q="GUN") == ["evt_2"] and ids(year=1980) == ["evt_2"] and ids(location_q="bar") == ["evt_1", "evt_3"]
    assert ids(pair="char_frank_sheeran::char_peggy_sheeran") == ["evt_1"] and ids(pair="char_peggy_sheeran::char_peggy_sheeran") == []
    debug = search.list_debug_events(n.events, entity_id="char_peggy_sheeran", q="bye")
    assert [r["event_id"] for r in debug.collect()] == ["evt_3"]
    rich = {r["event_id"]: r for r in search.enriched_events(search.trace_events(n.events, n.scenes), n.entities, n.temporal, n.changes).collect()}
    assert rich["evt_1"]["participant_names"] == ["Frank Sheeran", "Peggy Sheeran"] and rich["evt_3"]["edges_in"] == ["precedes:evt_1"] and rich["evt_1"]["state_changes_triggered"] == ["sc_1"]


def test_changes_timeline_and_options(n):
    row = search.enriched_changes(search.list_state_changes(n.changes, entity_id="char_frank_sheeran"), n.entities, n.scenes, n.events).first()
    assert [e["event_id"] for e in row["trigger_events"]] == ["evt_3", "evt_1"] and row["subject_name"] == "Peggy Sheeran"
    seen = lambda **k: [(r["scene_id"], r["matching_events"], r["matching_state_changes"]) for r in search.timeline_slice(n.events, n.changes, n.scenes, **k).collect()]
    assert seen() == [("s1", 2, 1), ("s2", 1, 0)]
    assert seen(event_type="shooting") == [("s1", 0, 1), ("s2", 1, 0)], "the kind of event is no condition on changes"
    assert seen(year=1975, entity_id="char_jimmy_hoffa") == [] and seen(limit_scenes=0) == [("s1", 2, 1)]
    assert search.pair_options(n.changes, n.entities).first()["label"] == "Frank Sheeran <> Peggy Sheeran"
    facets = {(r["facet"], r["value"]) for r in search.facet_options(n.events, n.scenes, n.changes, n.entities).collect()}
    assert ("year", "1980") in facets and ("entity", "loc_bar") not in facets


def test_router(spark):
    asked = spark.createDataFrame([("Who is Frank?", None), ("Compare x", None), ("Is there courage?", None), ("Show me a scene", "kg"), ("When did it end?", "nonsense"), ("Why did he leave?", "baseline")], "question string, wanted string")
    got = [(r["query_type"], r["mode_used"]) for r in router.routed(asked, wanted="wanted").collect()]
    assert got == [("fact", "kg"), ("comparison", "hybrid"), ("comparison", "hybrid"), ("evidence", "kg"), ("timeline", "ntg"), ("causal_chain", "baseline_rag")]
    assert asked.select(router.signals(F.col("question")).alias("s")).first()["s"]["has_who"]
    body = router.normalized_request({"question": " x ", "preferredMode": "KG", "includeEvidence": False})
    assert body == {"question": "x", "preferred_mode": "kg", "include_evidence": False, "include_baseline_comparison": False}
    with pytest.raises(ValueError):
        router.normalized_request({"question": " "})


def test_detection_and_answers(n):
    assert [e for e, _ in answers.detect("Did Hoffa know Peggy and Jim?", n)] == ["char_jimmy_hoffa", "char_peggy_sheeran"]
    kg = answers.answer({"question": "Who is Frank connected to?"}, n)
    assert kg.mode_used == "kg" and kg.confidence == pytest.approx(0.65) and set(kg.entities_used) == {"char_frank_sheeran", "char_peggy_sheeran", "char_jimmy_hoffa"}
    sc = answers.answer({"question": "How does Frank's relationship with Peggy change over time?"}, n)
    assert sc.mode_used == "ntg" and sc.state_changes_used == ["sc_1"] and sc.events_used == ["evt_3", "evt_1"] and sc.confidence == pytest.approx(0.62)
    both = answers.answer({"question": "Compare what Frank asks Peggy", "include_evidence": False}, n)
    assert both.mode_used == "hybrid" and both.baseline is not None and both.evidence_refs == [] and "Warning" in both.reasoning_notes
    base = answers.answer_baseline_only("where were you", n)
    assert base.events_used[:1] == ["evt_1"] and not answers.valid(base) and base.confidence <= 0.78
    assert answers.answer({"question": "zebra?", "preferred_mode": "baseline"}, n).confidence == 0.12


def test_evidence(n):
    found = answers.evidence(n, ["evt_2", "evt_x", "evt_2"], ["sc_1"], ["evref_2", "evref_3", "scene:s2", "evref_77"])
    assert [(r["kind"], r["id"]) for r in found.collect()] == [("event", "evt_2"), ("state_change", "sc_1"), ("scene_ref", "scene:s2"), ("raw_ref", "evref_77")]
    assert [r["id"] for r in answers.unresolved(found).collect()] == ["evref_77"]


def test_quality(spark):
    df = spark.createDataFrame([("g", 1, 3), ("g", 3, 5), ("g", 8, 9), ("h", 1, 1)], "g string, a int, b int")
    assert {(r["start"], r["fault"]) for r in quality.range_faults(df, group="g", start="a", end="b").collect()} == {(3, "overlap"), (8, "gap")}
    assert [r["g"] for r in quality.sequence_faults(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 3), ("z", 1), ("z", 1)], "g string, p int"), group="g", place="p").orderBy("g").collect()] == ["y", "z"]
    dup = quality.duplicate_summary(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k").first()
    assert (dup["duplicate_keys"], dup["surplus_rows"], dup["samples"]) == (1, 1, ["a"])
    inner = spark.createDataFrame([("s", 1, 4), ("s", 2, 3)], "s string, line_start int, line_end int")
    assert quality.outside(inner, spark.createDataFrame([("s", 2, 9)], "s string, line_start int, line_end int"), key="s").count() == 1
    checks = quality.all_checks(quality.check("one", inner.limit(0)), quality.check("two", inner))
    assert tuple(quality.check_summary(checks).first()) == (2, 1, 1, 0.5)
    gold = spark.createDataFrame([("c1", "a", "equals", "1"), ("c2", "b", "contains", "x"), ("c3", "zz", "equals", "1")], "check_id string, locator string, operation string, expected string")
    facts = spark.createDataFrame([("a", "1"), ("b", '["x","y"]')], "locator string, actual string")
    assert {r["check_id"]: r["passed"] for r in quality.gold_checks(gold, facts).collect()} == {"c1": True, "c2": True, "c3": False}
    rec = quality.reconciled(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("a", 1), ("c", 2)], "k string, n int"), key="k", value="n")
    assert {r["key"] for r in rec.collect()} == {"b", "c"}


def test_envelopes_and_streams(spark, tmp_path):
    from plotweave.sources import envelope
    from plotweave.streaming import turns

    (tmp_path / "good.json").write_text('{"metadata": {"v": "1"}, "items": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}')
    (tmp_path / "bad.json").write_text('{"rows": []}')
    assert envelope.read_items(spark, str(tmp_path / "good.json"), "a int, b string").count() == 2
    with pytest.raises(Exception, match="envelope"):
        envelope.read_items(spark, str(tmp_path / "bad.json"), "a int").collect()
    found = envelope.read_available(spark, str(tmp_path), {"good": "a int, b string", "bad": "a int", "absent": "a int"})
    assert set(found.tables) == {"good"} and found.missing == ["bad", "absent"] and not found
    envelope.write_envelope(found.tables["good"], str(tmp_path / "out"), "things", "1.0")
    assert spark.read.json(str(tmp_path / "out/metadata")).first()["record_count"] == 2
    assert envelope.preview(found.tables["good"]).first()["n"] == 2
    assert envelope.status({"scenes": None}) == "pending_phase_1_parser" and envelope.status({"scenes": 1, "entities": 2, "events": 3, "query_examples": 4}) == "ready_for_queries"
    assert len(envelope.fingerprints(spark, str(tmp_path / "good.json")).first()["sha256"]) == 64
    spark.createDataFrame([("user", "Why me?", "2024-01-01 00:10:00"), ("user", "Okay", "2024-01-01 02:10:00")], "role string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = turns.windowed_counts(turns.labelled(spark.readStream.schema("role string, text string, ts timestamp").parquet(str(tmp_path / "in"))), key="label")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["label"], r["n"]) for r in spark.table("counted").collect()} == {("question", 1), ("agreement_acceptance", 1)}


def test_envelopes_both_ways(spark, tmp_path):
    from plotweave.sources import envelope

    items = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    envelope.write_envelope(items, str(tmp_path / "big"), "things", "1.0", parser="p")
    assert sorted(r["a"] for r in envelope.read_written(spark, str(tmp_path / "big"), "a int, b string").collect()) == [1, 2]
    items.limit(1).write.mode("overwrite").json(str(tmp_path / "big/items"))
    with pytest.raises(Exception, match="as many items"):
        envelope.read_written(spark, str(tmp_path / "big"), "a int, b string").collect()
    at = str(tmp_path / "one")
    envelope.write_file(items, at, "things", "1.0")
    assert {(r["a"], r["b"]) for r in envelope.read_items(spark, at, "a int, b string").collect()} == {(1, "x"), (2, None)}
    with pytest.raises(ValueError):
        envelope.write_file(items, at, "things", "1.0", most=1)
    kept = envelope.Cache(spark)
    first = kept.items(at, "a int, b string")
    assert kept.items(at, "a int, b string") is first and first.count() == 2
    envelope.write_file(items.limit(1), at, "things", "1.0")
    assert kept.items(at, "a int, b string").count() == 1
    assert envelope.fingerprint_or(spark, str(tmp_path / "absent"), "x") != envelope.fingerprint_or(spark, str(tmp_path / "big/metadata"), "x")


def test_gold_kinds_and_rules_are_checked(spark):
    from plotweave.operators import states

    with pytest.raises(ValueError, match="unknown kind"):
        quality.gold_table(spark, [{"check_id": "c", "kind": "scene_field_close_to", "expected": 1}])
    rule = {"rule_id": "r", "subject_id": "a", "object_id": "b", "state_dimension": "trust", "direction": "sideways", "claim_type": "explicit", "confidence": 0.5, "inference_method": "rule"}
    with pytest.raises(ValueError, match="direction"):
        states.checked_rules([rule])


def test_numbers_by_ranges(spark):
    from plotweave.operators import numbering

    rows = spark.createDataFrame([(k * 37 % 101, f"n{k * 37 % 101:03d}", k % 3) for k in range(101)] + [(None, None, 5)], "k long, s string, v int")
    for order in ("k", "s"):
        got = numbering.with_numbers(rows, order).orderBy("number").collect()
        assert [r["number"] for r in got] == list(range(1, 103)) and [r["k"] for r in got] == [None, *range(101)]
    sums = numbering.with_numbers(rows, "k", into="before", value="v").orderBy("before", "k").collect()
    total = 0
    for r in sorted(sums, key=lambda r: (r["k"] is not None, r["k"] or 0)):
        assert r["before"] == total
        total += r["v"]
