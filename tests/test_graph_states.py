import pytest
from pyspark.sql import functions as F

from plotweave.operators import graph, states

EDGE = "subject_id string, predicate string, object_id string"


def test_manual_edges_need_both_ends(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    kept, skipped = graph.manual_edges(spark.createDataFrame([("a", "p", "b"), ("a", "p", "x"), ("x", "p", "b")], EDGE), entities)
    assert kept.count() == 1 and skipped.count() == 2


def test_pairs_need_three_scenes_and_no_known_edge(spark):
    rows = [(s, e) for s in range(3) for e in "ab"] + [(s, e) for s in range(2) for e in "cd"] + [(s, e) for s in range(10, 20) for e in "ef"]
    roster = spark.createDataFrame(rows, "scene_id int, entity_id string").distinct().withColumn("scene_id", F.format_string("scene_%04d", "scene_id"))
    known = spark.createDataFrame([("f", "associated_with", "e")], EDGE)
    none = spark.createDataFrame([], EDGE)
    got = {(r["subject_id"], r["object_id"]): r for r in graph.co_presence_edges(roster, none).collect()}
    assert got["a", "b"]["cooccurrence_scene_count"] == 3 and ("c", "d") not in got
    assert len(got["e", "f"]["evidence_refs"]) == 8 and got["e", "f"]["evidence_refs"][0] == "scene:scene_0010"
    assert ("e", "f") not in {(r["subject_id"], r["object_id"]) for r in graph.co_presence_edges(roster, known).collect()}
    assert graph.co_presence_edges(roster, none, most=1).collect()[0]["subject_id"] == "e"


def test_neighbors_loops_and_weights(spark):
    entities = spark.createDataFrame([(x, x.upper(), "character") for x in "abcd"], "entity_id string, canonical_name string, entity_type string")
    edges = graph.numbered_edges(spark.createDataFrame([("a", "family", "b", "m"), ("c", "knows", "a", "m"), ("a", "loops", "a", "m"), ("a", "knows", "z", "m")], EDGE + ", generation_method string"))
    found = graph.neighbors(edges, entities, "a")
    assert [(r["direction"], r["neighbor_id"]) for r in found.collect() if r["predicate"] == "loops"] == [("outgoing", "a")]
    assert found.count() == 4
    ranked = graph.ranked_neighbors(found).orderBy("place").collect()
    assert ranked[0]["predicate"] == "family" and all(r["neighbor_type"] == "character" for r in ranked)
    assert {r["edge_id"] for r in edges.collect()} == {"kg_00001", "kg_00002", "kg_00003", "kg_00004"}


def test_temporal_edges_by_hand(spark):
    events = spark.createDataFrame(
        [("e1", "s1", 1, "x"), ("e2", "s1", 2, "flashback_enter"), ("e3", "s1", 3, "x"), ("e4", "s2", 1, "flashback_return"), ("e5", "s9", 1, "flashback_enter")],
        "event_id string, scene_id string, sequence_in_scene int, label string",
    )
    scenes = spark.createDataFrame([("s1", 1), ("s2", 2)], "scene_id string, scene_index int")
    got = graph.temporal_edges(graph.positions(events, scenes))
    pairs = lambda kind: {(r["from_event"], r["to_event"]) for r in got.where(F.col("relation") == kind).collect()}
    assert pairs("precedes") == {("e1", "e2"), ("e2", "e3"), ("e3", "e4"), ("e4", "e5")}
    assert pairs("same_scene_next") == {("e1", "e2"), ("e2", "e3")}
    assert pairs("cross_scene_continuation") == {("e3", "e4"), ("e4", "e5")}
    assert pairs("flashback_to") == {("e2", "e3")} and pairs("returns_to_frame") == {("e4", "e5")}
    assert graph.numbered_temporal(got).agg(F.countDistinct("temporal_edge_id")).first()[0] == got.count()


def rule(**more):
    return {"rule_id": "r1", "subject_id": "a", "object_id": "b", "state_dimension": "trust", "direction": "increase", "claim_type": "explicit", "confidence": 0.9, "inference_method": "rule"} | more


def test_rule_validation():
    with pytest.raises(ValueError, match="lacks"):
        states.checked_rules([{"rule_id": "r"}])
    with pytest.raises(ValueError, match="not allowed"):
        states.checked_rules([rule(claim_type="guess")])
    assert states.checked_rules([rule(enabled=False), rule()]) == [rule()]


def test_rule_conditions(spark):
    def met(events, **more):
        df = spark.createDataFrame(events, "event_id string, scene_id string, position int, event_type_l1 string, event_type_l2 string, confidence double, haystack string, people array<string>, refs array<string>")
        return sorted(r["event_id"] for r in states.hits(df, states.rule_table(spark, [rule(**more)])).collect())

    e = [("e1", "s", 1, "talk", "question", 0.5, "don't do it", ["a", "b"], ["x"]), ("e2", "s", 2, "act", "shooting", 0.9, "don’t go", ["b", "a", "c"], ["y"]), ("e3", "s", 3, "act", "shooting", 0.9, "both", ["a"], ["z"])]
    assert met(e) == ["e1", "e2"]
    assert met(e, event_type_l2_any=["shooting"]) == ["e2"] and met(e, event_type_l2_not=["shooting"]) == ["e1"]
    assert met(e, event_type_l1_any=["talk"]) == ["e1"] and met(e, min_event_confidence=0.6) == ["e2"]
    assert met(e, text_any=["don't"]) == ["e1"], "quotes are not normalized"
    assert met(e, text_all=["do", "it"]) == ["e1"] and met(e, text_none=["go"]) == ["e1"]
    assert met(e, subject_id="b", object_id="a") == ["e1", "e2"]


def test_changes_group_in_order(spark):
    hits = spark.createDataFrame(
        [("e2", "s", 2, "k2", ["x2"], "a", "b", "r2", "trust", "increase", "explicit", None, "rule", 0.7), ("e1", "s", 1, "k1", ["x1", "x2"], "a", "b", "r1", "trust", "increase", "explicit", "low", "manual", 0.9)],
        "event_id string, scene_id string, position int, event_type_l2 string, refs array<string>, subject_id string, object_id string, r_rule_id string, r_state_dimension string, r_direction string, r_claim_type string, r_magnitude string, r_inference_method string, hit_confidence double",
    )
    r = states.numbered_changes(states.state_changes(hits)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["state_change_id"], r["confidence"], r["magnitude"], r["inference_method"]) == ("sc_000001", 0.9, "low", "manual")
    assert (r["trigger_event_ids"], r["evidence_refs"], r["rule_ids"]) == (["e1", "e2"], ["x1", "x2"], ["r1", "r2"])
    facets = {(x["facet"], x["value"]): x["n"] for x in states.facets(states.state_changes(hits)).collect()}
    assert facets["pair_directed", "a->b"] == 1 and facets["pair_undirected", "a<->b"] == 1
    core = states.core_pairs(states.state_changes(hits), spark.createDataFrame([("b", "a"), ("c", "d")], "subject_id string, object_id string")).collect()
    assert {(x["subject_id"], x["directed_count"], x["undirected_count"]) for x in core} == {("b", 0, 1), ("c", 0, 0)}


def test_pair_counts_whatever_a_task_takes(spark):
    rows = [(s, e) for s in range(12) for e in range(9) if (s * e) % 4 != 1 or e == 0] + [(None, 1), (None, 2), (50, 3)]
    roster = spark.createDataFrame(rows, "s long, e long")
    want = {}
    for s, a in rows:
        for t, b in rows:
            if s is not None and s == t and a < b:
                want.setdefault((a, b), []).append(s)
    for size in (1, 20, 1000):
        found = graph.pair_counts(roster, scene="s", entity="e", with_scenes=True, task_pairs=size).collect()
        assert {(r["subject_id"], r["object_id"]): (r["n"], r["scene_ids"]) for r in found} == {k: (len(v), sorted(v)[:8]) for k, v in want.items()}
    plan = graph.pair_counts(roster, scene="s", entity="e")._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_pair_options_lists_every_pair(spark, tmp_path):
    from plotweave.plans import catalog

    spark.createDataFrame([(o, s) for o in range(3) for s in range(1, 31)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, f"Supplier {s:02d}") for s in range(1, 31)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.QUERIES["pair_options"](spark, str(tmp_path)).collect()
    want = [(f"{a}::{b}", 3, f"Supplier {a:02d} <> Supplier {b:02d}") for a in range(1, 31) for b in range(a + 1, 31)]
    assert len(want) == 435 and list(map(tuple, got)) == want
    assert "LIMIT" not in catalog.ORACLES["pair_options"]
