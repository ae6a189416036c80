import json

from plotweave.operators import contracts as C

ROWS = [
    {"event_id": "e1", "scene_id": "s1", "event_type_l1": "a", "event_type_l2": "b", "summary": "x", "sequence_in_scene": 1, "confidence": 0.5},
    {"event_id": "e1", "scene_id": " ", "event_type_l1": "a", "event_type_l2": "b", "summary": "x", "sequence_in_scene": 0, "confidence": 1.5},
    {"event_id": "e2", "event_type_l1": "a", "event_type_l2": "b", "summary": "x", "sequence_in_scene": "two", "confidence": 0.1},
]


def told(df):
    return {(r["rule"], r["field"]): r["faults"] for r in df.collect() if not r["ok"]}


def test_json_rows_of_other_kinds_are_counted_and_named(spark, tmp_path):
    (tmp_path / "events.json").write_text("\n".join([*map(json.dumps, ROWS), "{ not json"]))
    contract = C.ARTIFACTS["events"]
    rows = C.read_json(spark, str(tmp_path / "events.json"), contract).cache()
    got = told(C.checked(rows, contract))
    assert got[("corrupt", C.CORRUPT)] == 2 and got[("key", "event_id")] == 1 and got[("least", "sequence_in_scene")] == 1 and got[("most", "confidence")] == 1
    assert got[("required", "scene_id")] == 3 and got[("required", "sequence_in_scene")] == 2
    broken = {r["event_id"]: r["broken"] for r in C.broken_rows(rows, contract).where("confidence = 1.5").collect()}
    assert broken == {"e1": ["required:scene_id", "least:sequence_in_scene", "most:confidence"]}


def test_records_columns_and_what_must_occur(spark):
    contract = C.Contract("t", {"a": C.Field("string", allowed=("x", "y")), "b": C.Field("double", required=False), "c": C.Field("long")}, key=("a",), records=3, covers={"a": ("x", "z")})
    rows = spark.createDataFrame([("x", 1.0), ("q", float("nan")), (None, float("inf")), (None, None)], "a string, b double")
    assert told(C.checked(rows, contract)) == {("required", "a"): 2, ("finite", "b"): 2, ("allowed", "a"): 1, ("present", "c"): 1, ("records", ""): 1, ("covers", "a=z"): 1, ("key", "a"): 1}
    assert told(C.checked(rows.limit(0), contract)) == {("present", "c"): 1, ("records", ""): 3, ("covers", "a=x"): 1, ("covers", "a=z"): 1}
