from pyspark.sql import functions as F

from plotweave.operators import cleaning, entities, events, rules, segment, spans

SCRIPT = """INT. ASSISTED LIVING - DAY - 2000
FRANK V/O
I heard you paint houses.
RUSSELL
Where are you from, Peggy?
FRANK (CONT'D)
Philadelphia.
A gunshot rings out. Peggy Sheeran runs.
EXT. ROAD - DAY - FLASHBACK
BACK TO:
Frank drives the truck.
"""


def classes(spark, texts, kind="utterance", **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    none = F.lit("")
    c = rules.utterance_rules(text=F.col("text"), cue=F.lit(more.get("cue", "")), modifiers=F.array(*map(F.lit, more.get("modifiers", ()))).cast("array<string>"), location=F.lit(more.get("location", "")), header=none, answers=F.lit(more.get("answers", False))) if kind == "utterance" else rules.action_rules(text=F.col("text"), location=F.lit(more.get("location", "")), header=none, flags=F.array(*map(F.lit, more.get("flags", ()))).cast("array<string>"))
    return [r[0] for r in df.orderBy("k").select(rules.first_match(c)["label"]).collect()]


def test_utterance_cascade(spark):
    assert classes(spark, ["Why me?", "Really?", "Hello there", "Goodbye now", "I’m sorry", "I swear it", "You idiot", "He is dead", "Can you come", "Go home", "Be careful", "No", "Okay then", "A toast", "You gotta see", "What a price", "It was me", "Ladies and gentlemen", "It rains", "x " * 120]) == [
        "question", "question", "phone_call_conversation", "farewell_or_closing", "apology_or_regret", "promise_or_vow", "insult_or_disrespect", "threat_verbal", "request", "instruction_order", "warning", "refusal", "agreement_acceptance", "joke_banter_or_toast", "persuasion_attempt", "negotiation", "confession_or_admission", "public_speech_or_address", "statement", "explanation_account",
    ]
    assert classes(spark, ["Anything"], modifiers=("pre_lap", "voice_over")) == ["prelap_audio_transition"]
    assert classes(spark, ["Anything"], modifiers=("voice_over",), location="ASSISTED LIVING") == ["frame_narration_segment"]
    assert classes(spark, ["Fine day", "y" * 261], answers=True) == ["answer_response", "explanation_account"]
    assert classes(spark, ["Is it true?"], cue="REPORTER #2") == ["press_qna_exchange"]


def test_action_cascade(spark):
    assert classes(spark, ["Back to the bar", "A flashback", "He died", "Shots fired", "They murder him", "A pistol", "High-kicking dancer on stage", "He will beat him", "The judge", "Union crowd", "The truck", "He drives", "He leaves", "A wedding", "He smokes a cigarette", "He nods", "She watches", "Nothing here"], kind="action") == [
        "structural_callback_or_rejoin", "flashback_enter", "death_event", "shooting", "homicide_killing", "weapon_display_or_preparation", "observation_or_witnessing", "assault_or_beating", "court_appearance", "public_event_or_rally", "work_shift_or_job_task", "drive_or_vehicle_travel", "departure", "wedding_related_event", "smoking_break_or_smoking_conflict", "deference_signal", "observation_or_witnessing", "observation_or_witnessing",
    ]
    assert classes(spark, ["Back to the bar"], kind="action", flags=("flashback",)) == ["flashback_return"]


def test_taxonomy_has_every_label(spark):
    none = F.lit("")
    made = {r[0] for r in rules.utterance_rules(text=none, cue=none, modifiers=F.array(), location=none, header=none, answers=F.lit(False))} | {r[0] for r in rules.action_rules(text=none, location=none, header=none, flags=F.array())}
    known = {r[0] for r in rules.taxonomy(spark).select("event_type_l2").collect()}
    assert made <= known
    got = rules.mapped(spark.createDataFrame([("question",), ("nope",)], "label string"), rules.taxonomy(spark)).collect()
    assert {(r["label"], r["event_type_l2"]) for r in got} == {("question", "question"), ("nope", rules.UNMAPPED_L2)}


def test_mentions_prefer_earlier_then_longer(spark):
    names = spark.createDataFrame([("bill", "Bill Bufalino"), ("russ", "Bufalino"), ("pat", "Pat"), ("fbi", "FBI")], "entity_id string, name string")
    texts = spark.createDataFrame([(1, "Bill Bufalino met the fbi; Patty saw Pat."), (2, "bufalinos nothing"), (3, "Russell’s Bufalino")], "k int, text string")
    got = {r["k"]: r["mentions"] for r in spans.mentions(texts, names, key="k", text="text").collect()}
    assert got == {1: ["bill", "fbi", "pat"], 3: ["russ"]}


def test_detection_takes_the_longest_first(spark):
    lexicon = spark.createDataFrame([("jimmy", "jimmy hoffa", 100), ("hoffa", "hoffa", 90), ("f", "frank", 90)], "entity_id string, phrase string, priority int")
    got = spans.detected(spark.createDataFrame([(1, "frank and jimmy hoffa and frank")], "k int, text string"), lexicon, key="k", text="text").orderBy("place").collect()
    assert [r["entity_id"] for r in got] == ["f", "jimmy"]


def test_script_to_events(spark):
    lines = cleaning.document_lines(spark.createDataFrame([("d", SCRIPT)], "doc_id string, text string"))
    blocks = segment.blocks(lines)
    scenes = segment.scenes(blocks, lines)
    seed = spark.createDataFrame([("char_frank_sheeran", "character", "Frank Sheeran", ["FRANK"]), ("char_peggy_sheeran", "character", "Peggy Sheeran", ["Peggy"])], "entity_id string, entity_type string, canonical_name string, aliases array<string>")
    exact = spark.createDataFrame([("FRANK", "char_frank_sheeran")], "alias_raw string, entity_id string")
    normal = spark.createDataFrame([("FRANK", "char_frank_sheeran")], "alias_normalized string, entity_id string")
    cues = entities.resolved_cues(segment.utterances(blocks), exact, normal)
    kinds = {r["raw"]: (r["entity_id"], r["alias_kind"]) for r in cues.collect()}
    assert kinds["FRANK V/O"] == ("char_frank_sheeran", "manual_normalized") and kinds["RUSSELL"] == ("char_russell", "auto_from_cue")
    aliases = entities.alias_ids(entities.alias_records(cues))
    people = entities.characters(cues, seed)
    names = {r["entity_id"]: (r["canonical_name"], r["utterance_count"]) for r in people.collect()}
    assert names == {"char_frank_sheeran": ("Frank Sheeran", 2), "char_russell": ("Russell", 1), "char_peggy_sheeran": ("Peggy Sheeran", 0)}
    assert {r["entity_id"] for r in entities.locations(scenes).collect()} == {"loc_assisted_living", "loc_road"}
    got = events.extracted(blocks, scenes, aliases, people, rules.taxonomy(spark)).orderBy("event_id").collect()
    labels = [(r["scene_id"], r["label"]) for r in got]
    assert labels == [
        ("scene_0001", "scene_entry"), ("scene_0001", "time_jump_explicit"), ("scene_0001", "frame_narration_segment"), ("scene_0001", "question"), ("scene_0001", "answer_response"), ("scene_0001", "scene_exit"),
        ("scene_0002", "scene_entry"), ("scene_0002", "flashback_enter"), ("scene_0002", "flashback_return"), ("scene_0002", "scene_exit"),
    ]
    question = next(r for r in got if r["label"] == "question")
    assert [(p["entity_id"], p["role"]) for p in question["participants"]] == [("char_russell", "speaker"), ("char_peggy_sheeran", "target"), ("char_frank_sheeran", "listener"), ("loc_assisted_living", "location")]
    assert got[0]["event_id"] == "evt_000001" and got[0]["evidence_ref"] == "evref_000001"
    df = events.extracted(blocks, scenes, aliases, people, rules.taxonomy(spark))
    assert events.bridge(df).where("participant_index = 1").count() == df.where(F.size("participants") > 0).count()
    rolled = {r["scene_id"]: r for r in events.scene_rollup(df).collect()}
    assert rolled["scene_0001"]["event_count"] == len([x for x in labels if x[0] == "scene_0001"]) and rolled["scene_0001"]["event_type_l2_counts"]["question"] == 1


def test_entities_of_one_phrase_do_not_multiply(spark, monkeypatch):
    """As many customers of one name as questions about it: one of them meets the questions, the one of highest priority and least id."""
    rows = [(f"c{k:03d}", "Twin Name", 100 if k >= 5 else 70) for k in range(60)] + [("x", "twin", 70)]
    met, matches = [], spans.phrase_matches
    monkeypatch.setattr(spans, "phrase_matches", lambda texts, phrases, **kw: met.append(phrases.count()) or matches(texts, phrases, **kw))
    questions = spark.createDataFrame([(k, "is twin name a twin?") for k in range(60)], "k int, text string")
    got = spans.detected(questions, spark.createDataFrame(rows, "entity_id string, phrase string, priority int"), key="k", text="text").collect()
    assert met == [2]
    assert sorted((r["k"], r["entity_id"], r["start"]) for r in got) == [(k, "c005", 3) for k in range(60)]
