"""Answers to a whole table of questions in one plan: routing, entities, graph, trace, hybrid and retrieval answers.

A question is a row (question_id, question, preferred_mode, include_evidence, include_baseline); an
answer is a row of typed columns. Questions that ask the same of the tables share the work: graph
answers are made once for each entity asked for, state changes once for each pair or entity,
timelines once for each filter of entity, pair and year. Kinds of answers that no question asks
for are not planned at all. Lists are cut by limits within groups, on keys and places alone before
texts meet them; retrieval is an inverted index with early termination.

Texts that readers see, weights, limits and confidences are fixed values. A null or empty question
is answered as the router answers an empty text: a fact without an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import ordered_distinct, pair_key, squeeze, strip, year_in
from plotweave.operators import graph, retrieval, router, spans, substrings
from plotweave.operators.answers import Narrative, lexicon
from plotweave.operators.search import LATE, people, scene_year
from plotweave.sources.staging import staged

LISTS = ("entities_used", "events_used", "state_changes_used", "evidence_refs")

# What readers see of an answer.
ROUTES = {
    "timeline": "Timeline/order query depends on event chronology and temporal edges (NTG).",
    "state_change": "State-change query depends on inferred relationship shifts over time (NTG).",
    "causal_chain": "Causal-chain query benefits from NTG chronology plus KG entity context (hybrid).",
    "evidence": "Evidence query can require tracing prior answer structures plus source snippets (hybrid).",
    "comparison": "Comparison query is best answered by contrasting graph and baseline behavior (hybrid).",
}
FACT_WITH, FACT_WITHOUT = "Fact-style query with entity mention routes to KG.", "Fact-style query defaults to KG lookup."
BASELINE_ROUTE = "Baseline comparator generated for side-by-side deterministic comparison."
KG_NOTES = "KG mode returns canonical entities and relationship edges (static/semi-stable/volatile) without timeline sequencing."
KG_SEARCH_NOTES = "KG mode fell back to entity-name search because no specific graph neighborhood target was detected."
CHANGE_NOTES = "NTG mode answered using inferred state changes linked to trigger events and evidence refs; inferred vs explicit claims remain labeled."
NO_CHANGE_NOTES = "NTG state-change retrieval returned zero rows for the inferred pair/entity filters."
TIMELINE_NOTES = "NTG mode answered using scene/event ordering plus temporal edges and evidence-linked event nodes."
CHAIN_NOTES = "NTG mode provided a heuristic chain using filtered event order and state-change overlays."
NO_EVENT_NOTES = "Timeline/event search returned zero rows for the current query filters."
EVIDENCE_NOTES = "NTG evidence response selected events and surfaced their evidence refs/snippets directly."
HYBRID_NOTES = "Hybrid mode combined KG entity-relationship facts with NTG chronology/state-change evidence to answer a query that spans both structures."
BASELINE_NOTES = "Baseline RAG-like mode ranked event summaries, script blocks, and state-change labels by lexical overlap with the question."
NO_CHANGE_TEXT = "No inferred state changes matched the current question filters. Try specifying a relationship pair (for example Frank and Peggy) or a dimension like trust/fear/distance."
NO_EVENT_TEXT = "No matching timeline events were found. Try adding a character name, event type, or year."
CHAIN_TEXT = "This is a heuristic chain assembled from filtered event order and state-change overlays; it is not a formal causal proof."
NO_MATCH_TEXT = "Baseline retrieval found no strong lexical matches for this question. Try a more specific entity name or scene/event phrase."
BASELINE_TEXT = "This baseline is lexical retrieval only; it does not explicitly model temporal edges or inferred relationship state changes."
NO_REFS = "Warning: no evidence refs were available for some cited rows in this deterministic pass."
OMITTED = "Evidence refs omitted by request."


def no_strings() -> Column:
    return F.array().cast("array<string>")


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("...")))


def shown(names: Column, most: int = 4) -> Column:
    kept = F.filter(names, lambda x: x != "")
    more = F.concat(F.lit(" (+"), (F.size(kept) - most).cast("string"), F.lit(" more)"))
    return F.when(F.size(kept) == 0, "no matched entities").otherwise(F.concat(F.array_join(F.slice(kept, 1, most), ", "), F.when(F.size(kept) > most, more).otherwise("")))


def listed(*columns: str) -> Column:
    """An aggregate: the structs of the columns in order of the first ones."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def field(c: str, name: str) -> Column:
    return F.transform(c, lambda x: x[name])


def text(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def contexts(questions: DataFrame, n: Narrative, hints: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The questions with query_type, mode_used, ids and names of their entities in order of place, focus, pair, year, and keys of what they ask for."""
    asked = questions.withColumn("question", F.coalesce("question", F.lit("")))
    routed = staged(router.routed(asked, question="question", wanted="preferred_mode"), "routed")
    plain = routed.select("question_id", F.lower(squeeze("question")).alias("_text"))
    found = spans.detected(plain, lexicon(n.entities, n.aliases, hints), key="question_id", text="_text").join(n.entities.select("entity_id", "canonical_name"), "entity_id")
    named = found.groupBy("question_id").agg(listed("start", "canonical_name", "entity_id").alias("_found"))
    out = routed.join(named, "question_id", "left").select("*", F.coalesce(field("_found", "entity_id"), no_strings()).alias("ids"), F.coalesce(field("_found", "canonical_name"), no_strings()).alias("names")).drop("_found")
    first, second = F.try_element_at("ids", F.lit(1)), F.try_element_at("ids", F.lit(2))
    pair = F.when(second.isNotNull(), pair_key(first, second))
    out = out.select("*", first.alias("focus"), pair.alias("pair"), year_in("question").alias("year"))
    # Timeline questions are not looked for as text; state changes have no filter by text or year.
    words = F.when(~F.col("query_type").isin("timeline", "state_change"), F.nullif(F.lower(strip("question")), F.lit("")))
    filters = F.concat_ws("|", F.coalesce("focus", F.lit("")), F.coalesce("pair", F.lit("")), F.coalesce(text("year"), F.lit("")))
    out = out.select("*", words.alias("words"), filters.alias("filter_id"), F.coalesce("pair", "focus", F.lit("")).alias("change_key"))
    return out.withColumn("trace_key", F.when(F.col("words").isNull(), F.concat(F.lit("f:"), "filter_id")).otherwise(F.concat(F.lit("q:"), text("question_id"))))


def core(rows: DataFrame, answer_text: Column, confidence: Column, notes: Column, **lists: Column) -> DataFrame:
    """question_id and an answer's columns; lists that are not given are empty."""
    return rows.select("question_id", answer_text.alias("answer_text"), confidence.cast("double").alias("confidence"), *(F.coalesce(lists.get(x, no_strings()), no_strings()).alias(x) for x in LISTS), notes.alias("reasoning_notes"))


# Graph answers.


def graph_views(edges: DataFrame, entities: DataFrame, focuses: DataFrame, most: int = 8, persons: int = 6) -> DataFrame:
    """focus, view (array of the shown edges in order), total, name: each asked entity's weightiest edges, with three characters or more characters only."""
    kept = edges.select("edge_id", "predicate", "subject_id", "object_id", "stability", F.coalesce("evidence_refs", no_strings()).alias("refs"))
    out = kept.join(focuses, F.col("subject_id") == F.col("focus")).select("focus", "edge_id", "predicate", F.lit("out").alias("way"), F.col("object_id").alias("neighbor"), "stability", "refs", "object_id")
    into = kept.where("subject_id <> object_id").join(focuses, F.col("object_id") == F.col("focus")).select("focus", "edge_id", "predicate", F.lit("in").alias("way"), F.col("subject_id").alias("neighbor"), "stability", "refs", "object_id")
    both = out.unionByName(into)
    names = entities.select(F.col("entity_id").alias("neighbor"), F.col("canonical_name").alias("neighbor_name"), F.col("entity_type").alias("neighbor_type"))
    told = both.join(names, "neighbor", "left").withColumns({"minus_weight": -graph.predicate_weight(F.lower("predicate")), "shown_name": F.coalesce("neighbor_name", "edge_id")})
    best = Window.partitionBy("focus").orderBy("minus_weight", "shown_name", "edge_id")
    top = told.withColumn("at", F.row_number().over(best)).where(F.col("at") <= most).groupBy("focus").agg(listed("at", "way", "predicate", "neighbor", "neighbor_name", "neighbor_type", "stability", "refs", "object_id").alias("rows"))
    characters = F.filter("rows", lambda r: r["neighbor_type"] == "character")
    view = F.when(F.size(characters) >= 3, F.slice(characters, 1, persons)).otherwise(F.col("rows"))
    totals = both.groupBy("focus").agg(F.count("*").alias("total"))
    named = focuses.join(entities.select(F.col("entity_id").alias("focus"), F.col("canonical_name").alias("name")), "focus")
    return named.join(top.select("focus", view.alias("view")), "focus", "left").join(totals, "focus", "left").select("focus", "name", F.coalesce("view", F.array().cast(top.select(view).schema[0].dataType)).alias("view"), F.coalesce("total", F.lit(0)).alias("total"))


def graph_answers(asked: DataFrame, n: Narrative) -> DataFrame:
    views = graph_views(n.edges, n.entities, asked.where("focus is not null").select("focus").distinct())
    size = F.size("view")
    refs = lambda r: F.when(F.size(r["refs"]) > 0, F.concat(F.lit(", evidence refs: "), text(F.size(r["refs"])))).otherwise("")
    who = lambda r: F.coalesce(F.concat(r["neighbor_name"], F.lit(" ("), r["neighbor_type"], F.lit(")")), r["object_id"])
    lines = F.transform("view", lambda r, i: F.concat(text(i + 1), F.lit(". ["), r["way"], F.lit("] "), r["predicate"], F.lit(" -> "), who(r), F.lit(" ["), r["stability"], F.lit("]"), refs(r)))
    head = F.concat(F.lit("KG view of "), "name", F.lit(": "), text(size), F.lit(" high-signal relationship(s) from the local graph artifact."))
    tail = F.when(F.col("total") > size, F.array(F.concat(F.lit("Additional relationships omitted for brevity: "), text(F.col("total") - size), F.lit(".")))).otherwise(no_strings())
    made = views.select("focus", F.array_join(F.concat(F.array(head), lines, tail), "\n").alias("_answer"), F.least(F.lit(0.95), 0.55 + 0.05 * size).alias("_sure"), F.concat(F.array("focus"), F.transform(F.filter("view", lambda r: r["neighbor_name"].isNotNull()), lambda r: r["neighbor"])).alias("_ids"), F.flatten(field("view", "refs")).alias("_refs"))
    direct = core(asked.join(made, "focus"), F.col("_answer"), F.col("_sure"), F.lit(KG_NOTES), entities_used=F.col("_ids"), evidence_refs=F.col("_refs"))
    # Without an entity: entities whose name, id or an alias contains the whole question.
    lost = asked.where("focus is null")
    if lost.isEmpty():
        return direct
    said = n.entities.select("entity_id", F.array_join(F.concat(F.array("canonical_name", "entity_id"), F.coalesce("aliases", no_strings())), "\x00").alias("_said"))
    pairs = substrings.contained(lost.select("question_id", strip("question").alias("_q")), said, needle_key="question_id", needle="_q", key="entity_id", text="_said", few=substrings.FEW_NEEDLES)
    # An empty question looks for nothing and so lists from all entities.
    first = n.entities.orderBy("entity_type", "canonical_name", "entity_id").limit(5).select("entity_id")
    pairs = pairs.unionByName(lost.where(strip("question") == "").select("question_id").join(first))
    rank = Window.partitionBy("question_id").orderBy("entity_type", "canonical_name", "entity_id")
    top = pairs.join(n.entities.select("entity_id", "canonical_name", "entity_type"), "entity_id").withColumn("at", F.row_number().over(rank)).where("at <= 5").groupBy("question_id").agg(listed("at", "canonical_name", "entity_type", "entity_id").alias("top"))
    found = F.size(F.coalesce("top", F.array().cast(top.schema["top"].dataType))) > 0
    rows = F.transform("top", lambda e: F.concat(text(e["at"]), F.lit(". "), e["canonical_name"], F.lit(" ("), e["entity_type"], F.lit(") ["), e["entity_id"], F.lit("]")))
    hit = F.concat(F.array(F.lit("KG entity search candidates for this question (no direct focus entity detected):")), rows, F.array(F.lit('Ask with a specific entity name (for example "Frank Sheeran" or "Jimmy Hoffa") for relationship neighbors.')))
    miss = F.array(F.lit("No direct entity match detected for this fact-style query."), F.lit("Try including a specific person or organization name to retrieve KG relationships."))
    answer = F.array_join(F.transform(F.when(found, hit).otherwise(miss), lambda x: cut(x, 220)), "\n")
    return direct.unionByName(core(lost.join(top, "question_id", "left"), answer, F.when(found, 0.42).otherwise(0.2), F.lit(KG_SEARCH_NOTES), entities_used=F.concat("ids", F.coalesce(field("top", "entity_id"), no_strings()))))


# Trace answers.


def change_answers(asked: DataFrame, n: Narrative, most: int = 8) -> DataFrame:
    """Answers to questions after state changes, made once for each pair, entity, or for all."""
    keys = asked.select("change_key").distinct()
    ends = F.array_distinct(F.array("subject_id", "object_id", F.when(F.col("subject_id") != F.col("object_id"), pair_key("subject_id", "object_id"))))
    keyed = n.changes.withColumn("change_key", F.explode(F.array_compact(ends))).join(keys.where("change_key <> ''"), "change_key")
    totals = keyed.groupBy("change_key").agg(F.count("*").alias("filtered")).unionByName(n.changes.agg(F.count("*").alias("filtered")).select(F.lit("").alias("change_key"), "filtered"))
    placed = keyed.withColumn("at", F.row_number().over(Window.partitionBy("change_key").orderBy("state_change_id"))).where(F.col("at") <= most)
    # What all questions without an entity get is one list, not a group of all changes.
    every = n.changes.orderBy("state_change_id").limit(most).withColumn("change_key", F.lit("")).withColumn("at", F.row_number().over(Window.partitionBy("change_key").orderBy("state_change_id")))
    top = staged(placed.unionByName(every.select(placed.columns)).select("change_key", "at", "state_change_id", "subject_id", "object_id", "state_dimension", "direction", "magnitude", "claim_type", "confidence", "scene_id", "trigger_event_ids", "evidence_refs"), "top-changes")
    names = lambda c: n.entities.select(F.col("entity_id").alias(f"{c}_id"), F.col("canonical_name").alias(f"{c}_name"))
    steps = top.select("change_key", "at", F.posexplode("trigger_event_ids").alias("pos", "event_id")).join(n.events.select("event_id", "event_type_l2", F.col("scene_id").alias("event_scene"), "sequence_in_scene"), "event_id")
    led = steps.groupBy("change_key", "at").agg(listed("pos", "event_id", "event_type_l2", "event_scene", "sequence_in_scene").alias("led"))
    full = top.join(names("subject"), "subject_id", "left").join(names("object"), "object_id", "left").join(n.scenes.select("scene_id", "header_raw"), "scene_id", "left").join(led, ["change_key", "at"], "left")
    triggers = F.array_join(F.transform(F.slice("led", 1, 2), lambda e: F.concat(e["event_type_l2"], F.lit(" ("), e["event_scene"], F.lit("/"), text(e["sequence_in_scene"]), F.lit(")"))), "; ")
    line = F.concat(
        F.lit("- "), F.coalesce("subject_name", "subject_id"), F.lit(" -> "), F.coalesce("object_name", "object_id"), F.lit(": "), "state_dimension", F.lit(" "), "direction",
        F.when(F.coalesce("magnitude", F.lit("")) != "", F.concat(F.lit(" ("), "magnitude", F.lit(")"))).otherwise(""), F.lit(" ["), "claim_type", F.lit("] in "), F.coalesce("header_raw", "scene_id"),
        F.lit(" (conf "), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit(")."), F.when(F.coalesce(triggers, F.lit("")) != "", F.concat(F.lit(" Triggers: "), triggers, F.lit("."))).otherwise(""),
    )
    made = full.select("change_key", "at", cut(line, 320).alias("line"), "state_change_id", F.array("subject_id", "object_id").alias("both"), F.coalesce(field("led", "event_id"), no_strings()).alias("events"), F.coalesce("evidence_refs", no_strings()).alias("refs"))
    views = made.groupBy("change_key").agg(listed("at", "line", "state_change_id", "both", "events", "refs").alias("rows")).join(totals, "change_key")
    rows = asked.join(views, "change_key", "left")
    size = F.when(F.col("rows").isNull(), 0).otherwise(F.size("rows"))
    head = F.concat(F.lit("NTG state-change view ("), text(size), F.lit(" of "), text("filtered"), F.lit(" matching changes) for "), shown(F.col("names")), F.lit("."))
    tail = F.when(F.col("filtered") > size, F.array(F.concat(F.lit("Additional matching state changes omitted: "), text(F.col("filtered") - size), F.lit(".")))).otherwise(no_strings())
    answer = F.when(size == 0, NO_CHANGE_TEXT).otherwise(F.array_join(F.concat(F.array(cut(head, 320)), field("rows", "line"), tail), "\n"))
    return core(
        rows, answer, F.when(size == 0, 0.25).otherwise(F.least(F.lit(0.92), 0.58 + size * 0.04)), F.when(size == 0, NO_CHANGE_NOTES).otherwise(CHANGE_NOTES), entities_used=F.concat("ids", F.coalesce(F.flatten(field("rows", "both")), no_strings())),
        events_used=F.flatten(field("rows", "events")), state_changes_used=field("rows", "state_change_id"), evidence_refs=F.flatten(field("rows", "refs")),
    )


def meets(ids: Column, focus: str = "focus", pair: str = "pair") -> Column:
    """Whether an event's people meet a question's entity and pair."""
    a, b = F.split_part(F.col(pair), F.lit("::"), F.lit(1)), F.split_part(F.col(pair), F.lit("::"), F.lit(2))
    return (F.col(focus).isNull() | F.array_contains(ids, F.col(focus))) & (F.col(pair).isNull() | ((a != b) & F.array_contains(ids, a) & F.array_contains(ids, b)))


#: The order of events in time.
IN_TIME = ("_scene_at", "sequence_in_scene", "event_id")


def filtered_events(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """filter_id, scene_id and an event's place: the events of each filter of entity, pair and year that is not empty. placed: events with _people and _year."""
    filters = asked.select("filter_id", "focus", "pair", "year").distinct()
    kept = ["filter_id", "scene_id", *IN_TIME]
    roster = placed.select("scene_id", *IN_TIME, "_year", "_people", F.explode(F.array_distinct("_people")).alias("_person"))
    by_focus = filters.where("focus is not null").join(roster, F.col("focus") == F.col("_person")).where(meets(F.col("_people")) & (F.col("year").isNull() | (F.col("year") == F.col("_year")))).select(kept)
    by_year = filters.where("focus is null and year is not null").join(placed.select("scene_id", *IN_TIME, "_year"), F.col("year") == F.col("_year")).select(kept)
    return by_focus.unionByName(by_year)


def told_events(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """trace_key and an event's place: the events of each text with its filter. placed: events with _people, _year and _said, what a text is looked for in."""
    said = substrings.contained(texts.select("question_id", "words"), placed.select("event_id", "_said"), needle_key="question_id", needle="words", key="event_id", text="_said", few=substrings.FEW_NEEDLES)
    wanted = said.join(texts.select("question_id", "trace_key", "focus", "pair", "year"), "question_id").join(placed.select(*IN_TIME, "_people", "_year"), "event_id")
    return wanted.where(meets(F.col("_people")) & (F.col("year").isNull() | (F.col("year") == F.col("_year")))).select("trace_key", *IN_TIME)


def trace_answers(asked: DataFrame, n: Narrative) -> DataFrame:
    """Answers from events in order: timelines, chains, and evidence."""
    scenes = n.scenes.select("scene_id", "scene_index", "header_raw", "year_explicit", "year_inferred", scene_year().alias("_year"))
    facts = (n.events if "scene_index" not in n.events.columns else n.events.drop("scene_index")).join(scenes.select("scene_id", F.col("scene_index").alias("_scene_at"), F.col("header_raw").alias("_header"), "_year"), "scene_id", "left")
    said = F.array_join(F.concat(F.array("event_id", "event_type_l1", "event_type_l2", "summary"), F.coalesce("snippets", no_strings())), "\x00")
    placed = staged(facts.select("event_id", "scene_id", F.coalesce("_scene_at", F.lit(LATE)).alias("_scene_at"), "_header", "_year", "sequence_in_scene", "event_type_l2", "summary", people().alias("_people"), F.coalesce(F.try_element_at("snippets", F.lit(1)), F.lit("")).alias("_snippet"), F.coalesce("evidence_refs", no_strings()).alias("_refs"), said.alias("_said")), "placed-events")
    by_filter = filtered_events(asked, placed)
    keyed = by_filter.select(F.concat(F.lit("f:"), "filter_id").alias("trace_key"), *IN_TIME)
    texts = asked.where("words is not null")
    if not texts.isEmpty():
        keyed = told_events(texts, placed).unionByName(keyed)
    limits = asked.select("trace_key", F.when(F.col("query_type") == "evidence", 14).otherwise(40).alias("most")).distinct()
    # Places are enough to tell which events are listed; the rest of an event meets those that are.
    ranked = keyed.join(limits, "trace_key").withColumn("at", F.row_number().over(Window.partitionBy("trace_key").orderBy(*IN_TIME))).where("at <= 40").where("at <= most").select("trace_key", "at", "event_id")
    # Questions without any filter get the first of all events: one list.
    every = placed.select(*IN_TIME).orderBy(*IN_TIME).limit(40).withColumns({"trace_key": F.lit("f:||"), "at": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*IN_TIME))})
    first = staged(ranked.unionByName(every.select(ranked.columns)), "first-events")
    listed_events = staged(first.join(placed, "event_id"), "listed-events")
    triggered = n.changes.select("state_change_id", F.explode("trigger_event_ids").alias("event_id")).join(listed_events.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.sort_array(F.collect_set("state_change_id")).alias("_changes"))
    rows = listed_events.join(triggered, "event_id", "left").withColumn("_changes", F.coalesce("_changes", no_strings()))
    views = rows.groupBy("trace_key").agg(listed("at", "event_id", "event_type_l2", "scene_id", "_header", "summary", "_snippet", "_refs", "_people", "_changes").alias("rows"))
    scene_lines = scene_views(asked.where("query_type <> 'evidence'"), n, placed, by_filter, rows)
    all_rows = asked.join(views, "trace_key", "left").join(scene_lines, "trace_key", "left")
    top = F.slice(F.coalesce("rows", F.array().cast(views.schema["rows"].dataType)), 1, F.when(F.col("query_type") == "causal_chain", 10).otherwise(8))
    told = all_rows.withColumns({"_top": top, "_scenes": F.coalesce("scene_lines", no_strings())})
    size = F.size("_top")
    lists = {"entities_used": F.concat("ids", F.flatten(field("_top", "_people"))), "events_used": field("_top", "event_id"), "state_changes_used": F.flatten(field("_top", "_changes")), "evidence_refs": F.flatten(field("_top", "_refs"))}
    proof = told.where("query_type = 'evidence'")
    head = F.concat(F.lit("Evidence-centric NTG response ("), text(size), F.lit(" event(s)) for "), shown(F.col("names")), F.lit("."))
    lines = F.transform("_top", lambda e, i: F.concat(text(i + 1), F.lit(". "), e["event_id"], F.lit(" "), e["event_type_l2"], F.lit(" in "), F.coalesce(e["_header"], e["scene_id"]), F.lit(" [refs: "), text(F.size(e["_refs"])), F.lit("] "), cut(F.when(e["_snippet"] != "", e["_snippet"]).otherwise(e["summary"]), 180)))
    out = core(proof, F.array_join(F.concat(F.array(head), lines), "\n"), F.when(size > 0, F.least(F.lit(0.86), 0.45 + size * 0.04)).otherwise(0.2), F.lit(EVIDENCE_NOTES), **lists)
    chain = F.col("query_type") == "causal_chain"
    none = (size == 0) & (F.size("_scenes") == 0)
    title = F.concat(F.when(chain, "Heuristic event chain (NTG) for ").otherwise("Scene-ordered NTG timeline slice for "), shown(F.col("names")), F.lit(":"))
    answer = F.array_join(F.transform(F.concat(F.array(title), "_scenes", F.when(chain, F.array(F.lit(CHAIN_TEXT))).otherwise(no_strings())), lambda x: cut(x, 360)), "\n")
    sure = F.least(F.lit(0.88), 0.5 + F.least(size, F.lit(10)) * 0.03)
    notes = F.when(none, NO_EVENT_NOTES).when(F.col("query_type") == "timeline", TIMELINE_NOTES).otherwise(CHAIN_NOTES)
    return out.unionByName(core(told.where("query_type <> 'evidence'"), F.when(none, NO_EVENT_TEXT).otherwise(answer), F.when(none, 0.22).otherwise(sure), notes, **lists))


def scene_views(asked: DataFrame, n: Narrative, placed: DataFrame, by_filter: DataFrame, rows: DataFrame, most: int = 6, events: int = 3) -> DataFrame:
    """trace_key, scene_lines: the first scenes that a filter meets, each with its first events, and how many changes the listed events led to."""
    filters = asked.select("filter_id", "focus", "pair", "year").distinct()
    scenes = n.scenes.select("scene_id", "scene_index", "header_raw", scene_year().alias("_year"))
    ends = n.changes.select("scene_id", "subject_id", "object_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("_end"))
    own_pair = F.col("pair").isNull() | ((F.col("subject_id") != F.col("object_id")) & (pair_key("subject_id", "object_id") == F.col("pair")))
    changed = filters.where("focus is not null").join(ends, F.col("focus") == F.col("_end")).where(own_pair).groupBy("filter_id", "scene_id").agg(F.count("*").alias("changes"))
    happened = by_filter.join(filters.where("focus is not null").select("filter_id"), "filter_id", "left_semi").groupBy("filter_id", "scene_id").agg(F.count("*").alias("events"))
    met = happened.join(changed, ["filter_id", "scene_id"], "full").join(filters.select("filter_id", "year"), "filter_id").join(scenes, "scene_id").where("year is null or year = _year")
    order = ["scene_index", "scene_id"]
    first = met.withColumn("scene_at", F.row_number().over(Window.partitionBy("filter_id").orderBy(*order))).where(F.col("scene_at") <= most).select("filter_id", "scene_at", "scene_id", "header_raw", "_year", "events", "changes")
    # Without an entity every scene of the year, or of all, is listed.
    yearly = filters.where("focus is null and year is not null").join(scenes, F.col("year") == F.col("_year")).withColumn("scene_at", F.row_number().over(Window.partitionBy("filter_id").orderBy(*order))).where(F.col("scene_at") <= most)
    every = scenes.orderBy(*order).limit(most).withColumn("scene_at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).join(filters.where("focus is null and year is null").select("filter_id"))
    open_scenes = yearly.select("filter_id", "scene_at", "scene_id", "header_raw", "_year").unionByName(every.select("filter_id", "scene_at", "scene_id", "header_raw", "_year"))
    per_event = placed.groupBy("scene_id").agg(F.count("*").alias("events"))
    per_change = n.changes.groupBy("scene_id").agg(F.count("*").alias("changes"))
    counted = open_scenes.join(per_event, "scene_id", "left").join(per_change, "scene_id", "left")
    top = staged(first.unionByName(counted.select(first.columns)).fillna(0, ["events", "changes"]), "top-scenes")
    inner = placed.join(top.select("scene_id").distinct(), "scene_id", "left_semi").withColumn("event_at", F.row_number().over(Window.partitionBy("scene_id").orderBy("sequence_in_scene", "event_id"))).where(F.col("event_at") <= events).select("scene_id", "event_at", "event_id", "event_type_l2", "sequence_in_scene", "summary")
    keys = asked.select("trace_key", "filter_id").distinct()
    shown_scenes = keys.join(top, "filter_id")
    overlays = rows.select("trace_key", "event_id", F.size("_changes").alias("overlays"))
    within = shown_scenes.select("trace_key", "scene_at", "scene_id").join(inner, "scene_id").join(overlays, ["trace_key", "event_id"], "left")
    over = F.when(F.coalesce("overlays", F.lit(0)) > 0, F.concat(F.lit(", state overlays="), text("overlays"))).otherwise("")
    event_line = F.concat(F.lit("   - "), "event_id", F.lit(" "), "event_type_l2", F.lit(" (#"), text("sequence_in_scene"), over, F.lit("): "), cut(F.col("summary"), 160))
    inside = within.select("trace_key", "scene_at", "event_at", event_line.alias("line")).groupBy("trace_key", "scene_at").agg(listed("event_at", "line").alias("inner"))
    tag = F.when((F.col("events") > 0) | (F.col("changes") > 0), F.concat(F.lit(" matched events="), text("events"), F.lit(", state changes="), text("changes"))).otherwise("")
    header = F.coalesce(F.nullif("header_raw", F.lit("")), "scene_id")
    line = F.concat(text("scene_at"), F.lit(". "), "scene_id", F.lit(" ["), F.coalesce(text("_year"), F.lit("-")), F.lit("] "), cut(header, 140), tag)
    with_lines = shown_scenes.join(inside, ["trace_key", "scene_at"], "left").select("trace_key", "scene_at", F.concat(F.array(line), F.coalesce(field("inner", "line"), no_strings())).alias("lines"))
    return with_lines.groupBy("trace_key").agg(listed("scene_at", "lines").alias("_all")).select("trace_key", F.flatten(field("_all", "lines")).alias("scene_lines"))


# Retrieval and hybrid answers.


def pieces(n: Narrative) -> DataFrame:
    """piece, source, id, scene_id, said, scored_text, refs, who (ids), spoken: what retrieval looks through."""
    said = strip(F.concat_ws("\n", "summary", F.coalesce(F.try_element_at("snippets", F.lit(1)), F.lit(""))))
    e = n.events.select(F.lit("event").alias("source"), F.col("event_id").alias("id"), "scene_id", said.alias("said"), F.concat_ws(" ", "event_type_l2", said).alias("scored_text"), F.col("evidence_refs").alias("refs"), people().alias("who"), F.lit(None).cast("string").alias("spoken"))
    c = n.changes.select(F.lit("state_change").alias("source"), F.col("state_change_id").alias("id"), "scene_id", F.concat_ws(" ", "state_dimension", "direction", "claim_type", "subject_id", "object_id").alias("said"), F.concat_ws(" ", "state_dimension", "direction", "claim_type", F.array_join("rule_ids", " ")).alias("scored_text"), F.col("evidence_refs").alias("refs"), F.array("subject_id", "object_id").alias("who"), F.lit(None).cast("string").alias("spoken"))
    cue = F.coalesce("speaker_cue_raw", F.lit(""))
    b = n.blocks.select(F.lit("script_block").alias("source"), F.col("block_id").alias("id"), "scene_id", F.concat(F.when(cue != "", F.concat(cue, F.lit(": "))).otherwise(""), "text").alias("said"), F.concat_ws(" ", "block_type", "text").alias("scored_text"), no_strings().alias("refs"), F.lit(None).cast("array<string>").alias("who"), F.lower(F.concat(cue, F.lit(" "), "text")).alias("spoken"))
    whole = e.unionByName(c).unionByName(b)
    return whole.withColumns({"piece": F.concat_ws(":", "source", "id"), "scene_order": F.coalesce("scene_id", F.lit(""))})


def retrieval_answers(asked: DataFrame, n: Narrative, most: int = 6) -> DataFrame:
    """Answers by the words that a question shares with events, state changes and script blocks of its entities."""
    found = pieces(n)
    wanted = asked.select("question_id", "question", "ids", "names")
    named = F.exists("names", lambda x: F.contains(F.col("spoken"), F.lower(x)))
    allowed = (F.size("ids") == 0) | F.when(F.col("who").isNull(), named).otherwise(F.arrays_overlap("who", "ids"))
    best = retrieval.best_matches(wanted, found, question_key="question_id", question="question", key="piece", text="scored_text", order=("scene_order", "id"), most=most, allowed=allowed, pass_words=retrieval.PASS_WORDS)
    # Written, the lists show how small they are, and pieces need neither be shuffled to meet them nor written themselves.
    best = staged(best, "best-pieces")
    rows = best.join(found.select("piece", "source", "id", "scene_id", "said", "refs"), "piece").groupBy("question_id").agg(listed("place", "score", "source", "id", "scene_id", "said", "refs").alias("top"))
    told = asked.join(rows, "question_id", "left").withColumn("top", F.coalesce("top", F.array().cast(rows.schema["top"].dataType)))
    size = F.size("top")
    scene = lambda r: F.coalesce(F.concat(F.lit(" ("), F.nullif(r["scene_id"], F.lit("")), F.lit(")")), F.lit(""))
    lines = F.transform("top", lambda r: F.concat(text(r["place"]), F.lit(". ["), r["source"], scene(r), F.lit("] "), cut(r["said"], 220)))
    head = F.concat(F.lit("Baseline retrieval returned "), text(size), F.lit(" top text chunk(s) for "), shown(F.col("names")), F.lit("."))
    answer = F.when(size == 0, NO_MATCH_TEXT).otherwise(F.array_join(F.concat(F.array(head), lines, F.array(F.lit(BASELINE_TEXT))), "\n"))
    of = lambda kind: F.transform(F.filter("top", lambda r: r["source"] == kind), lambda r: r["id"])
    sure = F.when(size == 0, 0.12).otherwise(F.least(F.lit(0.78), 0.28 + F.try_element_at("top", F.lit(1))["score"] / 12))
    return core(told, answer, sure, F.lit(BASELINE_NOTES), entities_used=F.col("ids"), events_used=of("event"), state_changes_used=of("state_change"), evidence_refs=F.flatten(F.transform("top", lambda r: F.coalesce(r["refs"], no_strings()))))


def hybrid_answers(asked: DataFrame, kg: DataFrame, trace: DataFrame) -> DataFrame:
    """Both answers of a question as one, a little more confident than the better one."""
    side = lambda df, p: df.select("question_id", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "question_id"))
    both = asked.join(side(kg, "kg"), "question_id").join(side(trace, "ntg"), "question_id")
    compared = F.concat_ws("\n", F.lit("Hybrid comparison answer:"), F.lit("KG view (entity/relationship structure):"), "kg_answer_text", F.lit(""), F.lit("NTG view (timeline/state-change structure):"), "ntg_answer_text", F.lit(""), F.lit("Use the baseline comparator for a lexical-only contrast if requested."))
    omitted = F.when(F.coalesce("include_evidence", F.lit(True)), "").otherwise(f" {OMITTED}")
    blended = F.concat_ws("\n", F.lit("Hybrid answer (KG + NTG):"), F.concat(F.lit("- KG contribution: "), "kg_reasoning_notes", omitted), F.concat(F.lit("- NTG contribution: "), "ntg_reasoning_notes", omitted), F.lit(""), F.lit("KG summary:"), "kg_answer_text", F.lit(""), F.lit("NTG summary:"), "ntg_answer_text")
    lists = {x: F.concat(f"kg_{x}", f"ntg_{x}") for x in LISTS}
    return core(both, F.when(F.col("query_type") == "comparison", compared).otherwise(blended), F.least(F.lit(0.93), F.greatest("kg_confidence", "ntg_confidence") * 0.97 + 0.03), F.lit(HYBRID_NOTES), **lists)


def finished(cores: DataFrame, asked: DataFrame, route: Column) -> DataFrame:
    """Answers in their final form: lists in order without blanks and repeats, the route's reason, and refs only where they are asked for."""
    told = cores.join(asked.select("question_id", "include_evidence", "ids", "query_type", "mode_used", "preferred_mode"), "question_id")
    wanted = F.coalesce("include_evidence", F.lit(True))
    lists = {x: ordered_distinct(F.transform(x, lambda v: v)) for x in LISTS}
    refs = F.when(wanted, lists["evidence_refs"]).otherwise(no_strings())
    notes = F.when(wanted, F.trim("reasoning_notes")).otherwise(F.concat(F.trim("reasoning_notes"), F.lit(f" {OMITTED}")))
    notes = F.when(F.contains(notes, route), notes).otherwise(F.trim(F.concat(notes, F.lit(" "), route)))
    bare = (F.size(refs) == 0) & ((F.size(lists["events_used"]) > 0) | (F.size(lists["state_changes_used"]) > 0))
    return told.select("question_id", strip("answer_text").alias("answer_text"), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"), *(lists[x].alias(x) for x in LISTS[:3]), refs.alias("evidence_refs"), F.when(bare, F.concat(notes, F.lit(f" {NO_REFS}"))).otherwise(notes).alias("reasoning_notes"))


def route_reason() -> Column:
    wanted = router.preferred(F.coalesce("preferred_mode", F.lit("auto")))
    own = F.when(F.col("query_type") == "fact", F.when(F.size("ids") > 0, FACT_WITH).otherwise(FACT_WITHOUT))
    for kind, reason in ROUTES.items():
        own = own.when(F.col("query_type") == kind, reason)
    return F.when(wanted == "auto", own).otherwise(F.concat(F.lit("User preferred "), wanted, F.lit(" mode override.")))


def answers(questions: DataFrame, n: Narrative, hints: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """question_id, question, query_type, mode_used, the answer's columns, and `baseline`, a struct of the same for comparison where it is asked for."""
    asked = staged(contexts(questions, n, hints), "asked")
    mode = F.col("mode_used")
    traced = mode.isin("ntg", "hybrid")
    compared = (F.coalesce("include_baseline", F.lit(False)) | (F.col("query_type") == "comparison")) & (mode != "baseline_rag")
    none = core(asked.where(F.lit(False)), F.lit(""), F.lit(0.0), F.lit(""))
    # A kind of answers that no question asks for would still read and write its tables, so it is left out.
    made = lambda wanted, answers_of, name: none if asked.where(wanted).isEmpty() else staged(answers_of(asked.where(wanted), n), name)
    kg = made(mode.isin("kg", "hybrid"), graph_answers, "graph-answers")
    changed = made(traced & (F.col("query_type") == "state_change"), change_answers, "change-answers")
    trace = changed.unionByName(made(traced & (F.col("query_type") != "state_change"), trace_answers, "trace-answers"))
    plain = made((mode == "baseline_rag") | compared, retrieval_answers, "retrieval-answers")
    of = lambda df, kind: df.join(asked.where(mode == kind).select("question_id"), "question_id", "left_semi")
    main = of(kg, "kg").unionByName(of(trace, "ntg")).unionByName(hybrid_answers(asked.where(mode == "hybrid"), kg, trace)).unionByName(of(plain, "baseline_rag"))
    beside = finished(plain.join(asked.where(compared).select("question_id"), "question_id", "left_semi"), asked, F.lit(BASELINE_ROUTE))
    baseline = beside.select("question_id", F.struct(*(c for c in beside.columns if c != "question_id")).alias("baseline"))
    told = asked.select("question_id", "question", "query_type", "mode_used").join(finished(main, asked, route_reason()), "question_id")
    return told.join(baseline, "question_id", "left")
