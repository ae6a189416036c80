"""Answers to questions: entity detection, graph, trace, hybrid and retrieval answers, evidence lookup.

An `Answer` is what one question gets back; its parts are collected from lists that are limited to
a few rows each, so the driver only ever sees those.
"""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions.text import ci_contains, href, overlap_score, pair_key, squeeze
from plotweave.operators import graph, router, search, spans

#: The hints that name entities by other words (fixed values); ids that a graph lacks are passed over.
HINTS = (
    ("char_frank_sheeran", "frank sheeran"), ("char_frank_sheeran", "frank"), ("char_peggy_sheeran", "peggy sheeran"), ("char_peggy_sheeran", "peggy"),
    ("char_jimmy_hoffa", "jimmy hoffa"), ("char_jimmy_hoffa", "hoffa"), ("char_russell_bufalino", "russell bufalino"), ("char_russell_bufalino", "russell"),
    ("char_russell_bufalino", "bufalino"), ("org_fbi", "fbi"),
)


@dataclass
class Answer:
    text: str
    mode_used: str
    query_type: str
    confidence: float
    entities_used: list[str] = field(default_factory=list)
    events_used: list[str] = field(default_factory=list)
    state_changes_used: list[str] = field(default_factory=list)
    evidence_refs: list[str] = field(default_factory=list)
    reasoning_notes: str = ""
    baseline: Answer | None = None


@dataclass
class Narrative:
    """The tables that questions are answered from."""

    entities: DataFrame
    aliases: DataFrame
    edges: DataFrame
    events: DataFrame
    scenes: DataFrame
    changes: DataFrame
    temporal: DataFrame
    blocks: DataFrame


def distinct(values) -> list[str]:
    return list(dict.fromkeys(v.strip() for v in values if v and v.strip()))


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3].rstrip() + "..."


def shown_names(names: list[str], most: int = 4) -> str:
    kept = distinct(names)
    if not kept:
        return "the current filters"
    return ", ".join(kept[:most]) + (f" +{len(kept) - most} more" if len(kept) > most else "")


def normalized(answer: Answer, include_evidence: bool = True) -> Answer:
    lists = {f: distinct(getattr(answer, f)) for f in ("entities_used", "events_used", "state_changes_used", "evidence_refs")}
    if not include_evidence:
        lists["evidence_refs"] = []
    return dataclasses.replace(answer, text=answer.text.strip(), confidence=min(1.0, max(0.0, answer.confidence)), **lists)


def valid(answer: Answer) -> list[str]:
    """What is wrong with an answer, if anything."""
    faults = [f for f in ("text", "mode_used", "query_type") if not getattr(answer, f)]
    return faults + ["confidence"] * (not 0 <= answer.confidence <= 1) + ["mode_used"] * (answer.mode_used not in router.MODES)


def lexicon(entities: DataFrame, aliases: DataFrame, hints: tuple[tuple[str, str], ...] = HINTS) -> DataFrame:
    """entity_id, phrase, priority: names, hand-made aliases, hints and last names that only one character has."""
    spark = entities.sparkSession
    names = entities.select("entity_id", F.col("canonical_name").alias("phrase"), F.lit(100).alias("priority"))
    manual = aliases.where(F.lower("source").contains("manual")).join(entities.select("entity_id"), "entity_id", "left_semi")
    raw = manual.select("entity_id", F.col("alias_raw").alias("phrase"), F.lit(80).alias("priority"))
    norm = manual.select("entity_id", F.col("alias_normalized").alias("phrase"), F.lit(75).alias("priority"))
    told = spark.createDataFrame(list(hints), "entity_id string, phrase string").join(entities.select("entity_id"), "entity_id", "left_semi").withColumn("priority", F.lit(90))
    words = F.split(F.lower(squeeze("canonical_name")), " ")
    last = entities.where("entity_type = 'character'").where(F.size(words) >= 2).select("entity_id", F.element_at(words, -1).alias("phrase")).where(F.length("phrase") >= 4)
    single = last.groupBy("phrase").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1").select("entity_id", "phrase", F.lit(70).alias("priority"))
    whole = names.unionByName(raw).unionByName(norm).unionByName(told).unionByName(single)
    return whole.withColumn("phrase", F.lower(squeeze("phrase"))).where(F.length("phrase") >= 3).distinct()


def detect(question: str, n: Narrative, hints: tuple[tuple[str, str], ...] = HINTS) -> list[tuple[str, str]]:
    """(entity_id, name) of the entities in a question, in order of place."""
    asked = n.entities.sparkSession.createDataFrame([(1, " ".join(question.lower().split()))], "q int, text string")
    found = spans.detected(asked, lexicon(n.entities, n.aliases, hints), key="q", text="text").join(n.entities.select("entity_id", "canonical_name"), "entity_id")
    return [(r["entity_id"], r["canonical_name"]) for r in found.orderBy("place").collect()]


def year_of(question: str) -> int | None:
    m = re.search(r"\b(19\d{2}|20\d{2})\b", question, re.ASCII)
    return int(m[1]) if m else None


def kg_answer(question: str, kind: str, people: list[tuple[str, str]], n: Narrative) -> Answer:
    if people:
        focus, name = people[0]
        found = graph.neighbors(n.edges, n.entities, focus).join(n.edges.select("edge_id", "stability", "evidence_refs"), "edge_id").cache()
        rows = graph.ranked_neighbors(found).orderBy("place").collect()
        total = found.count()
        found.unpersist()
        lines = [f"KG view of {name}: {len(rows)} high-signal relationship(s) from the local graph artifact."]
        for k, r in enumerate(rows, 1):
            who = f"{r['neighbor_name']} ({r['neighbor_type']})" if r["neighbor_name"] else r["neighbor_id"]
            refs = f", evidence refs: {len(r['evidence_refs'])}" if r["evidence_refs"] else ""
            lines.append(f"{k}. [{'out' if r['direction'] == 'outgoing' else 'in'}] {r['predicate']} -> {who} [{r['stability']}]{refs}")
        if total > len(rows):
            lines.append(f"Additional relationships omitted for brevity: {total - len(rows)}.")
        return Answer("\n".join(lines), "kg", kind, min(0.95, 0.55 + 0.05 * len(rows)), [focus, *(r["neighbor_id"] for r in rows if r["neighbor_name"])], evidence_refs=[e for r in rows for e in r["evidence_refs"] or []])
    top = search.list_entities(n.entities, q=question, limit=8).orderBy("place").limit(5).collect()
    head = "KG entity search candidates for this question:" if top else "No direct entity match detected for this fact-style query."
    lines = [head, *(f"{k}. {r['canonical_name']} ({r['entity_type']}) [{r['entity_id']}]" for k, r in enumerate(top, 1))]
    return Answer("\n".join(cut(x, 220) for x in lines), "kg", kind, 0.42 if top else 0.2, [r["entity_id"] for r in top])


def trace_answer(question: str, kind: str, people: list[tuple[str, str]], n: Narrative) -> Answer:
    ids, names = [p[0] for p in people], [p[1] for p in people]
    pair = "::".join(sorted(ids[:2])) if len(ids) >= 2 else None
    first = ids[0] if ids else None
    if kind == "state_change":
        rows = search.enriched_changes(search.list_state_changes(n.changes, pair=pair, entity_id=None if pair else first, limit=40), n.entities, n.scenes, n.events).limit(8).collect()
        if not rows:
            return Answer("No inferred state changes matched the current question filters.", "ntg", kind, 0.25, ids)
        total = rows[0]["filtered"]
        lines = [f"NTG state-change view ({len(rows)} of {total} matching changes) for {shown_names(names)}."]
        for r in rows:
            led = "; ".join(f"{e['event_type_l2']} ({e['event_scene']}/{e['sequence_in_scene']})" for e in (r["trigger_events"] or [])[:2])
            size = f" ({r['magnitude']})" if r["magnitude"] else ""
            lines.append(f"- {r['subject_name'] or r['subject_id']} -> {r['object_name'] or r['object_id']}: {r['state_dimension']} {r['direction']}{size} [{r['claim_type']}] in {r['header_raw'] or r['scene_id']} (conf {r['confidence']:.2f})." + (f" Triggers: {led}." if led else ""))
        if total > len(rows):
            lines.append(f"Additional matching state changes omitted: {total - len(rows)}.")
        used = ids + [x for r in rows for x in (r["subject_id"], r["object_id"])]
        return Answer("\n".join(cut(x, 320) for x in lines), "ntg", kind, min(0.92, 0.58 + 0.04 * len(rows)), used, [e["event_id"] for r in rows for e in r["trigger_events"] or []], [r["state_change_id"] for r in rows], [x for r in rows for x in r["evidence_refs"]])
    # Timeline questions that name an entity are not looked for as text as well.
    words = None if kind == "timeline" and (ids or year_of(question)) else question
    listed = search.trace_events(n.events, n.scenes, q=question if kind == "evidence" else words, entity_id=first, pair=pair, year=year_of(question), limit=14 if kind == "evidence" else 40)
    rows = search.enriched_events(listed, n.entities, n.temporal, n.changes).limit(10 if kind == "causal_chain" else 8).collect()
    used = ids + [p["entity_id"] for r in rows for p in r["participants"]]
    events, changed, refs = [r["event_id"] for r in rows], [s for r in rows for s in r["state_changes_triggered"] or []], [x for r in rows for x in r["evidence_refs"]]
    if kind == "evidence":
        lines = [f"Evidence-centric NTG response ({len(rows)} event(s)) for {shown_names(names)}."]
        lines += [f"{k}. {r['event_id']} {r['event_type_l2']} in {r['header_raw'] or r['scene_id']} [refs: {len(r['evidence_refs'])}] {cut((r['snippets'] or [''])[0] or r['summary'], 180)}" for k, r in enumerate(rows, 1)]
        return Answer("\n".join(lines), "ntg", kind, min(0.86, 0.45 + 0.04 * len(rows)) if rows else 0.2, used, events, changed, refs)
    slice_ = search.timeline_slice(n.events, n.changes, n.scenes, q=words if kind == "timeline" else None, entity_id=first, pair=pair, year=year_of(question), limit_scenes=8).limit(6)
    scenes = slice_.collect()
    if not rows and not scenes:
        return Answer("No matching timeline events were found. Try adding a character name, event type, or year.", "ntg", kind, 0.22, ids)
    head = "Heuristic event chain (NTG)" if kind == "causal_chain" else "Scene-ordered NTG timeline slice"
    lines = [f"{head} for {shown_names(names)}:"]
    some = n.events.where((F.col("sequence_in_scene") <= 3) & F.col("scene_id").isin([s["scene_id"] for s in scenes])).select("scene_id", "event_id", "event_type_l2", "sequence_in_scene", "summary").orderBy("scene_id", "sequence_in_scene").collect() if scenes else []
    for k, s in enumerate(scenes, 1):
        year = s["year_explicit"] or s["year_inferred"]
        lines.append(f"{k}. {s['scene_id']} [{year or '-'}] {cut(s['header_raw'], 140)} matched events={s['matching_events']}, state changes={s['matching_state_changes']}")
        lines += [f"   - {e['event_id']} {e['event_type_l2']} (#{e['sequence_in_scene']}): {cut(e['summary'], 160)}" for e in some if e["scene_id"] == s["scene_id"]]
    if kind == "causal_chain":
        lines.append("This is a heuristic chain assembled from filtered event order and state-change overlays; it is not a formal causal proof.")
    return Answer("\n".join(cut(x, 360) for x in lines), "ntg", kind, min(0.88, 0.5 + 0.03 * min(len(rows), 10)), used, events, changed, refs)


def hybrid_answer(question: str, kind: str, people: list[tuple[str, str]], n: Narrative) -> Answer:
    return merged(trace_answer(question, kind, people, n), kg_answer(question, kind, people, n))


def merged(trace: Answer, kg: Answer) -> Answer:
    """Two answers as one: lists in order without repeats, a little more confident than the better one."""
    lists = {f: distinct(getattr(trace, f) + getattr(kg, f)) for f in ("entities_used", "events_used", "state_changes_used", "evidence_refs")}
    return Answer(f"{trace.text}\n\nKG context:\n{kg.text}", "hybrid", trace.query_type, min(0.93, 0.97 * max(trace.confidence, kg.confidence) + 0.03), **lists)


def retrieval(n: Narrative, question: str, people: list[tuple[str, str]], most: int = 6) -> DataFrame:
    """source, id, scene_id, text, refs, score: what shares most words with the question, of what has one of the entities."""
    ids, none = [p[0] for p in people], F.array().cast("array<string>")
    q = F.lit(question)
    e = n.events if not ids else n.events.where(F.exists("participants", lambda p: p["entity_id"].isin(ids)))
    c = n.changes if not ids else n.changes.where(F.col("subject_id").isin(ids) | F.col("object_id").isin(ids))
    b = n.blocks
    if ids:
        said = F.concat_ws(" ", F.coalesce("speaker_cue_raw", F.lit("")), "text")
        named = F.lit(False)
        for _, name in people:
            named = named | ci_contains(said, name)
        b = b.where(named)
    text = F.trim(F.concat_ws("\n", "summary", F.coalesce(F.try_element_at("snippets", F.lit(1)), F.lit(""))))
    parts = [
        e.select(F.lit("event").alias("source"), F.col("event_id").alias("id"), "scene_id", text.alias("text"), F.col("evidence_refs").alias("refs"), overlap_score(q, F.concat_ws(" ", "event_type_l2", text)).alias("score")),
        c.select(F.lit("state_change").alias("source"), F.col("state_change_id").alias("id"), "scene_id", F.concat_ws(" ", "state_dimension", "direction", "claim_type", "subject_id", "object_id").alias("text"), F.col("evidence_refs").alias("refs"), overlap_score(q, F.concat_ws(" ", "state_dimension", "direction", "claim_type", F.array_join("rule_ids", " "))).alias("score")),
        b.select(F.lit("script_block").alias("source"), F.col("block_id").alias("id"), "scene_id", F.concat_ws(": ", "speaker_cue_raw", "text").alias("text"), none.alias("refs"), overlap_score(q, F.concat_ws(" ", "block_type", "text")).alias("score")),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.where("score > 0").orderBy(F.desc("score"), F.coalesce("scene_id", F.lit("")), "id").limit(most)


def baseline_answer(question: str, kind: str, people: list[tuple[str, str]], n: Narrative) -> Answer:
    top = retrieval(n, question, people).collect()
    if not top:
        return Answer("Baseline retrieval found no strong lexical matches for this question.", "baseline_rag", kind, 0.12, [p[0] for p in people])
    lines = [f"Baseline retrieval returned {len(top)} top text chunk(s) for {shown_names([p[1] for p in people])}."]
    lines += [f"{k}. [{r['source']}{f' ({r["scene_id"]})' if r['scene_id'] else ''}] {cut(r['text'], 220)}" for k, r in enumerate(top, 1)]
    of = lambda source: [r["id"] for r in top if r["source"] == source]
    return Answer("\n".join(lines), "baseline_rag", kind, min(0.78, 0.28 + top[0]["score"] / 12), [p[0] for p in people], of("event"), of("state_change"), [x for r in top for x in r["refs"]])


BUILDERS = {"kg": kg_answer, "ntg": trace_answer, "hybrid": hybrid_answer, "baseline_rag": baseline_answer}


def answer(body: dict, n: Narrative, rewrite=None) -> Answer:
    """The answer to a request; rewrite, if given, may reword the text and nothing else."""
    request = router.normalized_request(body)
    spark = n.entities.sparkSession
    people = detect(request["question"], n)
    route = router.routed(spark.createDataFrame([(request["question"], request["preferred_mode"])], "question string, wanted string"), wanted="wanted").first()
    out = _finished(BUILDERS[route["mode_used"]](request["question"], route["query_type"], people, n), request["include_evidence"])
    if rewrite is not None:
        out = dataclasses.replace(out, text=rewrite(out) or out.text)
    if (request["include_baseline_comparison"] or route["query_type"] == "comparison") and route["mode_used"] != "baseline_rag":
        out.baseline = _finished(baseline_answer(request["question"], route["query_type"], people, n), request["include_evidence"])
    return out


def answer_baseline_only(question: str, n: Narrative, include_evidence: bool = True) -> Answer:
    return answer({"question": question, "preferred_mode": "baseline", "include_evidence": include_evidence}, n)


def _finished(a: Answer, include_evidence: bool) -> Answer:
    a = normalized(a, include_evidence)
    if not a.evidence_refs:
        a.reasoning_notes = f"{a.reasoning_notes} Warning: no evidence refs were attached to this answer.".strip()
    return a


#: How many ids of each kind an evidence lookup takes.
EVIDENCE_CAPS = {"event": 40, "state_change": 30, "ref": 60}


def evidence(n: Narrative, events_used: list[str], changes_used: list[str], refs: list[str]) -> DataFrame:
    """kind, id, scene_id, snippet, place: asked events, changes by their first trigger, and refs that no event covers."""
    spark = n.entities.sparkSession
    asked = lambda values, kind: spark.createDataFrame([(k, v) for k, v in enumerate(distinct(values)[:80][: EVIDENCE_CAPS[kind]])], "place int, id string")
    e, c, r = asked(events_used, "event"), asked(changes_used, "state_change"), asked(refs, "ref")
    snippet = F.coalesce(F.try_element_at("snippets", F.lit(1)), F.col("summary"))
    events = e.join(n.events, e["id"] == n.events["event_id"]).select(F.lit("event").alias("kind"), "id", "scene_id", snippet.alias("snippet"), "evidence_refs", F.lit(0).alias("rank"), "place")
    first = n.changes.select("state_change_id", F.try_element_at("trigger_event_ids", F.lit(1)).alias("_event"), F.col("evidence_refs").alias("change_refs"), F.col("scene_id").alias("change_scene"))
    changes = c.join(first, c["id"] == first["state_change_id"]).join(n.events, F.col("_event") == F.col("event_id"), "left").select(F.lit("state_change").alias("kind"), "id", F.col("change_scene").alias("scene_id"), snippet.alias("snippet"), F.col("change_refs").alias("evidence_refs"), F.lit(1).alias("rank"), "place")
    covered = events.unionByName(changes).select(F.explode("evidence_refs").alias("_ref")).distinct()
    left = r.join(covered, F.col("id") == F.col("_ref"), "left_anti")
    opening = n.blocks.groupBy("scene_id").agg(F.min_by("text", "sequence_in_scene").alias("opening"))
    scene = F.regexp_extract("id", "^scene:(.+)$", 1)
    others = left.join(opening, scene == F.col("scene_id"), "left").select(F.when(scene != "", "scene_ref").otherwise("raw_ref").alias("kind"), "id", F.nullif(scene, F.lit("")).alias("scene_id"), F.col("opening").alias("snippet"), F.array("id").alias("evidence_refs"), F.lit(2).alias("rank"), "place")
    return events.unionByName(changes).unionByName(others).orderBy("rank", "place").drop("rank")


def with_links(found: DataFrame, n: Narrative) -> DataFrame:
    """Evidence (kind, id, scene_id) with trace_href, timeline_href and tags: where a reader finds it, and what it is."""
    e = n.events.select(F.col("event_id").alias("_event"), "event_type_l1", "event_type_l2")
    c = n.changes.select(F.col("state_change_id").alias("_change"), pair_key("subject_id", "object_id").alias("_pair"), "claim_type", "state_dimension")
    told = found.join(e, (F.col("kind") == "event") & (F.col("id") == F.col("_event")), "left").join(c, (F.col("kind") == "state_change") & (F.col("id") == F.col("_change")), "left")
    focus, kind = F.lit("evidence"), F.col("kind")
    trace = F.when(kind == "event", href("/trace", focus=focus, eventId="id", sceneId="scene_id")).when(kind == "state_change", href("/trace", focus=focus, stateChangeId="id", sceneId="scene_id", pair="_pair")).when(kind == "scene_ref", href("/trace", focus=focus, sceneId="scene_id")).otherwise(href("/trace", focus=focus, q="id"))
    line = F.when(kind == "state_change", href("/timeline", pair="_pair", q="id")).when(kind == "scene_ref", href("/timeline", q="scene_id")).otherwise(href("/timeline", q="id"))
    tags = F.when(kind == "event", F.array("kind", "event_type_l1", "event_type_l2")).when(kind == "state_change", F.array("kind", "claim_type", "state_dimension")).otherwise(F.array("kind"))
    return told.select(*found.columns, trace.alias("trace_href"), line.alias("timeline_href"), tags.alias("tags"))


def unresolved(found: DataFrame) -> DataFrame:
    """Refs that neither an event nor a scene explains."""
    return found.where("kind = 'raw_ref'").select("id")


def pair_of(a: str, b: str):
    return pair_key(F.lit(a), F.lit(b))
