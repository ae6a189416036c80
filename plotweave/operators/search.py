"""Searches over the narrative tables: filter, count, order, limit, and only then enrich.

Tables: entities (entity_id, entity_type, canonical_name, aliases), events (event_id, scene_id,
event_type_l1, event_type_l2, summary, participants array of (entity_id, role), snippets array,
evidence_refs array, sequence_in_scene, confidence), scenes (scene_id, scene_index, header_raw,
location_raw, year_explicit, year_inferred), changes (as operators.states makes them, with
state_change_id), temporal (from_event, to_event, relation).

Lists return `filtered`, the number of matches before the limit, on every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import ci_contains, pair_key

MOST = 500
LATE = 2**31 - 1


def clamped(limit: int | None, default: int, most: int = MOST) -> int:
    return default if limit is None else max(1, min(most, int(limit)))


def all_of(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions if c is not None), F.lit(True))


def limited(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows in order; `filtered` has how many there are, `place` their order."""
    total = rows.agg(F.count("*").alias("filtered"))
    top = rows.orderBy(*order).limit(limit).join(total)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))


def list_entities(entities: DataFrame, *, q: str | None = None, entity_type: str | None = None, limit: int | None = None) -> DataFrame:
    found = None
    if q:
        found = ci_contains("canonical_name", q) | ci_contains("entity_id", q) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q.lower())))
    kept = entities.where(all_of([None if entity_type is None else F.col("entity_type") == entity_type, found]))
    return limited(kept, ["entity_type", "canonical_name", "entity_id"], clamped(limit, 200))


def with_person(events: DataFrame, entity_id: str, participants: DataFrame | None = None) -> DataFrame:
    """Events in which an entity takes part, by the bridge table where there is one."""
    if participants is None:
        return events.where(F.exists("participants", lambda p: p["entity_id"] == entity_id))
    return events.join(participants.where(F.col("entity_id") == entity_id).select("event_id"), "event_id", "left_semi")


def touches_pair(people: Column, pair: str) -> Column:
    a, _, b = pair.partition("::")
    return (F.lit(a) != F.lit(b)) & F.array_contains(people, a) & F.array_contains(people, b)


def people(c: Column | str = "participants") -> Column:
    return F.transform(c, lambda p: p["entity_id"])


def list_debug_events(events: DataFrame, participants: DataFrame | None = None, *, q: str | None = None, event_type: str | None = None, l1: str | None = None, scene_id: str | None = None, entity_id: str | None = None, limit: int | None = None) -> DataFrame:
    found = None
    if q:
        found = ci_contains("summary", q) | ci_contains("event_id", q) | ci_contains("event_type_l2", q) | F.exists("snippets", lambda s: F.contains(F.lower(s), F.lit(q.lower())))
    equal = {"event_type_l2": event_type, "event_type_l1": l1, "scene_id": scene_id}
    kept = events.where(all_of([F.col(c) == v for c, v in equal.items() if v is not None] + [found]))
    if entity_id is not None:
        kept = with_person(kept, entity_id, participants)
    return limited(kept, ["event_id"], clamped(limit, 150))


def scene_year() -> Column:
    return F.coalesce("year_explicit", "year_inferred")


def trace_events(events: DataFrame, scenes: DataFrame, *, q: str | None = None, scene_id: str | None = None, event_id: str | None = None, entity_id: str | None = None, event_type: str | None = None, year: int | None = None, pair: str | None = None, location_q: str | None = None, limit: int | None = None) -> DataFrame:
    """Events in order of scene and place; not enriched yet."""
    facts = scenes.select("scene_id", "scene_index", "header_raw", "location_raw", "year_explicit", "year_inferred")
    joined = (events if "scene_index" not in events.columns else events.drop("scene_index")).join(facts, "scene_id", "left")
    found = None
    if q:
        found = ci_contains("summary", q) | ci_contains("event_id", q) | ci_contains("event_type_l2", q) | ci_contains("event_type_l1", q) | F.exists("snippets", lambda s: F.contains(F.lower(s), F.lit(q.lower())))
    equal = {"scene_id": scene_id, "event_id": event_id, "event_type_l2": event_type}
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    conditions.append(None if year is None else scene_year() == year)
    conditions.append(None if entity_id is None else F.array_contains(people(), entity_id))
    conditions.append(None if pair is None else touches_pair(people(), pair))
    conditions.append(None if not location_q else F.contains(F.lower(F.concat_ws(" ", "location_raw", "header_raw")), F.lit(location_q.lower())))
    return limited(joined.where(all_of([*conditions, found])), [F.coalesce("scene_index", F.lit(LATE)), "sequence_in_scene", "event_id"], clamped(limit, 200))


def enriched_events(top: DataFrame, entities: DataFrame, temporal: DataFrame, changes: DataFrame) -> DataFrame:
    """A limited list of events with participants' names, edges in and out, and changes they triggered, each an array in order."""
    ids = F.broadcast(top.select(F.col("event_id").alias("_event")))
    named = top.select("event_id", F.posexplode("participants").alias("pos", "p")).select("event_id", "pos", F.col("p.entity_id").alias("entity_id")).join(entities.select("entity_id", "canonical_name"), "entity_id", "left")
    names = named.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical_name", "entity_id").alias("name")))), lambda x: x["name"]).alias("participant_names"))
    edge = lambda own, other, into: temporal.join(ids, F.col(own) == F.col("_event")).groupBy(F.col("_event").alias("event_id")).agg(F.sort_array(F.collect_list(F.concat_ws(":", "relation", other))).alias(into))
    triggered = changes.select("state_change_id", F.explode("trigger_event_ids").alias("event_id")).join(ids, F.col("event_id") == F.col("_event")).groupBy("event_id").agg(F.sort_array(F.collect_set("state_change_id")).alias("state_changes_triggered"))
    out = top
    for part in (names, edge("to_event", "from_event", "edges_in"), edge("from_event", "to_event", "edges_out"), triggered):
        out = out.join(part, "event_id", "left")
    return out.orderBy("place")


def list_state_changes(changes: DataFrame, *, state_change_id: str | None = None, subject_id: str | None = None, object_id: str | None = None, entity_id: str | None = None, pair: str | None = None, dimension: str | None = None, claim_type: str | None = None, scene_id: str | None = None, limit: int | None = None) -> DataFrame:
    equal = {"state_change_id": state_change_id, "subject_id": subject_id, "object_id": object_id, "state_dimension": dimension, "claim_type": claim_type, "scene_id": scene_id}
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    conditions.append(None if entity_id is None else (F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    conditions.append(None if pair is None else pair_key("subject_id", "object_id") == pair)
    return limited(changes.where(all_of(conditions)), ["state_change_id"], clamped(limit, 200))


def enriched_changes(top: DataFrame, entities: DataFrame, scenes: DataFrame, events: DataFrame) -> DataFrame:
    """A limited list of changes with both names, the scene's header and the trigger events that exist, in order."""
    name = lambda c: entities.select(F.col("entity_id").alias(f"{c}_id"), F.col("canonical_name").alias(f"{c}_name"))
    steps = top.select("state_change_id", F.posexplode("trigger_event_ids").alias("pos", "event_id")).join(events.select("event_id", "event_type_l2", F.col("scene_id").alias("event_scene"), "sequence_in_scene"), "event_id")
    triggers = steps.groupBy("state_change_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", "event_type_l2", "event_scene", "sequence_in_scene"))).alias("trigger_events"))
    out = top.join(name("subject"), "subject_id", "left").join(name("object"), "object_id", "left").join(scenes.select("scene_id", "header_raw"), "scene_id", "left")
    return out.join(triggers, "state_change_id", "left").orderBy("place")


def event_counts(events: DataFrame) -> DataFrame:
    """facet, value, n: how many events each kind and scene has, the most frequent first."""
    kinds = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("event_type_l1", "event_type_l2", "scene_id")))
    return events.select(F.inline(kinds)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n")).orderBy("facet", F.desc("n"), "value")


def focus_review(events: DataFrame, changes: DataFrame, scenes: DataFrame, entity_id: str) -> DataFrame:
    """Per scene of an entity, in order: its events, its changes, and the changes its events have triggered."""
    own = events.where(F.exists("participants", lambda p: p["entity_id"] == entity_id))
    its = changes.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    steps = its.select("state_change_id", F.explode("trigger_event_ids").alias("event_id")).join(own.select("event_id", "scene_id"), "event_id")
    counts = (own.groupBy("scene_id").agg(F.count("*").alias("events")), its.groupBy("scene_id").agg(F.count("*").alias("changes")), steps.groupBy("scene_id").agg(F.countDistinct("state_change_id").alias("triggered")))
    whole = reduce(lambda a, b: a.join(b, "scene_id", "full"), counts).fillna(0, ["events", "changes", "triggered"])
    return whole.join(scenes.select("scene_id", "scene_index"), "scene_id", "left").orderBy("scene_index", "scene_id")


def with_blocks_of(slices: DataFrame, blocks: DataFrame, most: int = 12) -> DataFrame:
    """Scenes of a timeline with their first blocks in order, (block_id, block_type, text) each."""
    placed = blocks.withColumn("_place", F.row_number().over(Window.partitionBy("scene_id").orderBy("sequence_in_scene", "block_id"))).where(F.col("_place") <= most)
    listed = placed.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "block_id", "block_type", "text"))), lambda b: F.struct(b["block_id"].alias("block_id"), b["block_type"].alias("block_type"), b["text"].alias("text"))).alias("blocks"))
    return slices.join(listed, "scene_id", "left")


def for_review(events: DataFrame, *, below: float = 0.7, labels: tuple[str, ...] = (), most: int = 50) -> DataFrame:
    """The events that a review should look at: of low confidence or of certain kinds, the least sure first."""
    asked = F.col("confidence") < below
    if labels:
        asked = asked | F.col("event_type_l2").isin(*labels)
    return limited(events.where(asked), ["confidence", "event_id"], clamped(most, 50))


def timeline_slice(events: DataFrame, changes: DataFrame, scenes: DataFrame, *, year: int | None = None, entity_id: str | None = None, event_type: str | None = None, pair: str | None = None, q: str | None = None, limit_scenes: int | None = None) -> DataFrame:
    """Scenes in order with how many events and changes match; with any filter, only scenes that have a match.

    The kind of event is no condition on changes; the text is looked for in a change's id, dimension, direction and claim.
    """
    e, c = [], []
    if entity_id is not None:
        e.append(F.array_contains(people(), entity_id))
        c.append((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    if event_type is not None:
        e.append(F.col("event_type_l2") == event_type)
    if pair is not None:
        e.append(touches_pair(people(), pair))
        c.append(pair_key("subject_id", "object_id") == pair)
    if q:
        e.append(F.contains(F.lower(F.concat_ws(" ", "summary", F.array_join("snippets", " "))), F.lit(q.lower())) | ci_contains("event_type_l2", q) | ci_contains("event_id", q))
        c.append(F.contains(F.lower(F.concat_ws(" ", "state_change_id", "state_dimension", "direction", "claim_type")), F.lit(q.lower())))
    matched = events.groupBy("scene_id").agg(F.count_if(all_of(e)).alias("matching_events"), F.count("*").alias("events"))
    changed = changes.groupBy("scene_id").agg(F.count_if(all_of(c)).alias("matching_state_changes"))
    told = scenes.join(matched, "scene_id", "left").join(changed, "scene_id", "left").fillna(0, ["matching_events", "events", "matching_state_changes"])
    if year is not None:
        told = told.where(scene_year() == year)
    if e or c:
        told = told.where("matching_events > 0 or matching_state_changes > 0")
    return told.orderBy("scene_index").limit(clamped(limit_scenes, 24, 120))


def pair_options(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """pair, n, label `A <> B`, the most frequent first."""
    counts = changes.where("subject_id <> object_id").groupBy(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).agg(F.count("*").alias("n"))
    name = lambda c: entities.select(F.col("entity_id").alias(c), F.col("canonical_name").alias(f"{c}_name"))
    told = counts.join(name("a"), "a", "left").join(name("b"), "b", "left")
    label = F.concat(F.coalesce("a_name", "a"), F.lit(" <> "), F.coalesce("b_name", "b"))
    return told.select(pair_key("a", "b").alias("pair"), "n", label.alias("label")).orderBy(F.desc("n"), "label")


def facet_options(events: DataFrame, scenes: DataFrame, changes: DataFrame, entities: DataFrame) -> DataFrame:
    """facet, value: what lists can be narrowed by, in order."""
    parts = [
        scenes.select(F.lit("year").alias("facet"), scene_year().cast("string").alias("value")),
        events.select(F.lit("event_type_l2").alias("facet"), F.col("event_type_l2").alias("value")),
        events.select(F.lit("event_type_l1").alias("facet"), F.col("event_type_l1").alias("value")),
        changes.select(F.lit("state_dimension").alias("facet"), F.col("state_dimension").alias("value")),
        entities.where("entity_type <> 'location'").select(F.lit("entity").alias("facet"), F.col("entity_id").alias("value")),
        events.select(F.lit("scene").alias("facet"), F.col("scene_id").alias("value")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).where("value is not null").distinct().orderBy("facet", "value")


def summary_counts(**tables: DataFrame) -> DataFrame:
    """name, n of each table, counted in one query."""
    return reduce(lambda a, b: a.unionByName(b), (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def fixture_search(fixtures: DataFrame, q: str, columns: tuple[str, ...] = ("query_id", "question", "category", "query_type_expected")) -> DataFrame:
    return fixtures.where(reduce(lambda a, b: a | b, (F.coalesce(ci_contains(c, q), F.lit(False)) for c in columns))).orderBy("query_id")


def storyboard(items: DataFrame, most: int = 12) -> DataFrame:
    """Evidence items by the number in their scene's id, those without one last."""
    number = F.regexp_extract("scene_id", r"(\d+)", 1).try_cast("int")
    return items.withColumn("scene_number", number).orderBy(F.col("scene_number").asc_nulls_last(), "item_id").limit(most)
