"""The knowledge graph and the graph of events in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import numbered_id, scene_ref
from plotweave.operators.numbering import with_numbers
from plotweave.sources.staging import staged

LATE = 10**9
MIN_SCENES, MAX_EDGES, MAX_SCENE_IDS = 3, 120, 8
#: Weights of predicates in answers (fixed values); others weigh 60.
WEIGHTS = {"family": 100, "associated_with": 95, "works_with": 90, "allied_with": 90, "advisor_to": 85, "counsel_to": 85, "co_present_dialogue": 50}


def manual_edges(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among the entities, and the ones that are skipped."""
    ids = entities.select("entity_id").distinct()
    ends = [F.col(c) == F.col("entity_id") for c in ("subject_id", "object_id")]
    kept = edges.join(ids, ends[0], "left_semi").join(ids, ends[1], "left_semi")
    skipped = edges.join(ids, ends[0], "left_anti").unionByName(edges.join(ids, ends[0], "left_semi").join(ids, ends[1], "left_anti"))
    return kept, skipped


#: Pairs of members that one task counts: what bounds its memory.
TASK_PAIRS = 1_000_000


def pair_counts(roster: DataFrame, *, scene: str, entity: str, with_scenes: bool = False, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """subject_id < object_id, n, and on demand the first scenes: pairs of entities by the number of scenes they share.

    roster must have each (scene, entity) once. Each entity meets the lists of its scenes' later
    members, and its pairs are unfolded and counted in the task that has the entity: no pair is
    shuffled, and partitions are as many as the number of pairs asks for. Entities with more pairs
    than a task takes are dealt out over several, whose counts are added up.
    """
    members = F.sort_array(F.collect_list(F.col(entity))).alias("_members")
    lists = staged(roster.where(F.col(scene).isNotNull()).groupBy(F.col(scene).alias("scene")).agg(members).where(F.size("_members") > 1), "scene-members")
    own = lists.select("scene", "_members", F.posexplode("_members").alias("_at", "subject_id")).where(F.col("_at") + 1 < F.size("_members"))
    met = own.select("scene", "subject_id", F.expr("slice(_members, _at + 2, size(_members))").alias("_others"))
    weights = own.groupBy("subject_id").agg(F.sum((F.size("_members") - F.col("_at") - 1).cast("long")).alias("_pairs"))
    whole = lists.agg(F.sum(F.size("_members").cast("long") * (F.size("_members") - 1) / 2)).first()[0] or 0
    parts = max(1, min(100_000, -int(-whole // task_pairs)))
    # At most as many as there are parts.
    hot = staged(weights.where(F.col("_pairs") > task_pairs).select("subject_id", F.ceil(F.col("_pairs") / task_pairs).alias("_shares")), "hot-subjects")
    once = met.join(F.broadcast(hot), "subject_id", "left_anti").repartition(parts, "subject_id").select("subject_id", F.explode("_others").alias("object_id"))
    counts = once.groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))
    shared = met.join(F.broadcast(hot), "subject_id").withColumn("_share", F.pmod(F.xxhash64("scene"), F.col("_shares"))).repartition(parts, "subject_id", "_share")
    dealt = shared.select("subject_id", "_share", F.explode("_others").alias("object_id")).groupBy("subject_id", "object_id", "_share").agg(F.count("*").alias("n"))
    counts = counts.unionByName(dealt.groupBy("subject_id", "object_id").agg(F.sum("n").alias("n")))
    if not with_scenes:
        return counts
    return counts.join(first_scenes(met.select("scene", "subject_id", F.explode("_others").alias("object_id"))), ["subject_id", "object_id"])


def first_scenes(pairs: DataFrame, most: int = MAX_SCENE_IDS) -> DataFrame:
    """subject_id, object_id, scene_ids: each pair's least scenes; the limit is kept in every task, so no list grows with a pair's scenes."""
    place = F.row_number().over(Window.partitionBy("subject_id", "object_id").orderBy("scene"))
    kept = pairs.withColumn("_place", place).where(F.col("_place") <= most)
    return kept.groupBy("subject_id", "object_id").agg(F.sort_array(F.collect_list("scene")).alias("scene_ids"))


def without_known_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that no known edge joins in either direction."""
    other = known.select(F.least("subject_id", "object_id").alias("_a"), F.greatest("subject_id", "object_id").alias("_b")).distinct()
    return pairs.join(other, (F.least("subject_id", "object_id") == F.col("_a")) & (F.greatest("subject_id", "object_id") == F.col("_b")), "left_anti")


def co_presence_edges(roster: DataFrame, known: DataFrame, *, scene: str = "scene_id", entity: str = "entity_id", least: int = MIN_SCENES, most: int = MAX_EDGES) -> DataFrame:
    """The strongest pairs that share enough scenes and are not known to be associated."""
    roster = staged(roster.select(scene, entity), "roster")
    pairs = without_known_pairs(pair_counts(roster, scene=scene, entity=entity).where(F.col("n") >= least), known.where("predicate = 'associated_with'"))
    top = staged(pairs.orderBy(F.desc("n"), "subject_id", "object_id").limit(most), "top-pairs")
    # Scenes are looked up for the pairs that stay only, at most `most` of them.
    side = lambda name: roster.select(F.col(scene).alias("scene"), F.col(entity).alias(name))
    told = side("subject_id").join(F.broadcast(top.select("subject_id", "object_id")), "subject_id").join(side("object_id"), ["scene", "object_id"])
    top = top.join(first_scenes(told), ["subject_id", "object_id"])
    return top.select("subject_id", F.lit("co_present_dialogue").alias("predicate"), "object_id", F.lit("semi_stable").alias("stability"), F.transform("scene_ids", scene_ref).alias("evidence_refs"), F.lit("scene_cooccurrence").alias("generation_method"), F.col("n").alias("cooccurrence_scene_count"), F.col("scene_ids").alias("evidence_scene_ids"))


def speaker_roster(utterances: DataFrame, raw: DataFrame, entities: DataFrame) -> DataFrame:
    """scene_id, entity_id of characters that speak in a scene."""
    people = entities.where("entity_type = 'character'").select("entity_id")
    return utterances.join(raw, utterances["speaker_cue_raw"] == raw["alias_raw"]).select("scene_id", "entity_id").join(people, "entity_id", "left_semi").distinct()


def numbered_edges(*parts: DataFrame) -> DataFrame:
    """All edges in order of subject, predicate, object and method, with ids."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    placed = with_numbers(whole, "subject_id", "predicate", "object_id", "generation_method")
    return placed.withColumn("edge_id", numbered_id("kg", "number", 5)).drop("number")


def predicate_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("n")).orderBy("predicate")


def neighbors(edges: DataFrame, entities: DataFrame, entity_id: str) -> DataFrame:
    """Edges at an entity, outgoing first by its being the subject, with the other end's name; a loop is outgoing only."""
    out = edges.where(F.col("subject_id") == entity_id).select("edge_id", "predicate", F.lit("outgoing").alias("direction"), F.col("object_id").alias("neighbor_id"))
    into = edges.where((F.col("object_id") == entity_id) & (F.col("subject_id") != entity_id)).select("edge_id", "predicate", F.lit("incoming").alias("direction"), F.col("subject_id").alias("neighbor_id"))
    names = entities.select(F.col("entity_id").alias("neighbor_id"), F.col("canonical_name").alias("neighbor_name"), F.col("entity_type").alias("neighbor_type"))
    return out.unionByName(into).join(names, "neighbor_id", "left").orderBy(F.coalesce("neighbor_name", "edge_id"), "predicate", "edge_id")


def predicate_weight(c: Column) -> Column:
    out = F
    for name, weight in WEIGHTS.items():
        out = out.when(c == name, weight)
    return out.otherwise(60)


def ranked_neighbors(found: DataFrame, most: int = 8, people: int = 6) -> DataFrame:
    """The weightiest edges; with three characters or more among them, characters only."""
    top = found.withColumn("weight", predicate_weight(F.col("predicate"))).orderBy(F.desc("weight"), F.coalesce("neighbor_name", "edge_id"), "edge_id").limit(most)
    counted = top.withColumn("people", F.count_if(F.col("neighbor_type") == "character").over(Window.partitionBy()))
    order = Window.partitionBy().orderBy(F.desc("weight"), F.coalesce("neighbor_name", "edge_id"), "edge_id")
    chosen = counted.where("people < 3 or neighbor_type = 'character'").withColumn("place", F.row_number().over(order))
    return chosen.where((F.col("people") < 3) | (F.col("place") <= people)).drop("people")


# Events in time. Positions over all events come from two levels: within the scene, and the running
# sum of scene sizes; so adjacent events are joined by scene and position, never by one global window.


def positions(events: DataFrame, scenes: DataFrame | None = None, *, scene: str = "scene_id", order: tuple[str, ...] = ("sequence_in_scene", "event_id"), event: str = "event_id") -> DataFrame:
    """scene, scene_at, event, place (within its scene), last (is it the scene's last), next_event, position over all."""
    told = events if scenes is None else events.join(scenes.select(scene, "scene_index"), scene, "left")
    at = F.coalesce(F.col("scene_index"), F.lit(LATE)) if scenes is not None or "scene_index" in events.columns else F.col(scene)
    w = Window.partitionBy("scene").orderBy(*order)
    placed = told.select(F.col(scene).alias("scene"), at.alias("scene_at"), F.col(event).alias("event"), *(F.col(c) for c in order if c != event and c != scene), *([F.col("label")] if "label" in told.columns else []))
    placed = placed.withColumn(event, F.col("event")) if event in order else placed
    placed = placed.select("*", F.row_number().over(w).alias("place"), F.lead("event").over(w).alias("next_event"))
    sizes = placed.groupBy("scene", "scene_at").agg(F.max("place").alias("n"), F.max_by("event", "place").alias("last_event"), F.min_by("event", "place").alias("first_event"))
    # Scenes are numbered, and their events summed up, by ranges: scenes may be as many as conversations.
    summed = with_numbers(with_numbers(sizes, "scene_at", "scene", into="before", value="n"), "scene_at", "scene", into="scene_number")
    following = summed.select((F.col("scene_number") - 1).alias("scene_number"), F.col("first_event").alias("next_scene_first"))
    edges = summed.join(following, "scene_number", "left").select("scene", "next_scene_first", "before", "last_event")
    return placed.join(edges, "scene").withColumn("position", F.col("before") + F.col("place"))


def temporal_edges(at: DataFrame, *, enters: str = "flashback_enter", returns: str = "flashback_return") -> DataFrame:
    """from_event, to_event, relation, basis, from_position: all relations of neighbours in time, ids in order."""
    follows = F.coalesce("next_event", F.when(F.col("event") == F.col("last_event"), F.col("next_scene_first")))
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("precedes").alias("relation"), F.lit("global_order").alias("basis"), follows.alias("to_event")),
            F.when(F.col("next_event").isNotNull(), F.struct(F.lit("same_scene_next").alias("relation"), F.lit("scene_sequence").alias("basis"), F.col("next_event").alias("to_event"))),
            F.when(F.col("event") == F.col("last_event"), F.struct(F.lit("cross_scene_continuation").alias("relation"), F.lit("scene_order").alias("basis"), F.col("next_scene_first").alias("to_event"))),
            F.when((F.col("label") == enters) & F.col("next_event").isNotNull(), F.struct(F.lit("flashback_to").alias("relation"), F.lit("flashback_marker").alias("basis"), F.col("next_event").alias("to_event"))),
            F.when(F.col("label") == returns, F.struct(F.lit("returns_to_frame").alias("relation"), F.lit("flashback_marker").alias("basis"), follows.alias("to_event"))),
        )
    )
    flat = at.select(F.col("event").alias("from_event"), F.col("position").alias("from_position"), F.inline(kinds))
    return flat.where("to_event is not null and to_event <> from_event").dropDuplicates(["from_event", "to_event", "relation", "basis"])


def numbered_temporal(edges: DataFrame) -> DataFrame:
    """Ids in order of position, relation and basis."""
    placed = with_numbers(edges, "from_position", "relation", "basis")
    return placed.withColumn("temporal_edge_id", numbered_id("te", "number")).drop("number")
