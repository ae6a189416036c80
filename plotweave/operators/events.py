"""Typed events from blocks: speakers, mentions, rule classes, participants, boundary events, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import alias_normal, numbered_id, truncate
from plotweave.operators import rules, spans
from plotweave.operators.numbering import with_numbers

#: Kinds whose first mention has a role of its own (fixed values).
TARGETED = ("question", "request", "instruction_order", "warning", "threat_verbal", "persuasion_attempt")
MESSENGER = "signal_or_message_delivery"
MENTIONS_SPOKEN, MENTIONS_ACTION, LISTENERS = 3, 4, 2


def alias_maps(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw and normal forms of cues with their entities; the first record of a form holds."""
    cue = aliases.where(F.col("source").contains("utterance_cue"))
    raw = cue.where("alias_kind <> 'normalized_cue'").groupBy("alias_raw").agg(F.min_by("entity_id", "alias_record_id").alias("entity_id"))
    normal = cue.where("alias_normalized is not null and alias_normalized <> ''").groupBy("alias_normalized").agg(F.min_by("entity_id", "alias_record_id").alias("entity_id"))
    return raw, normal


def with_speakers(blocks: DataFrame, raw: DataFrame, normal: DataFrame) -> DataFrame:
    """Blocks with speaker_entity_id: by the cue as it stands, else by its normal form."""
    r = raw.select(F.col("alias_raw").alias("_raw"), F.col("entity_id").alias("_by_raw"))
    n = normal.select(F.col("alias_normalized").alias("_norm"), F.col("entity_id").alias("_by_norm"))
    joined = blocks.join(r, F.col("speaker_cue_raw") == F.col("_raw"), "left").join(n, alias_normal("speaker_cue_raw") == F.col("_norm"), "left")
    return joined.withColumn("speaker_entity_id", F.coalesce("_by_raw", "_by_norm")).drop("_raw", "_by_raw", "_norm", "_by_norm")


def with_answers(blocks: DataFrame, *, scene: str = "scene_id", place: str = "sequence_in_scene", question: Column | None = None) -> DataFrame:
    """Blocks with `answers`: the block before, headers aside, is a question of another speaker."""
    asks = F.contains("text", F.lit("?")) if question is None else question
    w = Window.partitionBy(scene).orderBy(place)
    before_asks = F.lag((F.col("block_type") == "utterance") & asks).over(w)
    before = F.lag("speaker_entity_id").over(w)
    test = F.coalesce(before_asks, F.lit(False)) & F.col("speaker_entity_id").isNotNull() & ~F.col("speaker_entity_id").eqNullSafe(before)
    return blocks.withColumn("answers", test)


def classified(blocks: DataFrame) -> DataFrame:
    """Blocks (with location_raw, header_raw, flags of their scenes, and `answers`) with struct `class`."""
    text, place, header = F.col("text"), F.coalesce("location_raw", F.lit("")), F.coalesce("header_raw", F.lit(""))
    # The lowered forms are columns of their own: some sixty conditions look at them.
    once = blocks.where("block_type <> 'scene_header'").withColumns({"_low": rules.lowered(text), "_low_place": rules.lowered(place), "_low_head": rules.lowered(header)})
    low = (F.col("_low"), F.col("_low_place"), F.col("_low_head"))
    modifiers = F.coalesce("delivery_modifiers", F.array().cast("array<string>"))
    spoken = rules.first_match(rules.utterance_rules(text=text, cue=F.coalesce("speaker_cue_raw", F.lit("")), modifiers=modifiers, location=place, header=header, answers=F.col("answers"), low=low))
    acted = rules.first_match(rules.action_rules(text=text, location=place, header=header, flags=F.col("flags"), low=low))
    return once.withColumn("class", F.when(F.col("block_type") == "utterance", spoken).otherwise(acted)).drop("_low", "_low_place", "_low_head")


def summary(label: Column, cue: Column, text: Column, location: Column, spoken: Column) -> Column:
    plain = F.replace(label, F.lit("_"), F.lit(" "))
    said = F.concat(cue, F.lit(": "), truncate(text, 150), F.lit(" ("), plain, F.lit(")"))
    there = F.concat(plain, F.lit(" in "), location, F.lit(": "), truncate(text, 160))
    return F.when(spoken & cue.isNotNull(), said).when(F.coalesce(location, F.lit("")) != "", there).otherwise(F.concat(plain, F.lit(": "), truncate(text, 160)))


def _people(ids: Column, role: Column | str, most: int) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.transform(F.slice(ids, 1, most), lambda e: F.struct(e.alias("entity_id"), r.alias("role")))


def participants(*, label: Column, speaker: Column, mentioned: Column, roster: Column, voice_over: Column, location: Column, spoken: Column) -> Column:
    """Array of (entity_id, role): speaker, mentions, listeners and place of an utterance; mentions and place of an action."""
    none = F.array().cast("array<struct<entity_id:string,role:string>>")
    first_role = F.when(label.isin(*TARGETED), "target").when(label == MESSENGER, "messenger").otherwise("mentioned")
    others = F.array_except(mentioned, F.array(speaker))
    first, rest = _people(F.slice(others, 1, 1), first_role, 1), _people(F.slice(others, 2, MENTIONS_SPOKEN - 1), "mentioned", MENTIONS_SPOKEN - 1)
    own = F.when(speaker.isNotNull(), F.array(F.struct(speaker.alias("entity_id"), F.lit("speaker").alias("role")))).otherwise(none)
    listeners = F.when(voice_over, none).otherwise(_people(F.array_except(roster, F.array(speaker)), "listener", LISTENERS))
    place = F.when(location.isNotNull(), F.array(F.struct(location.alias("entity_id"), F.lit("location").alias("role")))).otherwise(none)
    said, acted = F.concat(own, first, rest, listeners, place), F.concat(_people(mentioned, "participant", MENTIONS_ACTION), place)
    return F.array_distinct(F.filter(F.when(spoken, said).otherwise(acted), lambda p: (p["entity_id"] != "") & p["entity_id"].isNotNull()))


def rosters(blocks: DataFrame) -> DataFrame:
    """scene_id, roster: the speakers of a scene in order of their ids."""
    return blocks.where("speaker_entity_id is not null").groupBy("scene_id").agg(F.sort_array(F.collect_set("speaker_entity_id")).alias("roster"))


def boundary_events(scenes: DataFrame) -> DataFrame:
    """scene_id, label, confidence, order: entry, stated year and flashback before a scene's blocks, its exit behind them."""
    made = F.array_compact(
        F.array(
            F.struct(F.lit(-3).alias("order"), F.lit("scene_entry").alias("label"), F.lit(1.0).alias("confidence")),
            F.when(F.col("year_explicit").isNotNull(), F.struct(F.lit(-2).alias("order"), F.lit("time_jump_explicit").alias("label"), F.lit(0.98).alias("confidence"))),
            F.when(F.array_contains("flags", "flashback"), F.struct(F.lit(-1).alias("order"), F.lit("flashback_enter").alias("label"), F.lit(0.97).alias("confidence"))),
            F.struct(F.lit(2**31 - 1).alias("order"), F.lit("scene_exit").alias("label"), F.lit(1.0).alias("confidence")),
        )
    )
    return scenes.select("*", F.inline(made))


def numbered(events: DataFrame, *, scene: str = "scene_id", scene_order: str = "scene_index", order: str = "order") -> DataFrame:
    """Events with sequence_in_scene and event numbers over all scenes in order.

    Scenes are counted first and their running sum is joined, so no window holds all events.
    """
    w = Window.partitionBy(scene).orderBy(order)
    placed = events.withColumn("sequence_in_scene", F.row_number().over(w))
    sizes = placed.groupBy(F.col(scene).alias("_scene"), F.col(scene_order).alias("_at")).agg(F.count("*").alias("_n"))
    before = with_numbers(sizes, "_at", "_scene", into="_before", value="_n").select("_scene", "_before")
    number = F.col("_before") + F.col("sequence_in_scene")
    return placed.join(before, F.col(scene) == F.col("_scene")).withColumns({"event_id": numbered_id("evt", number), "evidence_ref": numbered_id("evref", number)}).drop("_scene", "_before")


def extracted(blocks: DataFrame, scenes: DataFrame, aliases: DataFrame, entities: DataFrame, types: DataFrame) -> DataFrame:
    """The events of all blocks and scene boundaries, with participants and one piece of evidence each."""
    raw, normal = alias_maps(aliases)
    said = with_answers(with_speakers(blocks.where("block_type <> 'scene_header'"), raw, normal))
    facts = scenes.select("scene_id", "location_raw", "header_raw", "flags", "location_canonical_id")
    told = classified(said.join(facts, "scene_id")).withColumn("label", F.col("class.label"))
    named = entities.where(F.col("entity_type").isin("character", "group", "organization")).select("entity_id", F.explode(F.array_union(F.array("canonical_name"), "aliases")).alias("name"))
    named = named.where((F.length(F.trim("name")) >= 2) & ~F.upper("name").isin("PRO", "WHISPERS", "SOMEONE"))
    found = spans.mentions(told, named, key="block_id", text="text")
    joined = told.join(found, "block_id", "left").join(rosters(said), "scene_id", "left")
    none, spoken = F.array().cast("array<string>"), F.col("block_type") == "utterance"
    people = participants(
        label=F.col("label"), speaker=F.col("speaker_entity_id"), mentioned=F.coalesce("mentions", none), roster=F.coalesce("roster", none),
        voice_over=F.coalesce(F.array_contains("delivery_modifiers", "voice_over"), F.lit(False)), location=F.col("location_canonical_id"), spoken=spoken,
    )
    from_blocks = joined.select(
        "scene_id", "scene_index", F.col("sequence_in_scene").alias("order"), "label", F.col("class.confidence").alias("confidence"), people.alias("participants"),
        summary(F.col("label"), F.col("speaker_cue_raw"), F.col("text"), F.col("location_raw"), spoken).alias("summary"), truncate("text").alias("snippet"), F.array("class.note").alias("classification_notes"), "block_type", "block_id", "line_start", "line_end",
    )
    edges = boundary_events(scenes)
    place = F.array(F.struct(F.col("location_canonical_id").alias("entity_id"), F.lit("location").alias("role")))
    from_scenes = edges.select(
        "scene_id", "scene_index", "order", "label", "confidence", place.alias("participants"), F.concat(F.replace("label", F.lit("_"), F.lit(" ")), F.lit(": "), truncate("header_raw", 160)).alias("summary"), truncate("header_raw").alias("snippet"),
        F.array(F.lit("scene_boundary")).alias("classification_notes"), F.lit("scene_header").alias("block_type"), F.lit(None).cast("string").alias("block_id"), "line_start", "line_end",
    )
    return numbered(rules.mapped(from_blocks.unionByName(from_scenes), types)).withColumn("extraction_method", F.lit("rule"))


def bridge(events: DataFrame) -> DataFrame:
    """One row per event and participant, with its place from 1."""
    return events.select("event_id", "scene_id", "evidence_ref", "confidence", F.posexplode("participants").alias("pos", "p")).select("event_id", "scene_id", F.col("p.entity_id").alias("entity_id"), F.col("p.role").alias("role"), (F.col("pos") + 1).alias("participant_index"), F.array("evidence_ref").alias("evidence_refs"), "confidence")


def label_counts(events: DataFrame, column: str) -> Column:
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n"))))


def scene_rollup(events: DataFrame) -> DataFrame:
    """Per scene: event ids in order, counts by both levels, participants, evidence."""
    per = events.groupBy("scene_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sequence_in_scene", "event_id"))), lambda x: x["event_id"]).alias("event_ids"),
        F.count("*").alias("event_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("participants", lambda p: p["entity_id"]))))).alias("participant_entity_ids"),
    )
    for level in ("event_type_l1", "event_type_l2"):
        counts = events.groupBy("scene_id", level).agg(F.count("*").alias("n")).groupBy("scene_id").agg(label_counts(events, level).alias(f"{level}_counts"))
        per = per.join(counts, "scene_id")
    return per


def top_types(events: DataFrame, most: int = 15, column: str = "event_type_l2") -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)
