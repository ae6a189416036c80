"""Entities and aliases from speaker cues and scene headers, with a hand-made seed that comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import alias_normal, display_name, entity_slug, numbered_id
from plotweave.operators.numbering import with_numbers

#: Order of entity types (fixed values).
TYPE_ORDER = ("character", "group", "organization", "location", "object")
NO_CUES = ("CUT TO", "DISSOLVE TO", "FADE IN", "FADE OUT")


def type_rank(c: Column) -> Column:
    out = F
    for k, t in enumerate(TYPE_ORDER):
        out = out.when(c == t, k)
    return out.otherwise(99)


def is_ignored(raw: Column, norm: Column, config: dict) -> Column:
    """Cues that the configuration names (exact, normalized, by prefix, by content), empty ones, transitions, and unresolved several speakers."""
    out = (norm == "") | norm.isin(*NO_CUES)
    if config.get("ignored_cues_exact"):
        out = out | raw.isin(*config["ignored_cues_exact"])
    if config.get("ignored_cues_normalized"):
        out = out | norm.isin(*config["ignored_cues_normalized"])
    for c in (raw, norm):
        for p in config.get("ignored_cue_prefixes", ()):
            out = out | c.startswith(p)
        for p in config.get("ignored_cue_contains", ()):
            out = out | c.contains(p)
    return out


def resolved_cues(utterances: DataFrame, exact: DataFrame, normal: DataFrame, config: dict | None = None) -> DataFrame:
    """The utterances' cues with entity_id and alias_kind.

    exact (alias_raw, entity_id) and normal (alias_normalized, entity_id) are the seed's maps; what
    neither has gets an id from its normal form, of which the first utterance counts as the origin.
    """
    cues = utterances.select("utterance_id", "scene_id", F.col("speaker_cue_raw").alias("raw")).withColumn("norm", alias_normal("raw"))
    cues = cues.where(~is_ignored(F.col("raw"), F.col("norm"), config or {}))
    met = cues.join(exact.select(F.col("alias_raw").alias("_raw"), F.col("entity_id").alias("by_raw")), F.col("raw") == F.col("_raw"), "left").join(
        normal.select(F.col("alias_normalized").alias("_norm"), F.col("entity_id").alias("by_norm")), F.col("norm") == F.col("_norm"), "left"
    )
    several = F.col("norm").contains(" AND ") | F.col("norm").contains("/")
    own = F.concat(F.lit("char_"), entity_slug("norm"))
    origin = F.row_number().over(Window.partitionBy("norm").orderBy("utterance_id")) == 1
    kind = F.when(F.col("by_raw").isNotNull(), "manual_exact").when(F.col("by_norm").isNotNull(), "manual_normalized").when(origin, "auto_from_cue").otherwise("normalized_match")
    return met.where(F.col("by_raw").isNotNull() | F.col("by_norm").isNotNull() | ~several).select("utterance_id", "scene_id", "raw", "norm", F.coalesce("by_raw", "by_norm", own).alias("entity_id"), kind.alias("alias_kind"))


def alias_records(cues: DataFrame) -> DataFrame:
    """alias_raw, alias_normalized, entity_id, alias_kind, source, first_scene_id, count: the first writer's kind holds."""
    raw = cues.groupBy(F.col("raw").alias("alias_raw"), "entity_id").agg(F.min_by("alias_kind", "utterance_id").alias("alias_kind"), F.min("norm").alias("alias_normalized"), F.min("scene_id").alias("first_scene_id"), F.count("*").alias("count"), F.lit("utterance_cue").alias("source"))
    norm = cues.where("raw <> norm").groupBy(F.col("norm").alias("alias_raw"), "entity_id").agg(F.lit("normalized_cue").alias("alias_kind"), F.min("norm").alias("alias_normalized"), F.min("scene_id").alias("first_scene_id"), F.lit(0).cast("long").alias("count"), F.lit("utterance_cue").alias("source"))
    both = raw.withColumn("rank", F.lit(0)).unionByName(norm.withColumn("rank", F.lit(1)))
    first = lambda c: F.min_by(c, "rank").alias(c)
    return both.groupBy("alias_raw", "entity_id").agg(first("alias_kind"), first("alias_normalized"), F.min("first_scene_id").alias("first_scene_id"), F.sum("count").alias("count"), first("source"))


def characters(cues: DataFrame, seed: DataFrame) -> DataFrame:
    """Entities of cues, a seed row's name and type first; seed rows that no cue names are kept."""
    told = cues.groupBy("entity_id").agg(F.min("scene_id").alias("first_scene_id"), F.count("*").alias("utterance_count"), F.sort_array(F.collect_set("raw")).alias("cue_aliases"), F.min_by("norm", "utterance_id").alias("norm"))
    joined = told.join(seed.select("entity_id", F.col("entity_type").alias("seed_type"), F.col("canonical_name").alias("seed_name"), F.col("aliases").alias("seed_aliases")), "entity_id", "full")
    none = F.array().cast("array<string>")
    return joined.select(
        "entity_id",
        F.coalesce("seed_type", F.lit("character")).alias("entity_type"),
        F.coalesce("seed_name", display_name("norm")).alias("canonical_name"),
        F.sort_array(F.array_union(F.coalesce("seed_aliases", none), F.coalesce("cue_aliases", none))).alias("aliases"),
        "first_scene_id",
        F.coalesce("utterance_count", F.lit(0)).alias("utterance_count"),
    )


def locations(scenes: DataFrame) -> DataFrame:
    """Places of scene headers: number of scenes, distinct prefixes in order, up to five examples."""
    real = scenes.where(~F.array_contains("flags", "synthetic_prelude_scene"))
    return real.groupBy(F.col("location_canonical_id").alias("entity_id")).agg(
        F.min_by("location_raw", "scene_index").alias("canonical_name"),
        F.min("scene_id").alias("first_scene_id"),
        F.count("*").alias("scene_count"),
        F.sort_array(F.collect_set("header_prefix")).alias("header_prefixes"),
        F.slice(F.sort_array(F.collect_set("location_raw")), 1, 5).alias("scene_location_examples"),
    )


def backfilled(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """First scenes that entities lack, from their aliases."""
    seen = aliases.groupBy(F.col("entity_id").alias("_id")).agg(F.min("first_scene_id").alias("_first"))
    return entities.join(seen, F.col("entity_id") == F.col("_id"), "left").withColumn("first_scene_id", F.coalesce("first_scene_id", "_first")).drop("_id", "_first")


def alias_ids(aliases: DataFrame) -> DataFrame:
    """Numbers after the sort by normal form, raw form and entity."""
    placed = with_numbers(aliases, "alias_normalized", "alias_raw", "entity_id")
    return placed.withColumn("alias_record_id", numbered_id("ealias", "number")).drop("number")


def in_order(entities: DataFrame) -> DataFrame:
    return entities.orderBy(type_rank(F.col("entity_type")), "canonical_name", "entity_id")
