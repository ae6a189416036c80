"""Relationship state changes: rules joined with events, blended confidence, ordered provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.text import directed_pair, numbered_id, undirected_pair
from plotweave.operators.numbering import with_numbers

#: Allowed values (fixed values).
DIRECTIONS = ("increase", "decrease", "shift", "emerge", "dissolve")
CLAIMS = ("explicit", "inferred")
MAGNITUDES = ("low", "medium", "high")
REQUIRED = ("rule_id", "subject_id", "object_id", "state_dimension", "direction", "claim_type", "confidence", "inference_method")
RULES = "rule_id string, subject_id string, object_id string, event_type_l1_any array<string>, event_type_l2_any array<string>, event_type_l2_not array<string>, min_event_confidence double, text_any array<string>, text_all array<string>, text_none array<string>, state_dimension string, direction string, magnitude string, claim_type string, confidence double, inference_method string, enabled boolean"


def checked_rules(rules: list[dict], claims: tuple[str, ...] = CLAIMS, magnitudes: tuple[str, ...] = MAGNITUDES, directions: tuple[str, ...] = DIRECTIONS) -> list[dict]:
    """The enabled rules; one that lacks a field or has a value that is not allowed raises."""
    for k, rule in enumerate(rules):
        missing = [f for f in REQUIRED if rule.get(f) in (None, "")]
        if missing:
            raise ValueError(f"rule {k} lacks {', '.join(missing)}")
        if rule["claim_type"] not in claims or rule.get("magnitude") not in (None, *magnitudes):
            raise ValueError(f"rule {rule['rule_id']} has a claim type or magnitude that is not allowed")
        if rule["direction"] not in directions:
            raise ValueError(f"rule {rule['rule_id']} has a direction that is not allowed")
    return [r for r in rules if r.get("enabled", True)]


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    names = [f.split(" ")[0] for f in RULES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in checked_rules(rules)], RULES)


def haystack(summary: Column, snippets: Column, notes: Column, l1: Column, l2: Column) -> Column:
    """What text conditions look at; quotes stay as they are."""
    return F.lower(F.concat_ws(" \n ", summary, snippets, notes, l1, l2))


def blended(rule: Column, event: Column) -> Column:
    return F.round(F.least(F.greatest(0.7 * rule + 0.3 * event, F.lit(0.05)), F.lit(0.999)), 3)


def hits(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules met by events: events have event_id, scene_id, position, event_type_l1/l2, confidence, haystack, people (array of ids), refs.

    The pair of ids is the join's key: events are spread over their pairs only where a rule asks
    for the pair, and every other condition is checked on what meets.
    """
    wanted = rules.select("subject_id", "object_id").distinct()
    asked = F.broadcast(wanted.select(F.col("subject_id").alias("_s"), F.col("object_id").alias("_o")))
    subjects = events.withColumn("_subject", F.explode(F.array_distinct("people"))).where(F.size(F.array_distinct("people")) >= 2)
    pairs = subjects.join(asked, F.col("_subject") == F.col("_s")).where(F.array_contains("people", F.col("_o")))
    r = F.broadcast(rules.select(*(F.col(c).alias(f"r_{c}") for c in rules.columns)))
    met = pairs.join(r, (F.col("_s") == F.col("r_subject_id")) & (F.col("_o") == F.col("r_object_id")))
    unset = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    text = lambda n: F.contains(F.col("haystack"), F.lower(n))
    conditions = [
        unset("r_event_type_l1_any") | F.array_contains("r_event_type_l1_any", F.col("event_type_l1")),
        unset("r_event_type_l2_any") | F.array_contains("r_event_type_l2_any", F.col("event_type_l2")),
        unset("r_event_type_l2_not") | ~F.array_contains("r_event_type_l2_not", F.col("event_type_l2")),
        F.col("r_min_event_confidence").isNull() | (F.col("confidence") >= F.col("r_min_event_confidence")),
        unset("r_text_any") | F.exists("r_text_any", text),
        unset("r_text_all") | F.forall("r_text_all", text),
        unset("r_text_none") | ~F.exists("r_text_none", text),
    ]
    kept = met.where(reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions)))
    return kept.select(
        "event_id", "scene_id", "position", "event_type_l2", "refs", F.col("_s").alias("subject_id"), F.col("_o").alias("object_id"), "r_rule_id", "r_state_dimension", "r_direction", "r_claim_type", "r_magnitude", "r_inference_method",
        blended(F.col("r_confidence"), F.col("confidence")).alias("hit_confidence"),
    )


def magnitude_rank(c: Column) -> Column:
    return F.when(c == "low", 1).when(c == "medium", 2).when(c == "high", 3).otherwise(0)


def state_changes(found: DataFrame) -> DataFrame:
    """One row per scene, pair, dimension, direction and claim, with what led to it in order."""
    keys = ["scene_id", "subject_id", "object_id", "r_state_dimension", "r_direction", "r_claim_type"]
    rows = F.array_sort(F.collect_list(F.struct("position", "r_rule_id", "event_id", "refs", "event_type_l2", "r_inference_method")))
    grouped = found.groupBy(*keys).agg(rows.alias("rows"), F.max("hit_confidence").alias("confidence"), F.max_by("r_magnitude", magnitude_rank(F.col("r_magnitude"))).alias("magnitude"), F.min("position").alias("position"))

    def each(name: str) -> Column:
        return F.array_distinct(F.transform("rows", lambda x: x[name]))

    return grouped.select(
        "scene_id", "subject_id", "object_id", F.col("r_state_dimension").alias("state_dimension"), F.col("r_direction").alias("direction"), F.col("r_claim_type").alias("claim_type"), "magnitude", "confidence", "position",
        each("event_id").alias("trigger_event_ids"), F.array_distinct(F.flatten(F.transform("rows", lambda x: x["refs"]))).alias("evidence_refs"), each("r_rule_id").alias("rule_ids"), each("event_type_l2").alias("trigger_event_type_l2s"), F.col("rows")[0]["r_inference_method"].alias("inference_method"),
    )


def numbered_changes(changes: DataFrame) -> DataFrame:
    placed = with_numbers(changes, "position", "scene_id", "subject_id", "object_id", "state_dimension", "direction", "claim_type")
    return placed.withColumn("state_change_id", numbered_id("sc", "number")).drop("number")


def facets(changes: DataFrame) -> DataFrame:
    """facet, value, n: counts by claim, dimension, direction, directed and undirected pair, in one pass."""
    said = changes.select(F.inline(F.array(
        F.struct(F.lit("claim_type").alias("facet"), F.col("claim_type").alias("value")),
        F.struct(F.lit("state_dimension").alias("facet"), F.col("state_dimension").alias("value")),
        F.struct(F.lit("direction").alias("facet"), F.col("direction").alias("value")),
        F.struct(F.lit("pair_directed").alias("facet"), directed_pair("subject_id", "object_id").alias("value")),
        F.struct(F.lit("pair_undirected").alias("facet"), undirected_pair("subject_id", "object_id").alias("value")),
    )))
    return said.groupBy("facet", "value").agg(F.count("*").alias("n"))


def core_pairs(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The wanted pairs with how many changes they have in their direction and in either, none included."""
    counts = changes.groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))
    directed = counts.select(F.col("subject_id").alias("_s"), F.col("object_id").alias("_o"), F.col("n").alias("directed"))
    either = counts.groupBy(undirected_pair("subject_id", "object_id").alias("_key")).agg(F.sum("n").alias("undirected"))
    joined = pairs.join(directed, (F.col("subject_id") == F.col("_s")) & (F.col("object_id") == F.col("_o")), "left").join(either, undirected_pair("subject_id", "object_id") == F.col("_key"), "left")
    return joined.select("subject_id", "object_id", F.coalesce("directed", F.lit(0)).alias("directed_count"), F.coalesce("undirected", F.lit(0)).alias("undirected_count"))
