"""Lookup tables that stay where their keys are: edges by either end, events by participant, evidence by event.

A table is written once in buckets of its key, sorted within each; every later lookup of a set of
keys, however large, joins it bucket by bucket, and what is moved is the keys that are asked for.
Small sets of keys are left to Spark, which broadcasts what is below its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.sources.staging import bucketed


def edge_ends(edges: DataFrame) -> DataFrame:
    """entity_id, direction, neighbor_id, predicate, edge_id: each edge at both of its ends, a loop as outgoing only."""
    out = edges.select(F.col("subject_id").alias("entity_id"), F.lit("outgoing").alias("direction"), F.col("object_id").alias("neighbor_id"), "predicate", "edge_id")
    into = edges.where("subject_id <> object_id").select(F.col("object_id").alias("entity_id"), F.lit("incoming").alias("direction"), F.col("subject_id").alias("neighbor_id"), "predicate", "edge_id")
    return out.unionByName(into)


def adjacency(edges: DataFrame, buckets: int | None = None) -> DataFrame:
    """The ends of all edges as a table by entity."""
    return bucketed(edge_ends(edges), "adjacency", "entity_id", buckets=buckets)


def roster(events: DataFrame, buckets: int | None = None) -> DataFrame:
    """entity_id, event_id, role as a table by entity: who takes part in what."""
    rows = events.select("event_id", F.inline("participants")).select("entity_id", "event_id", "role").distinct()
    return bucketed(rows, "roster", "entity_id", buckets=buckets)


def degrees(ends: DataFrame) -> DataFrame:
    """entity_id, edges, neighbors, outgoing: how many an entity has; grouped where the rows are."""
    return ends.groupBy("entity_id").agg(F.count("*").alias("edges"), F.count_if(F.col("direction") == "outgoing").alias("outgoing"))


def activity(ends: DataFrame, taking_part: DataFrame) -> DataFrame:
    """entity_id, edges, events of the entities in both tables, bucket by bucket."""
    seen = taking_part.groupBy("entity_id").agg(F.count("*").alias("events"))
    return degrees(ends).join(seen, "entity_id").select("entity_id", "edges", "events")


def neighbors_of(ends: DataFrame, keys: DataFrame) -> DataFrame:
    """The ends of the entities in `keys` (entity_id)."""
    return ends.join(keys.select("entity_id").distinct(), "entity_id", "left_semi")
