"""The star-schema, event and conversation tables as narrative tables: what the catalogue's queries run on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.text import slug


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: table, name column, entity type, id prefix
DIMENSIONS = (("region", "r_name", "location", "loc"), ("nation", "n_name", "location", "loc"), ("customer", "c_name", "character", "char"), ("supplier", "s_name", "organization", "org"), ("part", "p_name", "object", "obj"))


def entity_id(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))


#: How each dimension's key becomes an id.
KEYS = {"region": ("reg", "r_regionkey"), "nation": ("nat", "n_nationkey"), "customer": ("char", "c_custkey"), "supplier": ("org", "s_suppkey"), "part": ("obj", "p_partkey")}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_type, canonical_name, aliases of all dimensions."""
    parts = [table(spark, sf_dir, t).select(entity_id(*KEYS[t]).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("canonical_name"), F.array(slug(name)).alias("aliases")) for t, name, kind, _ in DIMENSIONS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, subject_id, predicate, object_id: places within places, people and firms in places."""
    rows = (("nation", KEYS["nation"], "part_of", ("reg", "n_regionkey")), ("customer", KEYS["customer"], "lives_in", ("nat", "c_nationkey")), ("supplier", KEYS["supplier"], "based_in", ("nat", "s_nationkey")))
    parts = [table(spark, sf_dir, t).select(entity_id(*subject).alias("subject_id"), F.lit(p).alias("predicate"), entity_id(*obj).alias("object_id")) for t, subject, p, obj in rows]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.withColumn("edge_id", F.concat_ws("|", "subject_id", "predicate", "object_id"))


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with its day as the scene and order within it by time."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("scene_id"), "ts", "user_id", F.col("event_type").alias("label"), "value", "props")


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scenes, turns as their blocks in order from 0."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("scene_id"), F.col("turn").alias("sequence_in_scene"), F.col("role").alias("speaker_entity_id"), "text", F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.lit("utterance").alias("block_type"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: conversations written out as scripts, with scene headers, cues and action lines between the turns."""
    t = table(spark, sf_dir, "conversations")
    c, n = F.col("conv_id"), F.col("turn")
    room = (c % 5).cast("string")
    header = (
        F.when((c + n) % 4 == 0, F.concat(F.lit("INT. ROOM "), room, F.lit(" - NIGHT")))
        .when((c + n) % 4 == 1, F.concat(F.lit("EXT. ROAD "), room, F.lit(" - DAY - 1975")))
        .when((c + n) % 4 == 2, F.concat(F.lit("INT./EXT. CAR "), room, F.lit(" - CONTINUED - LATER")))
        .otherwise(F.lit("EXT. YARD 1962 - FLASHBACK"))
    )
    cue = F.concat(F.upper("role"), F.when((c + n) % 3 == 1, " V/O").when((c + n) % 3 == 2, " (CONT'D)").otherwise(""))
    parts = F.array(
        F.when(n % 4 == 1, header), F.when(n % 4 == 1, F.lit("")), cue, F.when((c + n) % 5 == 0, F.lit("(quietly)")), F.col("text"),
        F.lit(""), F.when(n % 3 == 1, F.concat(F.lit("They wait at door "), n.cast("string"), F.lit("."))), F.when(n % 3 == 1, F.lit("")),
    )
    rows = F.array_sort(F.collect_list(F.struct("turn", F.array_join(F.array_compact(parts), "\n").alias("lines"))))
    return t.groupBy(c.alias("doc_id")).agg(F.array_join(F.transform(rows, lambda x: x["lines"]), "\n").alias("text"))
