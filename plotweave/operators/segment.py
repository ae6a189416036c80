"""Lines to scenes and blocks by windows.

A line is blank, a scene header, an accepted cue, a cue that was not accepted, or other text. With
groups that start at headers and accepted cues, a line of text is spoken where its group starts
with a cue, no unaccepted cue came before or with it, and no blank lies between the first text and
it; else it is action. Blocks start at headers, at cues, and at action lines after none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import lines as L
from plotweave.functions.text import cue_modifiers, markers, numbered_id, squeeze


def by_doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_symbols(lines: DataFrame) -> DataFrame:
    """Each line with its symbol: B blank, H header, A accepted cue, P probable cue, X other."""
    line = F.trim("line")
    basic = lines.withColumn("line", line).withColumn("probable", L.is_probable_cue(line)).withColumn("header", L.is_header(line)).withColumn("blank", line == "")
    # What follows a cue decides: the next line that is not blank, and the one after it behind a parenthetical.
    said = basic.where("not blank").select(
        "doc_id", "line_no",
        *(F.lead(F.struct("line", "probable", "header"), k).over(by_doc()).alias(f"next{k}") for k in (1, 2)),
    )
    looked = basic.join(said, ["doc_id", "line_no"], "left")
    one, two = F.col("next1"), F.col("next2")
    stub = line.contains("V/O") | line.contains("(")
    ends = lambda n: n.isNull() | n["header"] | n["probable"]
    accepted = F.when(ends(one), stub).when(L.is_parenthetical(one["line"]), F.when(ends(two), stub).otherwise(L.looks_spoken(two["line"]))).otherwise(L.looks_spoken(one["line"]))
    symbol = F.when(F.col("blank"), "B").when(F.col("header"), "H").when(F.col("probable") & accepted, "A").when(F.col("probable"), "P").otherwise("X")
    return looked.select("doc_id", "line_no", "line", symbol.alias("symbol"))


def with_blocks(symbols: DataFrame) -> DataFrame:
    """doc_id, line_no, line, symbol with kind (scene_header, cue, spoken, action; null for blanks) and block_no."""
    s = F.col("symbol")
    grouped = symbols.withColumn("part", F.sum(F.when(s.isin("H", "A"), 1).otherwise(0)).over(so_far()))
    in_part = Window.partitionBy("doc_id", "part").orderBy("line_no")
    upto, past = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow), in_part.rowsBetween(Window.unboundedPreceding, -1)
    text = s.isin("P", "X")
    told = (
        grouped.withColumn("anchor", F.first("symbol").over(upto))
        .withColumn("unaccepted", F.max(F.when(s == "P", 1).otherwise(0)).over(upto))
        .withColumn("first_text", F.min(F.when(text, F.col("line_no"))).over(upto))
        .withColumn("last_blank", F.max(F.when(s == "B", F.col("line_no"))).over(past))
    )
    unbroken = F.col("last_blank").isNull() | (F.col("last_blank") < F.col("first_text"))
    spoken = (F.col("anchor") == "A") & (F.col("unaccepted") == 0) & unbroken
    kind = F.when(s == "H", "scene_header").when(s == "A", "cue").when(text & spoken, "spoken").when(text, "action")
    kinds = told.withColumn("kind", kind)
    starts = F.when(F.col("kind").isin("scene_header", "cue") | ((F.col("kind") == "action") & ~F.lag("kind").over(by_doc()).eqNullSafe(F.lit("action"))), 1).otherwise(0)
    return kinds.withColumn("start", starts).withColumn("block_no", F.sum("start").over(so_far())).select("doc_id", "line_no", "line", "symbol", "kind", "block_no")


def blocks(lines: DataFrame) -> DataFrame:
    """The blocks of each document in order, with scene numbers and places within the scene.

    A header is its scene's block 0; what comes before the first header is a scene of its own,
    whose blocks are numbered from 1.
    """
    told = with_blocks(with_symbols(lines)).where("kind is not null")
    content = F.array_sort(F.collect_list(F.when(F.col("kind") != "cue", F.struct("line_no", "line"))))
    grouped = told.groupBy("doc_id", "block_no").agg(
        F.min_by("kind", "line_no").alias("first_kind"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
        content.alias("parts"), F.max(F.when(F.col("kind") == "cue", F.col("line"))).alias("speaker_cue_raw"),
    )
    kind = F.when(F.col("first_kind") == "cue", "utterance").otherwise(F.col("first_kind"))
    text = squeeze(F.array_join(F.transform("parts", lambda x: x["line"]), " "))
    by_block = Window.partitionBy("doc_id").orderBy("block_no")
    upto = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = grouped.withColumn("block_type", kind).withColumn("text", text)
    headers = F.sum(F.when(F.col("block_type") == "scene_header", 1).otherwise(0)).over(upto)
    prelude = F.when(F.first("block_type").over(upto) == "scene_header", 0).otherwise(1)
    scened = whole.withColumn("scene_index", headers + prelude)
    in_scene = Window.partitionBy("doc_id", "scene_index").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda t, w: F.sum(F.when(F.col("block_type") == t, 1).otherwise(0)).over(w)
    marked = F.concat_ws(" ", "speaker_cue_raw", "text")
    return scened.select(
        "doc_id",
        numbered_id("blk", F.row_number().over(by_block)).alias("block_id"),
        numbered_id("scene", "scene_index", 4).alias("scene_id"),
        "scene_index",
        "block_type",
        F.sum(F.when(F.col("block_type") == "scene_header", 0).otherwise(1)).over(in_scene).alias("sequence_in_scene"),
        "line_start",
        "line_end",
        "text",
        markers(marked).alias("markers"),
        "speaker_cue_raw",
        F.when(F.col("block_type") == "utterance", cue_modifiers("speaker_cue_raw")).alias("delivery_modifiers"),
        F.when(F.col("block_type") == "utterance", numbered_id("utt", count("utterance", upto))).alias("utterance_id"),
        F.when(F.col("block_type") == "action", numbered_id("act", count("action", upto))).alias("action_id"),
    )


def scenes(found: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per scene: header fields, flags, and the lines from its header to the one before the next."""
    sizes = lines.groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
    first = found.groupBy("doc_id", "scene_id", "scene_index").agg(F.min("line_start").alias("line_start"), F.max(F.when(F.col("block_type") == "scene_header", F.col("text"))).alias("header_raw"))
    following = F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("scene_index"))
    told = first.join(sizes, "doc_id").withColumn("line_end", F.coalesce(following - 1, F.col("last_line")))
    fields, own = L.header_fields(F.col("header_raw")), F.col("header_raw").isNotNull()
    pick = lambda name, other: F.when(own, fields[name]).otherwise(other)
    return told.select(
        "doc_id", "scene_id", "scene_index",
        F.coalesce("header_raw", F.lit("IMPLICIT PRELUDE (NO SCENE HEADER)")).alias("header_raw"),
        pick("header_prefix", F.lit("IMPLICIT")).alias("header_prefix"),
        pick("location_raw", F.lit("IMPLICIT PRELUDE")).alias("location_raw"),
        pick("location_canonical_id", F.lit("loc_implicit_prelude")).alias("location_canonical_id"),
        pick("time_of_day", F.lit(None)).alias("time_of_day"),
        pick("year_explicit", F.lit(None).cast("int")).alias("year_explicit"),
        F.lit(None).cast("int").alias("year_inferred"),
        pick("flags", F.array(F.lit("synthetic_prelude_scene"))).alias("flags"),
        "line_start", "line_end",
    )


def utterances(found: DataFrame) -> DataFrame:
    return found.where("block_type = 'utterance'").select("doc_id", "utterance_id", "scene_id", "speaker_cue_raw", F.lit(None).cast("string").alias("speaker_entity_id"), "delivery_modifiers", "text", "line_start", "line_end", "sequence_in_scene")


def action_beats(found: DataFrame) -> DataFrame:
    return found.where("block_type = 'action'").select("doc_id", "action_id", "scene_id", "text", "line_start", "line_end", "sequence_in_scene")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, measure, name, n: counts of block types, markers, header prefixes and empty utterances."""
    kinds = found.groupBy("doc_id", F.lit("block_type").alias("measure"), F.col("block_type").alias("name")).agg(F.count("*").alias("n"))
    marks = found.select("doc_id", F.explode("markers").alias("name")).groupBy("doc_id", F.lit("marker").alias("measure"), "name").agg(F.count("*").alias("n"))
    prefix = found.where("block_type = 'scene_header'").groupBy("doc_id", F.lit("header_prefix").alias("measure"), L.header_fields(F.col("text"))["header_prefix"].alias("name")).agg(F.count("*").alias("n"))
    empty = found.groupBy("doc_id", F.lit("empty").alias("measure"), F.lit("utterance").alias("name")).agg(F.count_if((F.col("block_type") == "utterance") & (F.col("text") == "")).alias("n"))
    return kinds.unionByName(marks).unionByName(prefix).unionByName(empty)
