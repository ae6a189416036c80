"""Phrases of a dictionary in texts: whole-word matches, and greedy choice among matches that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import literal, straight
from plotweave.sources.staging import staged

#: At most so many different phrases meet the texts where these are, without a shuffle of texts.
FEW_PHRASES = 200


def phrase_matches(texts: DataFrame, phrases: DataFrame, *, key: str, text: str, phrase: str) -> DataFrame:
    """texts x phrases where the phrase stands in the text with no letter or digit at either side, with its first start and stop.

    Places count from 0, the stop is behind the last character. A text with a phrase has all of its
    words, so a phrase only meets the texts that have its rarest word, and only those pairs reach
    the pattern; a phrase with a word that no text has meets none.
    """
    norm = F.lower(straight(text))
    words = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    p = F.lower(F.trim(straight(phrase)))
    right = phrases.withColumn("_phrase", p)
    parts = right.select("_phrase", F.explode(F.array_distinct(words(F.col("_phrase")))).alias("_word")).distinct()
    if len(parts.select("_phrase").distinct().limit(FEW_PHRASES + 1).collect()) <= FEW_PHRASES:
        return _matches_of_few(texts, right, parts, norm, words(norm))
    # Words that no phrase has go before anything is shuffled.
    said = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(words(norm))).alias("_word")).join(parts.select("_word").distinct(), "_word", "left_semi").distinct()
    known = said.groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = _rarest(parts, known)
    pairs = said.join(rarest, "_word").join(right, "_phrase").drop("_word")
    return _placed(texts.join(pairs, F.col(key) == F.col("_key")), norm).drop("_key")


def _rarest(parts: DataFrame, known: DataFrame) -> DataFrame:
    """_phrase, _word: of each phrase whose words all occur the one in fewest texts."""
    return parts.join(known, "_word", "left").groupBy("_phrase").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word")).alias("_best")).where("_best.n > 0").select("_phrase", F.col("_best._word").alias("_word"))


def _placed(met: DataFrame, norm: Column) -> DataFrame:
    """Of texts beside phrases those that have them, with start and stop."""
    shape = F.concat(F.lit("(?<![a-z0-9])"), literal("_phrase"), F.lit("(?![a-z0-9])"))
    at = F.regexp_instr(norm, shape)
    return met.withColumn("start", at - 1).where("start >= 0").withColumn("stop", F.col("start") + F.length("_phrase")).drop("_phrase")


def _matches_of_few(texts: DataFrame, right: DataFrame, parts: DataFrame, norm: Column, words: Column) -> DataFrame:
    """The matches of few phrases, by one pass over the texts for counts of words and one for matches."""
    wanted = sorted(r["_word"] for r in parts.select("_word").distinct().collect())
    own = F.array_intersect(words, F.array(*map(F.lit, wanted)).cast("array<string>"))
    known = texts.select(F.explode(own).alias("_word")).groupBy("_word").agg(F.count("*").alias("_n"))
    met = texts.withColumn("_word", F.explode(own)).join(F.broadcast(_rarest(parts, known)), "_word").drop("_word")
    return _placed(met.join(right, "_phrase"), norm)


def first_of_entity(matches: DataFrame, *keys: str, entity: str = "entity_id") -> DataFrame:
    """Of each entity's matches in a text the earliest, and of those the longest."""
    best = F.min(F.struct("start", (F.col("start") - F.col("stop")).alias("minus_length")))
    return matches.groupBy(*keys, entity).agg(best.alias("best")).select(*keys, entity, F.col("best.start").alias("start"), (F.col("best.start") - F.col("best.minus_length")).alias("stop"))


def non_overlapping(spans: Column) -> Column:
    """Of an array of structs (start, stop, ...) sorted by start, then longest: each that starts behind the last one kept."""
    empty = F.slice(spans, 1, 0)
    kept = F.aggregate(
        spans,
        F.struct(empty.alias("kept"), F.lit(-1).alias("stop")),
        lambda acc, x: F.when(x["start"] >= acc["stop"], F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x["stop"].alias("stop"))).otherwise(acc),
    )
    return kept["kept"]


def mentions(texts: DataFrame, names: DataFrame, *, key: str, text: str, entity: str = "entity_id", name: str = "name") -> DataFrame:
    """key, mentions: entities named in a text in order of place, overlaps decided for the earlier and then the longer."""
    best = first_of_entity(phrase_matches(texts.select(key, text), names.select(entity, name), key=key, text=text, phrase=name), key, entity=entity)
    ordered = F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("stop")).alias("minus_length"), entity, "stop")))
    return best.groupBy(key).agg(ordered.alias("spans")).select(key, F.transform(non_overlapping(F.col("spans")), lambda s: s[entity]).alias("mentions"))


def greedy_in_order(spans: Column) -> Column:
    """Of an array of structs (start, stop, ...), taken in the array's order: each that overlaps none that is kept."""
    return F.aggregate(
        spans,
        F.slice(spans, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: (x["start"] < k["stop"]) & (k["start"] < x["stop"])), kept).otherwise(F.concat(kept, F.array(x))),
    )


def detected(questions: DataFrame, lexicon: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, entity_id, phrase, start, stop, place: lexicon phrases in questions, the longest first, then by priority and phrase; each entity once.

    Entities of one phrase would be found at the same place, where the first of them wins: so that one alone meets the questions.
    """
    order = ((-F.length("phrase")).alias("minus_length"), (-F.col("priority")).alias("minus_priority"), "phrase", "entity_id")
    first_named = lexicon.groupBy(F.lower(F.trim(straight("phrase"))).alias("_same")).agg(F.min(F.struct(*order)).alias("m"))
    named = staged(first_named.select("m.entity_id", "m.phrase", (-F.col("m.minus_priority")).alias("priority")), "lexicon")
    found = phrase_matches(questions.select(key, text), named, key=key, text=text, phrase="phrase")
    kept = found.groupBy(key).agg(greedy_in_order(F.array_sort(F.collect_list(F.struct(*order, "start", "stop")))).alias("kept"))
    flat = kept.select(key, F.explode("kept").alias("m")).select(key, "m.entity_id", "m.phrase", "m.start", "m.stop")
    first = flat.groupBy(key, "entity_id").agg(F.min_by(F.struct("phrase", "start", "stop"), "start").alias("m")).select(key, "entity_id", "m.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start")))
