"""Which texts contain which needles, whatever the case: postings of six-character grams, then a check of what they give.

A text that contains a needle has all of its grams. The postings (gram, id) of the texts can be
written once and searched again and again; a needle asks for its rarest gram only, so what meets
grows with the rarest gram and not with the number of texts. A needle of up to six characters is
its own gram, and meets no text in vain: with shorter grams needles of digits would each meet the
same share of all texts, and pairs would grow with needles times texts. Where a caller allows it,
few needles are looked for where the texts are, without postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.sources.staging import staged

GRAM = 6
#: What is few for needles that meet the texts where these are.
FEW_NEEDLES = 200


def grams(c: Column, n: int = GRAM) -> Column:
    """The different grams of n characters of a lower-case text."""
    chars = F.split(c, "")
    places = F.sequence(F.lit(1), F.length(c) - (n - 1))
    cut = F.transform(places, lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.length(c) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame, *, key: str, text: str, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """gram, key of all texts, each pair once."""
    low = texts.select(F.col(key).alias("key"), F.lower(text).alias("low")).where("low is not null")
    all_sizes = F.concat(*(grams(F.col("low"), n) for n in sizes)) if len(sizes) > 1 else grams(F.col("low"), sizes[0])
    return low.select("key", F.explode(all_sizes).alias("gram"))


def short_sizes(needles: DataFrame, *, needle: str) -> tuple[int, ...]:
    """Sizes of grams that needles need: those shorter than a gram have one of their own size."""
    found = needles.select(F.least(F.length(needle), F.lit(GRAM)).alias("n")).where("n > 0").distinct()
    return tuple(sorted(r["n"] for r in found.collect())) or (GRAM,)


def contained(needles: DataFrame, texts: DataFrame, *, needle_key: str, needle: str, key: str, text: str, index: DataFrame | None = None, few: int = 0) -> DataFrame:
    """needle_key, key: needles and the texts that contain them, case apart. Empty or null needles and texts meet nothing.

    index: the texts' postings, of all sizes that the needles need, where they are written already.
    few: up to so many different needles are looked for in all texts, without postings.
    """
    asked = needles.select(F.col(needle_key).alias("_needle_key"), F.lower(needle).alias("_needle")).where("_needle <> ''")
    if few:
        found = [r["_needle"] for r in asked.select("_needle").distinct().limit(few + 1).collect()]
        if len(found) <= few:
            sure = _texts_of_few(found, texts, key=key, text=text)
            return asked.join(sure, "_needle").select(F.col("_needle_key").alias(needle_key), F.col("key").alias(key))
    if index is None:
        index = postings(texts, key=key, text=text, sizes=short_sizes(asked, needle="_needle"))
    own = F.when(F.length("_needle") >= GRAM, grams(F.col("_needle"))).otherwise(F.array("_needle"))
    wanted = asked.select("_needle", F.explode(own).alias("gram")).distinct()
    # Only postings that a needle asks for are kept, for counting and for meeting.
    index = staged(index.join(wanted.select("gram").distinct(), "gram", "left_semi"), "asked-postings")
    counted = index.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text has rules its needle out; else the rarest one stands for the needle.
    rarest = wanted.join(counted, "gram", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0").select("_needle", F.col("best.gram").alias("gram"))
    met = rarest.join(index, "gram").select("_needle", "key")
    whole = texts.select(F.col(key).alias("key"), F.lower(text).alias("_low"))
    sure = met.join(whole, "key").where(F.contains("_low", "_needle")).select("_needle", "key")
    return asked.join(sure, "_needle").select(F.col("_needle_key").alias(needle_key), F.col("key").alias(key))


def _texts_of_few(needles: list[str], texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """_needle, key: the texts that contain the lower-case needles, by one pass over the texts."""
    low = texts.select(F.col(key).alias("key"), F.lower(text).alias("_low"))
    if not needles:
        return low.select(F.lit("").alias("_needle"), "key").limit(0)
    own = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(n)), F.lit(n)) for n in sorted(needles))))
    return low.select(F.explode(own).alias("_needle"), "key")
