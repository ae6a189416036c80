"""Turns as they arrive: the same classes and counts as in batch, by event time with a watermark.

The narrative tables themselves are batch; this is for feeds of utterances or events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions.text import col
from plotweave.operators import rules


def labelled(turns: DataFrame, *, text: str = "text", speaker: str = "role") -> DataFrame:
    """A stream or table of turns with label and confidence, by the rules that need no line before."""
    nothing = F.lit("")
    found = rules.first_match(rules.utterance_rules(text=col(text), cue=F.coalesce(col(speaker), nothing), modifiers=F.array().cast("array<string>"), location=nothing, header=nothing, answers=F.lit(False)))
    return turns.withColumn("_class", found).withColumns({"label": F.col("_class.label"), "confidence": F.col("_class.confidence")}).drop("_class")


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are dropped, as windows have been given out."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
