"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns, by role and text, and is rendered once; the rest
of each conversation is a completion, with the spans of characters that a loss may count: those of
the assistant's words and of the mark that ends them. Turns stay rows until the last step, where a
pair's turns meet for its texts; lengths of texts before a turn are running sums, so a long
conversation costs what its turns cost. Only DataFrame functions are used.

Defined cases: turns are ordered by number, then role and text, so repeated numbers have an order; a
null text is rendered empty and a null role as `unknown`, and both equal only themselves; equal
conversations give two empty completions; a pair that lacks one side is no pair and gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def numbered(side: DataFrame, name: str, *, pair: str, turn: str, role: str, text: str) -> DataFrame:
    order = W.partitionBy("pair").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    plain = side.select(F.col(pair).alias("pair"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return plain.select("pair", F.row_number().over(order).alias("place"), F.struct("role", "text").alias(name))


def format_pairs(chosen: DataFrame, rejected: DataFrame, *, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant") -> DataFrame:
    """pair, n_prompt_turns, prompt, and for either side its completion and loss_spans (start, length)."""
    names = {"pair": pair, "turn": turn, "role": role, "text": text}
    sides = ("chosen", "rejected")
    both = numbered(chosen, "chosen", **names).join(numbered(rejected, "rejected", **names), ["pair", "place"], "full")
    through = W.partitionBy("pair").orderBy("place")
    # Turns are common up to the first place where the sides differ.
    common = F.min(F.when(F.col("chosen").eqNullSafe(F.col("rejected")), 1).otherwise(0)).over(through.rowsBetween(W.unboundedPreceding, 0)) == 1
    told = both.withColumn("common", common)
    for s in sides:
        told = told.withColumn(f"{s}_text", F.when(F.col(s).isNotNull(), rendered(F.col(s)["role"], F.col(s)["text"])))
        own = F.when(~F.col("common"), F.coalesce(F.length(f"{s}_text"), F.lit(0))).otherwise(F.lit(0))
        before = F.sum(own).over(through.rowsBetween(W.unboundedPreceding, 0)) - own
        head = F.length(F.concat(F.lit(OPEN), F.coalesce(F.col(s)["role"], F.lit("unknown")), F.lit("\n")))
        span = F.struct((before + head).cast("long").alias("start"), (F.length(f"{s}_text") - head - 1).cast("long").alias("length"))
        told = told.withColumn(f"{s}_span", F.when(~F.col("common") & (F.col(s)["role"] == learner), span))
    gather = lambda what, when: F.sort_array(F.collect_list(F.when(when & F.col(what).isNotNull(), F.struct("place", what))))
    joined = told.groupBy("pair").agg(
        F.count_if("common").alias("n_prompt_turns"),
        gather("chosen_text", F.col("common")).alias("prompt"),
        *(gather(f"{s}_text", ~F.col("common")).alias(s) for s in sides),
        *(gather(f"{s}_span", ~F.col("common")).alias(f"{s}_spans") for s in sides),
        *(F.count(s).alias(f"{s}_turns") for s in sides),
    )

    def field(c: str, name: str) -> Column:
        return F.transform(c, lambda x: x[name])

    return joined.where("chosen_turns > 0 and rejected_turns > 0").select(
        F.col("pair").alias(pair),
        "n_prompt_turns",
        F.array_join(field("prompt", "chosen_text"), "").alias("prompt"),
        *(F.array_join(field(s, f"{s}_text"), "").alias(f"{s}_completion") for s in sides),
        *(field(f"{s}_spans", f"{s}_span").alias(f"{s}_loss_spans") for s in sides),
    )


def spans_as_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["length"])), ",")


def swapped_replies(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations, as turns of the chosen and of the rejected side.

    Chosen is a conversation up to the assistant's last reply; rejected is the same with the last
    reply of the conversation whose id is next by one. Conversations without either give no pair.
    """
    last = turns.where(F.col(role) == learner).groupBy(conv).agg(F.max(F.struct(turn, text)).alias("last"))
    other = last.select((F.col(conv) - 1).alias(conv), F.col("last")[text].alias("reply"))
    pairs = last.join(other, conv).select(F.col(conv).alias("pair_id"), F.col("last")[turn].alias("at"), "reply")
    own = turns.select(F.col(conv).alias("pair_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).join(pairs, "pair_id").where("turn <= at")
    is_last = (F.col("turn") == F.col("at")) & (F.col("role") == learner)
    return own.drop("at", "reply"), own.withColumn("text", F.when(is_last, F.col("reply")).otherwise(F.col("text"))).drop("at", "reply")
