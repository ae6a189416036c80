"""URL filters: rules on host and path, and trust that spreads over the link graph of hosts.

Rules decide first, the longest that fits. Where none does, the host decides: personalised PageRank
carries trust along links from hosts whose pages rules allow, and against them distrust from hosts
whose pages rules block, each host by the share of its pages; a host is blocked where distrust
outweighs trust and reaches the threshold. Links are summed to host edges before they are shuffled
for the walks, so a hot host is one row there. Only DataFrame functions are used.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is allowed;
null or empty html has no links; links to the own host do not count; a host without links keeps its
seeds' share only; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import ascii_lower, settle

#: verdict, host, path
Rule = tuple[str, str, str]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
#: Parts of a page in which no link counts.
NOT_PAGE = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b.*?(?:</\1\s*>|\z)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long rules the first holds."""
    rule = verdict = None
    for said, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame, *, host: str = "host", html: str = "html") -> DataFrame:
    """source, target, links: how many links pages of one host have to another host."""
    links = F.filter(F.regexp_extract_all(F.regexp_replace(html, NOT_PAGE, ""), F.lit(HREF), 1), lambda x: x.contains("://") | x.startswith("//"))
    targets = pages.select(F.col(host).alias("source"), F.explode(links).alias("to"))
    named = targets.select("source", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))).alias("target"))
    return named.where("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(F.count("*").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, close: float = 1e-4) -> DataFrame:
    """host, trust, distrust, a lone seed having 1: walks over the edges from seeds (host, trusted, blocked).

    What a round moves is damped by the next, so the walk ends: when no host moves by `close` or more.
    """
    out_links = edges.groupBy("source").agg(F.sum("links").alias("all_out"))
    in_links = edges.groupBy("target").agg(F.sum("links").alias("all_in"))
    steps = edges.join(out_links, "source").join(in_links, "target").select("source", "target", (F.col("links") / F.col("all_out")).alias("forth"), (F.col("links") / F.col("all_in")).alias("back"))
    steps = settle(steps, "host-steps")
    hosts = seeds.select("host").union(edges.select("source")).union(edges.select("target")).distinct()
    start = hosts.join(seeds, "host", "left").select("host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked"))
    state = settle(start.select("*", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")), "host-ranks")
    if steps.isEmpty():
        return state.select("host", "trust", "distrust")
    while True:
        gained = steps.join(state.select(F.col("host").alias("source"), "trust"), "source").groupBy(F.col("target").alias("host")).agg(F.sum(F.col("trust") * F.col("forth")).alias("more_trust"))
        lost = steps.join(state.select(F.col("host").alias("target"), "distrust"), "target").groupBy(F.col("source").alias("host")).agg(F.sum(F.col("distrust") * F.col("back")).alias("more_distrust"))
        # The seed's own share stays 1 at the start of a walk; what links bring comes damped on top.
        new = state.join(gained, "host", "left").join(lost, "host", "left").select(
            "host", "trusted", "blocked",
            (F.col("trusted") + damping * F.coalesce("more_trust", F.lit(0.0))).alias("trust"),
            (F.col("blocked") + damping * F.coalesce("more_distrust", F.lit(0.0))).alias("distrust"),
            F.greatest(F.abs(F.col("trusted") + damping * F.coalesce("more_trust", F.lit(0.0)) - F.col("trust")), F.abs(F.col("blocked") + damping * F.coalesce("more_distrust", F.lit(0.0)) - F.col("distrust"))).alias("moved"),
        )
        state = settle(new, "host-ranks")
        if (state.agg(F.max("moved")).first()[0] or 0.0) < close:
            return state.select("host", "trust", "distrust")
        state = state.drop("moved")


def judge(pages: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, **named) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parted = pages.select(F.col(page_id), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parted.select(page_id, "host", "path", rule.alias("rule"), said.alias("said"))
    share = lambda what: F.avg(F.when(F.col("said") == what, 1.0).otherwise(0.0))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    ranks = spread(host_edges(parted), seeds, **named)
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    method = F.when(F.col("host") == "", F.lit("allow")).when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(ranks, "host", "left").select(page_id, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
