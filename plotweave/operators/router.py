"""Questions to query types and answer modes, for a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.text import BEGINS, ENDS, has_any

#: Keywords of the router (fixed values); they match anywhere, also within words.
EVIDENCE = ("evidence", "supporting scene", "supporting scenes", "supporting evidence", "what supports", "show supporting", "show proof", "cite", "cites", "proof", "which scene", "which scenes")
COMPARISON = ("compare", "comparison", "versus", "vs ", "vs.", "baseline", "rag", "not just rag", "why is this not just rag")
STATE_CHANGE = ("relationship", "change over time", "changes over time", "how does", "trust", "fear", "distance", "loyalty", "respect", "resentment", "state change", "trajectory")
TIMELINE = ("timeline", "over time", "in order", "sequence", "before", "after", "when does", "when did", "what happens first", "what happens next")
CAUSAL = ("lead up", "leads up", "leads to", "what events lead", "contributes to", "contribute to", "cause", "caused", "why did", "what makes", "because")
MODES = ("auto", "kg", "ntg", "hybrid", "baseline_rag", "baseline")


def query_type(question: Column) -> Column:
    q = F.lower(F.trim(question))
    evidence = has_any(q, EVIDENCE) | (q.startswith("show ") & q.contains("scene"))
    named = has_any(q, ("relationship with", "relationship between", "relationship change", "state change"))
    over_time = q.contains("how does") & q.contains("change over time")
    drifting = has_any(q, STATE_CHANGE) & has_any(q, ("how does", "over time", "trajectory"))
    timed = has_any(q, TIMELINE) | q.rlike(f"{BEGINS}when{ENDS}") | has_any(q, ("sequence", "in order", "chronolog", "timeline"))
    return F.when(has_any(q, COMPARISON), "comparison").when(evidence, "evidence").when(named | over_time | drifting, "state_change").when(has_any(q, CAUSAL), "causal_chain").when(timed, "timeline").otherwise("fact")


def signals(question: Column) -> Column:
    """Struct of what was noticed in a question."""
    q = F.lower(F.trim(question))
    words = [q.rlike(f"{BEGINS}{w}{ENDS}").alias(f"has_{w}") for w in ("who", "what", "when", "why", "how")]
    lists = [has_any(q, keys).alias(f"mentions_{name}") for name, keys in (("evidence", EVIDENCE), ("compare", COMPARISON), ("state_change", STATE_CHANGE), ("timeline", TIMELINE), ("cause", CAUSAL))]
    return F.struct(*words, *lists, q.contains("rag").alias("mentions_rag"), has_any(q, ("relationship", "connected to", "connected with")).alias("mentions_relationship"), has_any(q, ("sequence", "in order", "chronolog", "timeline")).alias("mentions_sequence"))


def preferred(mode: Column) -> Column:
    m = F.lower(F.trim(mode))
    return F.when(m.isin(*MODES), m).otherwise("auto")


def mode_used(kind: Column, wanted: Column) -> Column:
    m = preferred(wanted)
    own = F.when(kind == "fact", "kg").when(kind.isin("timeline", "state_change"), "ntg").otherwise("hybrid")
    return F.when(m == "baseline", "baseline_rag").when(m != "auto", m).otherwise(own)


def routed(questions: DataFrame, *, question: str = "question", wanted: str | None = None) -> DataFrame:
    """The questions with query_type and mode_used."""
    kind = query_type(F.col(question))
    return questions.withColumns({"query_type": kind, "mode_used": mode_used(kind, F.lit("auto") if wanted is None else F.col(wanted))})


def normalized_request(body: dict) -> dict:
    """A request with its defaults; keys in snake or camel case. An empty question raises."""

    def first(*names, default=None):
        return next((body[n] for n in names if body.get(n) is not None), default)

    question = first("question")
    if not isinstance(question, str) or not question.strip():
        raise ValueError("question is required")
    mode = str(first("preferred_mode", "preferredMode", default="auto")).strip().lower()
    flag = lambda value, default: value if isinstance(value, bool) else default
    return {
        "question": question.strip(),
        "preferred_mode": mode if mode in MODES else "auto",
        "include_evidence": flag(first("include_evidence", "includeEvidence"), True),
        "include_baseline_comparison": flag(first("include_baseline_comparison", "includeBaselineComparison"), False),
    }


#: The keys of a request, in snake and camel case.
REQUEST = "question string, preferred_mode string, preferredMode string, include_evidence boolean, includeEvidence boolean, include_baseline_comparison boolean, includeBaselineComparison boolean"


def normalized_requests(bodies: DataFrame, *, body: str = "body") -> DataFrame:
    """Requests as rows with their defaults, of JSON bodies; `refused` where the question is missing or the body is no JSON object."""
    r = F.from_json(F.col(body), REQUEST, {"mode": "PERMISSIVE"})
    told = bodies.withColumn("_r", r)
    question = F.trim(F.coalesce("_r.question", F.lit("")))
    return told.select(
        *bodies.columns,
        question.alias("question"),
        preferred(F.coalesce("_r.preferred_mode", "_r.preferredMode", F.lit("auto"))).alias("preferred_mode"),
        F.coalesce("_r.include_evidence", "_r.includeEvidence", F.lit(True)).alias("include_evidence"),
        F.coalesce("_r.include_baseline_comparison", "_r.includeBaselineComparison", F.lit(False)).alias("include_baseline_comparison"),
        (question == "").alias("refused"),
    )
