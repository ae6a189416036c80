"""Contracts of artifacts: what an artifact's rows must be like, declared once and checked in one pass.

A contract names fields with their kinds, whether they are required, what values and ranges they may
have, the key, the number of records, and values that must occur. All of it becomes one aggregate
over the rows (the key is one more, by key); JSON is read permissively, so that rows that are not
of the declared kinds are counted and named and do not end the read.

Defined cases: no rows break no rule but the number of records and what must occur; null is no
value, so ranges and allowed values do not speak of it; blank text is missing where a field is
required; NaN and infinite numbers break a `double` field; equal rows repeat their key; a null in
a key makes it a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Field:
    kind: str
    required: bool = True
    allowed: tuple = ()
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Contract:
    artifact: str
    fields: dict[str, Field]
    key: tuple[str, ...] = ()
    records: int | None = None
    least_records: int = 0
    #: Values that must occur, by field.
    covers: dict[str, tuple] = field(default_factory=dict)

    def schema(self) -> str:
        return ", ".join(f"`{name}` {f.kind}" for name, f in self.fields.items())


def read_json(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Rows of JSON lines by the contract's kinds, with CORRUPT: the line, where it is not of them."""
    schema = f"{contract.schema()}, {CORRUPT} string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def faults_of(contract: Contract, columns: list[str]) -> list[tuple[str, str, Column]]:
    """(rule, field, condition) of every rule that speaks of one row; the condition holds for rows that break it."""
    out = [("corrupt", CORRUPT, F.col(CORRUPT).isNotNull())] if CORRUPT in columns else []
    for name, f in contract.fields.items():
        if name not in columns:
            continue
        c, text = F.col(f"`{name}`"), f.kind == "string"
        if f.required:
            out.append(("required", name, c.isNull() | (F.trim(c) == "") if text else c.isNull()))
        if f.kind == "double":
            out.append(("finite", name, F.isnan(c) | (F.abs(c) == float("inf"))))
        if f.allowed:
            out.append(("allowed", name, ~c.isin(*f.allowed)))
        if f.least is not None:
            out.append(("least", name, c < f.least))
        if f.most is not None:
            out.append(("most", name, c > f.most))
    return [(rule, name, F.coalesce(test, F.lit(False))) for rule, name, test in out]


def checked(rows: DataFrame, contract: Contract) -> DataFrame:
    """artifact, rule, field, faults, ok: one row for each rule of the contract."""
    n = F.count("*")
    found = [(rule, name, F.count_if(test)) for rule, name, test in faults_of(contract, rows.columns)]
    found += [("present", name, F.lit(0 if name in rows.columns else 1)) for name in contract.fields]
    if contract.records is not None:
        found.append(("records", "", F.abs(n - contract.records)))
    found.append(("least_records", "", F.greatest(F.lit(contract.least_records) - n, F.lit(0))))
    for name, values in contract.covers.items():
        found += [("covers", f"{name}={v}", F.when(F.coalesce(F.max(F.col(f"`{name}`") == F.lit(v)), F.lit(False)), 0).otherwise(1)) for v in values]
    counts = rows.agg(*(c.cast("long").alias(f"_{k}") for k, (_, _, c) in enumerate(found)))
    told = counts.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("field"), F.col(f"_{k}").alias("faults")) for k, (rule, name, _) in enumerate(found)))))
    if contract.key:
        repeats = rows.groupBy(*(F.col(f"`{c}`") for c in contract.key)).agg((n - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("faults"))
        told = told.unionByName(repeats.select(F.lit("key").alias("rule"), F.lit(",".join(contract.key)).alias("field"), "faults"))
    return told.select(F.lit(contract.artifact).alias("artifact"), "rule", "field", "faults", (F.col("faults") == 0).alias("ok"))


def broken_rows(rows: DataFrame, contract: Contract) -> DataFrame:
    """The rows that break a rule, with `broken`: the rules as `rule:field`, in the contract's order."""
    rules = [F.when(test, F.lit(f"{rule}:{name}")) for rule, name, test in faults_of(contract, rows.columns)]
    return rows.withColumn("broken", F.array_compact(F.array(*rules))).where(F.size("broken") > 0)


#: Contracts of the artifacts of a story (fixed values: names, kinds and ranges that readers rely on).
SCORE = Field("double", least=0, most=1)
ARTIFACTS = {
    c.artifact: c
    for c in (
        Contract("entities", {"entity_id": Field("string"), "entity_type": Field("string", allowed=("character", "location", "organization", "group", "object")), "canonical_name": Field("string"), "aliases": Field("array<string>")}, key=("entity_id",), least_records=1),
        Contract("kg_edges", {"edge_id": Field("string"), "subject_id": Field("string"), "predicate": Field("string"), "object_id": Field("string"), "stability": Field("string"), "evidence_refs": Field("array<string>", required=False)}, key=("edge_id",), least_records=1),
        Contract("events", {"event_id": Field("string"), "scene_id": Field("string"), "event_type_l1": Field("string"), "event_type_l2": Field("string"), "summary": Field("string"), "sequence_in_scene": Field("int", least=1), "confidence": SCORE}, key=("event_id",), least_records=1),
        Contract("state_changes", {"state_change_id": Field("string"), "subject_id": Field("string"), "object_id": Field("string"), "state_dimension": Field("string"), "direction": Field("string"), "claim_type": Field("string", allowed=("explicit", "inferred")), "scene_id": Field("string"), "confidence": SCORE}, key=("state_change_id",), least_records=1),
        Contract("query_examples", {"query_id": Field("string"), "question": Field("string"), "query_type_expected": Field("string"), "mode_expected": Field("string", allowed=("kg", "ntg", "hybrid", "baseline_rag"))}, key=("query_id",), least_records=10, covers={"query_type_expected": ("fact", "timeline", "state_change", "causal_chain", "evidence", "comparison")}),
    )
}
