"""The tables as artifacts with contracts, each rule's faults counted in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import contracts as C
from plotweave.plans import tables as D
from plotweave.plans.asked import narrative
from plotweave.plans.catalog import query

TABLES = (
    C.Contract("orders", {"o_orderkey": C.Field("bigint"), "o_orderstatus": C.Field("string", allowed=("F", "O")), "o_totalprice": C.Field("double", least=1000, most=400_000), "o_clerk": C.Field("string")}, key=("o_orderkey",), least_records=1, covers={"o_orderstatus": ("F", "X")}),
    C.Contract("conversations", {"conv_id": C.Field("bigint"), "turn": C.Field("bigint", least=1), "role": C.Field("string", allowed=("user", "assistant")), "text": C.Field("string")}, key=("conv_id",), covers={"role": ("user", "assistant", "narrator")}),
    C.Contract("documents", {"doc_id": C.Field("bigint"), "text": C.Field("string"), "lang": C.Field("string", allowed=("en", "de", "fr")), "n_chars": C.Field("bigint", least=200, most=5_000)}, key=("doc_id",), records=1000),
)


def _sql(c: C.Contract) -> str:
    t, parts = c.artifact, []
    put = lambda rule, name, faults: parts.append(f"SELECT '{t}' AS artifact, '{rule}' AS rule, '{name}' AS field, ({faults})::BIGINT AS faults FROM {t}")
    missing = {"orders": ("o_clerk",)}.get(t, ())
    for name, f in c.fields.items():
        put("present", name, f"SELECT {int(name in missing)}")
        if name in missing:
            continue
        put("required", name, f"count(*) FILTER ({name} IS NULL" + (f" OR trim({name}) = '')" if f.kind == "string" else ")"))
        if f.kind == "double":
            put("finite", name, f"count(*) FILTER (isnan({name}) OR isinf({name}))")
        if f.allowed:
            put("allowed", name, f"count(*) FILTER ({name} NOT IN ({', '.join(map(repr, f.allowed))}))")
        if f.least is not None:
            put("least", name, f"count(*) FILTER ({name} < {f.least})")
        if f.most is not None:
            put("most", name, f"count(*) FILTER ({name} > {f.most})")
    if c.records is not None:
        put("records", "", f"abs(count(*) - {c.records})")
    put("least_records", "", f"greatest({c.least_records} - count(*), 0)")
    for name, values in c.covers.items():
        for v in values:
            put("covers", f"{name}={v}", f"CASE WHEN count(*) FILTER ({name} = '{v}') > 0 THEN 0 ELSE 1 END")
    put("key", ",".join(c.key), f"count(*) - count(DISTINCT {c.key[0]})")
    return " UNION ALL ".join(parts)


@query(f"SELECT *, faults = 0 AS ok FROM ({' UNION ALL '.join(map(_sql, TABLES))})".replace("(SELECT 0)::BIGINT AS faults FROM", "(0 * count(*))::BIGINT AS faults FROM").replace("(SELECT 1)::BIGINT AS faults FROM", "(1 + 0 * count(*))::BIGINT AS faults FROM"))
def contracts_of_tables(spark, sf_dir):
    """Every rule of three tables' contracts, some broken on purpose."""
    parts = [C.checked(D.table(spark, sf_dir, c.artifact), c) for c in TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH e AS (SELECT count(*) AS n FROM events) SELECT 'events' AS artifact, rule, field, 0::BIGINT AS faults, true AS ok FROM (VALUES ('required', 'event_id'), ('required', 'scene_id'), ('required', 'event_type_l1'), ('required', 'event_type_l2'), ('required', 'summary'), ('required', 'sequence_in_scene'), ('required', 'confidence'),
('least', 'sequence_in_scene'), ('finite', 'confidence'), ('least', 'confidence'), ('most', 'confidence'), ('present', 'event_id'), ('present', 'scene_id'), ('present', 'event_type_l1'), ('present', 'event_type_l2'), ('present', 'summary'), ('present', 'sequence_in_scene'), ('present', 'confidence'), ('least_records', ''), ('key', 'event_id')) t(rule, field), e WHERE n > 0""")
def contract_of_events(spark, sf_dir):
    """The events made of the events table keep the contract of that artifact."""
    return C.checked(narrative(spark, sf_dir).events, C.ARTIFACTS["events"])


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'required:text' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'allowed:lang' END, CASE WHEN n_chars < 200 THEN 'least:n_chars' END, CASE WHEN n_chars > 5000 THEN 'most:n_chars' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents WHERE text IS NULL OR trim(text) = '' OR lang NOT IN ('en', 'de', 'fr') OR n_chars < 200 OR n_chars > 5000")
def documents_against_contract(spark, sf_dir):
    """The documents that break a rule, with the rules they break."""
    return C.broken_rows(D.table(spark, sf_dir, "documents"), TABLES[2]).select("doc_id", F.array_join("broken", ",").alias("broken"))
