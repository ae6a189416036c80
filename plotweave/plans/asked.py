"""Questions by the table: asked of the entities, events and conversations of the test tables, each set as large as its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators import adjacency, batch_answers, retrieval, router, states, substrings
from plotweave.operators.answers import Narrative
from plotweave.plans import tables as D
from plotweave.plans.catalog import CHANGES, EDGES, ENTITIES, changes, query, trace_tables
from plotweave.sources.staging import staged

# The story: users by the last digit of their numbers as people, days as scenes, turns as script blocks.


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = D.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("d")).distinct()
    return digits.select(F.concat(F.lit("u"), "d").alias("entity_id"), F.lit("character").alias("entity_type"), F.concat(F.lit("User "), "d").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))


class Story(Narrative):
    """A narrative whose tables are made, once, when they are first asked for."""

    def __init__(self, **tables: Callable[[], DataFrame | None]):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame | None:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        setattr(self, name, self._tables[name]())
        return getattr(self, name)


def narrative(spark: SparkSession, sf_dir: str) -> Narrative:
    """Entities, days and state changes are written down, since answers ask for them again and again."""
    edges = D.edges(spark, sf_dir).withColumns({"stability": F.lit("stable"), "evidence_refs": F.array(F.concat(F.lit("edge:"), "edge_id"))})
    found, days = trace_tables(spark, sf_dir)
    digit = F.substring_index(F.col("participants")[0]["entity_id"], "_", -1).cast("long") % 10
    who = lambda d: F.struct(F.concat(F.lit("u"), d).alias("entity_id"), F.lit("actor").alias("role"))
    found = found.withColumns({"participants": F.array(who(digit), who((digit + 1) % 10)), "evidence_refs": F.array(F.concat(F.lit("evref_"), "event_id")), "confidence": F.lit(0.5)})
    told = lambda: states.numbered_changes(changes(spark, sf_dir)).withColumn("trigger_event_ids", F.col("trigger_event_ids").cast("array<string>"))
    turns = D.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("block_id"), F.col("conv_id").cast("string").alias("scene_id"), F.lit("utterance").alias("block_type"), F.col("turn").cast("int").alias("sequence_in_scene"), F.upper("role").alias("speaker_cue_raw"), "text")
    none = spark.createDataFrame([], "entity_id string, alias_raw string, alias_normalized string, source string")
    entities = lambda: staged(D.entities(spark, sf_dir).unionByName(persons(spark, sf_dir)), "entities")
    return Story(entities=entities, aliases=lambda: none, edges=lambda: edges, events=lambda: found, scenes=lambda: staged(days, "days"), changes=lambda: staged(told(), "changes"), temporal=lambda: None, blocks=lambda: turns)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, preferred_mode, include_evidence, include_baseline of all sets."""
    t = lambda name: D.table(spark, sf_dir, name)
    said = lambda df, id_, text, mode="auto": df.select(id_.alias("question_id"), text.alias("question"), F.lit(mode).alias("preferred_mode"), F.lit(True).alias("include_evidence"), F.lit(False).alias("include_baseline"))
    user = t("events").select((F.col("user_id") % 10).alias("d"), F.year("ts").alias("y"))
    digits, years = user.select("d").distinct(), user.distinct()
    at = lambda p, *c: F.concat_ws("-", F.lit(p), *c)
    parts = [
        said(t("customer"), at("c", "c_custkey"), F.concat(F.lit("Who is "), "c_name", F.lit(" connected to?"))),
        said(t("nation"), at("n", "n_nationkey"), F.concat(F.lit("What is "), "n_name", F.lit(" tied to?"))),
        said(digits, at("s", "d"), F.concat(F.lit("How does User "), "d", F.lit("'s relationship with User "), (F.col("d") + 1) % 10, F.lit(" change over time?"))),
        said(years, at("t", "d", "y"), F.concat(F.lit("When does User "), "d", F.lit(" act in "), "y", F.lit("?"))),
        said(digits, at("p", "d"), F.concat(F.lit("Show proof for User "), "d")),
        said(digits, at("h", "d"), F.concat(F.lit("Why did User "), "d", F.lit(" stop?"))),
        said(t("events").select("event_type").distinct(), at("e", "event_type"), F.col("event_type"), "ntg"),
        said(t("benchmark"), at("b", "item_id"), F.col("text"), "baseline"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ASKED = """
qs AS (SELECT 'c-' || c_custkey AS question_id, 'Who is ' || c_name || ' connected to?' AS question, 'auto' AS preferred_mode FROM customer UNION ALL SELECT 'n-' || n_nationkey, 'What is ' || n_name || ' tied to?', 'auto' FROM nation
UNION ALL SELECT DISTINCT 's-' || (user_id % 10), 'How does User ' || (user_id % 10) || '''s relationship with User ' || ((user_id % 10 + 1) % 10) || ' change over time?', 'auto' FROM events
UNION ALL SELECT DISTINCT 't-' || (user_id % 10) || '-' || year(ts), 'When does User ' || (user_id % 10) || ' act in ' || year(ts) || '?', 'auto' FROM events
UNION ALL SELECT DISTINCT 'p-' || (user_id % 10), 'Show proof for User ' || (user_id % 10), 'auto' FROM events UNION ALL SELECT DISTINCT 'h-' || (user_id % 10), 'Why did User ' || (user_id % 10) || ' stop?', 'auto' FROM events
UNION ALL SELECT DISTINCT 'e-' || event_type, event_type, 'ntg' FROM events UNION ALL SELECT 'b-' || item_id, text, 'baseline' FROM benchmark)
"""


def _any(words) -> str:
    return "(" + " OR ".join("contains(q, '{}')".format(w.replace("'", "''")) for w in words) + ")"


ROUTED = ASKED + f""",
low AS (SELECT *, lower(trim(question)) AS q FROM qs),
typed AS (SELECT *, CASE WHEN {_any(router.COMPARISON)} THEN 'comparison' WHEN {_any(router.EVIDENCE)} OR starts_with(q, 'show ') AND contains(q, 'scene') THEN 'evidence'
WHEN contains(q, 'relationship with') OR contains(q, 'relationship between') OR contains(q, 'relationship change') OR contains(q, 'state change') OR contains(q, 'how does') AND contains(q, 'change over time')
 OR {_any(router.STATE_CHANGE)} AND (contains(q, 'how does') OR contains(q, 'over time') OR contains(q, 'trajectory')) THEN 'state_change'
WHEN {_any(router.CAUSAL)} THEN 'causal_chain' WHEN {_any(router.TIMELINE)} OR regexp_matches(q, '\\bwhen\\b') OR contains(q, 'chronolog') THEN 'timeline' ELSE 'fact' END AS query_type FROM low),
routed AS (SELECT *, CASE WHEN preferred_mode = 'baseline' THEN 'baseline_rag' WHEN preferred_mode <> 'auto' THEN preferred_mode WHEN query_type = 'fact' THEN 'kg' WHEN query_type IN ('timeline', 'state_change') THEN 'ntg' ELSE 'hybrid' END AS mode_used FROM typed)
"""


@query(f"WITH {ROUTED} SELECT question_id, query_type, mode_used FROM routed")
def questions_routed(spark, sf_dir):
    """All sets of questions with their kinds and modes."""
    return router.routed(questions(spark, sf_dir), wanted="preferred_mode").select("question_id", "query_type", "mode_used")


@query(f"WITH {ROUTED} SELECT question_id, regexp_matches(q, '\\bwho\\b') AS has_who, regexp_matches(q, '\\bwhen\\b') AS has_when, regexp_matches(q, '\\bwhy\\b') AS has_why, {_any(router.EVIDENCE)} AS mentions_evidence, {_any(router.CAUSAL)} AS mentions_cause, contains(q, 'relationship') OR contains(q, 'connected to') OR contains(q, 'connected with') AS mentions_relationship FROM routed")
def questions_signals(spark, sf_dir):
    told = questions(spark, sf_dir).select("question_id", router.signals(F.col("question")).alias("s"))
    return told.select("question_id", *(f"s.{c}" for c in ("has_who", "has_when", "has_why", "mentions_evidence", "mentions_cause", "mentions_relationship")))


#: Entities named in questions: words of the questions' own make need no search over the lexicon in SQL.
NAMED = ROUTED + f""",
names AS (SELECT entity_id, canonical_name, lower(canonical_name) AS phrase FROM ({ENTITIES}) WHERE length(canonical_name) >= 3 UNION ALL SELECT DISTINCT 'u' || (user_id % 10), 'User ' || (user_id % 10), 'user ' || (user_id % 10) FROM events),
words AS (SELECT question_id, string_split_regex(q, '[^a-z0-9#_]+') AS w, q FROM routed),
pieces AS (SELECT DISTINCT question_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS piece FROM words),
spotted AS (SELECT p.question_id, n.entity_id, n.canonical_name, strpos(q, phrase) - 1 AS start FROM pieces p JOIN names n ON n.phrase = p.piece JOIN words w ON w.question_id = p.question_id),
people AS (SELECT question_id, list(entity_id ORDER BY start) AS ids, list(canonical_name ORDER BY start) AS names FROM spotted GROUP BY 1)
"""


@query(f"WITH {NAMED} SELECT r.question_id, query_type, mode_used, coalesce(array_to_string(ids, ','), '') AS ids, CASE WHEN len(ids) >= 2 THEN least(ids[1], ids[2]) || '::' || greatest(ids[1], ids[2]) END AS pair, TRY_CAST(nullif(regexp_extract(question, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), '') AS INT) AS year FROM routed r LEFT JOIN people USING (question_id) WHERE r.question_id NOT LIKE 'b-%'")
def question_contexts(spark, sf_dir):
    """Kinds, modes, entities, pairs and years of questions; those of the benchmark have names by chance only and are told by `questions_routed`."""
    asked = questions(spark, sf_dir).where("not startswith(question_id, 'b-')")
    found = batch_answers.contexts(asked, narrative(spark, sf_dir))
    return found.select("question_id", "query_type", "mode_used", F.array_join("ids", ",").alias("ids"), "pair", "year")


def answered(spark: SparkSession, sf_dir: str, *sets: str) -> DataFrame:
    asked = questions(spark, sf_dir).where(F.substring_index("question_id", "-", 1).isin(*sets))
    found = batch_answers.answers(asked, narrative(spark, sf_dir))
    joined = {c: F.array_join(c, ",").alias(c) for c in batch_answers.LISTS}
    return found.select("question_id", "query_type", "mode_used", "answer_text", F.round("confidence", 6).alias("confidence"), *joined.values())


@query(f"""WITH {NAMED},
f AS (SELECT question_id, query_type, mode_used, ids[1] AS focus, names[1] AS name FROM routed JOIN people USING (question_id) WHERE question_id[1] IN ('c', 'n')),
ed AS ({EDGES}), en AS ({ENTITIES}),
ends AS (SELECT subject_id AS focus, 'out' AS way, object_id AS other, object_id, predicate, edge_id FROM ed UNION ALL SELECT object_id, 'in', subject_id, object_id, predicate, edge_id FROM ed WHERE subject_id <> object_id),
placed AS (SELECT ends.*, canonical_name, entity_type, row_number() OVER (PARTITION BY focus ORDER BY coalesce(canonical_name, edge_id), edge_id) AS k, count(*) OVER (PARTITION BY focus) AS total FROM ends LEFT JOIN en ON other = entity_id WHERE focus IN (SELECT focus FROM f)),
top AS (SELECT *, count(*) FILTER (entity_type = 'character') OVER (PARTITION BY focus) AS persons FROM placed WHERE k <= 8),
kept AS (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY k) AS pos FROM top WHERE persons < 3 OR entity_type = 'character'),
seen AS (SELECT focus, any_value(total) AS total, count(*) AS n, string_agg(chr(10) || pos || '. [' || way || '] ' || predicate || ' -> ' || coalesce(canonical_name || ' (' || entity_type || ')', object_id) || ' [stable], evidence refs: 1', '' ORDER BY pos) AS lines, string_agg(CASE WHEN canonical_name IS NOT NULL THEN other END, ',' ORDER BY pos) AS others, string_agg('edge:' || edge_id, ',' ORDER BY pos) AS refs FROM kept WHERE persons < 3 OR pos <= 6 GROUP BY focus)
SELECT question_id, query_type, mode_used, 'KG view of ' || name || ': ' || coalesce(n, 0) || ' high-signal relationship(s) from the local graph artifact.' || coalesce(lines, '') || CASE WHEN total > n THEN chr(10) || 'Additional relationships omitted for brevity: ' || (total - n) || '.' ELSE '' END AS answer_text,
 round(least(0.95, 0.55 + 0.05 * coalesce(n, 0)), 6) AS confidence, f.focus || coalesce(',' || others, '') AS entities_used, '' AS events_used, '' AS state_changes_used, coalesce(refs, '') AS evidence_refs FROM f LEFT JOIN seen ON f.focus = seen.focus""")
def answers_of_graph(spark, sf_dir):
    """Facts about every customer and nation, from the graph."""
    return answered(spark, sf_dir, "c", "n")


SHOWN = "CASE WHEN len(names) = 0 THEN 'no matched entities' ELSE array_to_string(names, ', ') END"


@query(CHANGES + f""", {NAMED},
k AS (SELECT printf('sc_%06d', row_number() OVER (ORDER BY position, scene_id, s, o, dim, dir, claim)) AS id, * FROM sc),
asked AS (SELECT question_id, query_type, mode_used, ids, names, least(ids[1], ids[2]) || '::' || greatest(ids[1], ids[2]) AS pair FROM routed JOIN people USING (question_id) WHERE question_id[1] = 's'),
ranked_changes AS (SELECT *, least(s, o) || '::' || greatest(s, o) AS pair, row_number() OVER (PARTITION BY least(s, o), greatest(s, o) ORDER BY id) AS pos, count(*) OVER (PARTITION BY least(s, o), greatest(s, o)) AS total FROM k),
seq AS (SELECT event_id, row_number() OVER (PARTITION BY scene_id ORDER BY ts, event_id) AS n FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS scene_id FROM events)),
led AS (SELECT id, i, e.event_id, e.event_type || ' (' || e.scene_id || '/' || n || ')' AS shown FROM (SELECT id, unnest(string_split(trigger_event_ids, ',')) AS x, unnest(range(1, len(string_split(trigger_event_ids, ',')) + 1)) AS i FROM ranked_changes WHERE pos <= 8) JOIN e ON e.event_id::VARCHAR = x JOIN seq ON seq.event_id = e.event_id),
per AS (SELECT id, string_agg(shown, '; ' ORDER BY i) FILTER (i <= 2) AS trigger, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS evs, string_agg('ref' || event_id, ',' ORDER BY i) AS refs FROM led GROUP BY id),
lines AS (SELECT c.*, evs, refs, '- User ' || s[2:] || ' -> User ' || o[2:] || ': ' || dim || ' ' || dir || CASE WHEN magnitude IS NULL THEN '' ELSE ' (' || magnitude || ')' END || ' [' || claim || '] in DAY ' || scene_id || ' (conf ' || printf('%.2f', confidence) || '). Triggers: ' || trigger || '.' AS line FROM ranked_changes c JOIN per USING (id) WHERE pos <= 8),
views AS (SELECT pair, count(*) AS n, any_value(total) AS total, string_agg(chr(10) || line, '' ORDER BY pos) AS text, array_to_string(list_distinct(list(s || ',' || o)), ',') AS both, string_agg(evs, ',' ORDER BY pos) AS evs, string_agg(id, ',' ORDER BY pos) AS scs, string_agg(refs, ',' ORDER BY pos) AS refs FROM lines GROUP BY pair)
SELECT question_id, query_type, mode_used, CASE WHEN n IS NULL THEN '{batch_answers.NO_CHANGE_TEXT}' ELSE 'NTG state-change view (' || n || ' of ' || total || ' matching changes) for ' || {SHOWN} || '.' || text || CASE WHEN total > n THEN chr(10) || 'Additional matching state changes omitted: ' || (total - n) || '.' ELSE '' END END AS answer_text,
 round(CASE WHEN n IS NULL THEN 0.25 ELSE least(0.92, 0.58 + n * 0.04) END, 6) AS confidence, array_to_string(ids, ',') AS entities_used,
 coalesce((SELECT string_agg(x, ',' ORDER BY pos) FROM (SELECT x, min(pos) AS pos FROM (SELECT unnest(string_split(evs, ',')) AS x, unnest(range(1, len(string_split(evs, ',')) + 1)) AS pos) GROUP BY x)), '') AS events_used, coalesce(scs, '') AS state_changes_used,
 coalesce((SELECT string_agg(x, ',' ORDER BY pos) FROM (SELECT x, min(pos) AS pos FROM (SELECT unnest(string_split(refs, ',')) AS x, unnest(range(1, len(string_split(refs, ',')) + 1)) AS pos) GROUP BY x)), '') AS evidence_refs FROM asked LEFT JOIN views ON asked.pair = views.pair""")
def answers_of_changes(spark, sf_dir):
    """How each two users' relationship changes, from the state changes and what led to them."""
    return answered(spark, sf_dir, "s")


TRACED = f""", {NAMED},
kk AS (SELECT printf('sc_%06d', row_number() OVER (ORDER BY position, scene_id, s, o, dim, dir, claim)) AS id, * FROM sc),
ev AS (SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS scene_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS seq, event_type AS kind, event_type || ' ' || props AS summary, props, 'u' || (user_id % 10) AS a, 'u' || ((user_id % 10 + 1) % 10) AS b FROM events),
trig AS (SELECT x AS event_id, list_sort(list(DISTINCT id)) AS scs FROM (SELECT id, unnest(string_split(trigger_event_ids, ',')) AS x FROM kk) GROUP BY x),
"""


@query(CHANGES + TRACED + f"""
asked AS (SELECT question_id, query_type, mode_used, ids, names, ids[1] AS me, regexp_extract(question, '\\b(20\\d{{2}})\\b', 1) AS y FROM routed JOIN people USING (question_id) WHERE question_id[1] = 't'),
hit AS (SELECT question_id, ev.*, row_number() OVER (PARTITION BY question_id ORDER BY scene_id, seq, ev.event_id) AS pos FROM asked JOIN ev ON (a = me OR b = me) AND scene_id[1:4] = y),
listed AS (SELECT hit.*, coalesce(scs, []) AS scs FROM hit LEFT JOIN trig USING (event_id) WHERE pos <= 40),
top AS (SELECT question_id, count(*) AS n, flatten(list([a, b] ORDER BY pos)) AS who, string_agg(event_id, ',' ORDER BY pos) AS evs, flatten(list(scs ORDER BY pos)) AS sc_ids, string_agg('evref_' || event_id, ',' ORDER BY pos) AS refs FROM listed WHERE pos <= 8 GROUP BY 1),
per_scene AS (SELECT question_id, scene_id, count(*) AS n FROM hit GROUP BY 1, 2),
per_change AS (SELECT question_id, scene_id, count(*) AS c FROM asked JOIN kk ON (s = me OR o = me) AND scene_id[1:4] = y GROUP BY 1, 2),
scene_rows AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY scene_id) AS k FROM (SELECT coalesce(p.question_id, c.question_id) AS question_id, coalesce(p.scene_id, c.scene_id) AS scene_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM per_scene p FULL JOIN per_change c ON p.question_id = c.question_id AND p.scene_id = c.scene_id)),
inner_rows AS (SELECT r.question_id, k, string_agg(chr(10) || '   - ' || ev.event_id || ' ' || kind || ' (#' || ev.seq || CASE WHEN len(coalesce(l.scs, [])) > 0 THEN ', state overlays=' || len(l.scs) ELSE '' END || '): ' || CASE WHEN length(ev.summary) <= 160 THEN ev.summary ELSE rtrim(ev.summary[1:157]) || '...' END, '' ORDER BY ev.seq) AS t
  FROM scene_rows r JOIN ev ON ev.scene_id = r.scene_id AND ev.seq <= 3 LEFT JOIN (SELECT question_id, event_id, scs FROM listed) l ON l.question_id = r.question_id AND l.event_id = ev.event_id WHERE k <= 6 GROUP BY 1, 2),
views AS (SELECT r.question_id, string_agg(chr(10) || r.k || '. ' || scene_id || ' [' || scene_id[1:4] || '] DAY ' || scene_id || ' matched events=' || n || ', state changes=' || c || coalesce(t, ''), '' ORDER BY r.k) AS text FROM scene_rows r LEFT JOIN inner_rows i ON i.question_id = r.question_id AND i.k = r.k WHERE r.k <= 6 GROUP BY 1)
SELECT a.question_id, query_type, mode_used, 'Scene-ordered NTG timeline slice for ' || {SHOWN} || ':' || text AS answer_text, round(least(0.88, 0.5 + least(n, 10) * 0.03), 6) AS confidence,
 (SELECT string_agg(x, ',' ORDER BY pos) FROM (SELECT x, min(pos) AS pos FROM (SELECT unnest(list_concat(ids, who)) AS x, unnest(range(1, len(list_concat(ids, who)) + 1)) AS pos) GROUP BY x)) AS entities_used, evs AS events_used,
 coalesce((SELECT string_agg(x, ',' ORDER BY pos) FROM (SELECT x, min(pos) AS pos FROM (SELECT unnest(sc_ids) AS x, unnest(range(1, len(sc_ids) + 1)) AS pos) GROUP BY x)), '') AS state_changes_used, refs AS evidence_refs FROM asked a JOIN views USING (question_id) JOIN top USING (question_id)""")
def answers_of_timelines(spark, sf_dir):
    """What each user does in each year, scene by scene."""
    return answered(spark, sf_dir, "t")


TOKEN_LIST = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"


@query(CHANGES + TRACED + f"""
asked AS (SELECT 'b-' || item_id AS question_id, text AS question, lower(trim(text)) AS q, list_distinct({TOKEN_LIST.format("text")}) AS w FROM benchmark WHERE text IS NOT NULL),
docs AS (SELECT 'event' AS source, event_id AS id, scene_id, kind || ' ' || trim(summary || chr(10) || props) AS said FROM ev UNION ALL SELECT 'state_change', id, scene_id, dim || ' ' || dir || ' ' || claim || ' ' || array_to_string(string_split(rule_ids, ','), ' ') FROM kk
UNION ALL SELECT 'script_block', conv_id || ':' || turn, conv_id::VARCHAR, 'utterance ' || text FROM conversations),
dt AS (SELECT source, id, scene_id, w, count(*) AS k FROM (SELECT source, id, scene_id, unnest({TOKEN_LIST.format("said")}) AS w FROM docs) GROUP BY ALL),
met AS (SELECT question_id, q, source, id, scene_id, sum(k)::BIGINT AS k FROM (SELECT question_id, q, unnest(w) AS w FROM asked) JOIN dt USING (w) GROUP BY ALL),
scored AS (SELECT met.*, k + CASE WHEN contains(lower(said), q) THEN 2 ELSE 0 END AS score FROM met JOIN docs USING (source, id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, scene_id, id, source) AS place FROM scored)
SELECT question_id, source || ':' || id AS piece, score::INT AS score, place::INT AS place FROM best WHERE place <= 6""")
def retrieval_of_benchmark(spark, sf_dir):
    """For every test item the six events, changes and turns that share most words with it."""
    found = batch_answers.pieces(narrative(spark, sf_dir))
    asked = D.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b-"), "item_id").alias("question_id"), F.col("text").alias("question"))
    return retrieval.best_matches(asked, found, question_key="question_id", question="question", key="piece", text="scored_text", order=("scene_order", "id"), pass_words=retrieval.PASS_WORDS)


@query(None)
def answers_to_all(spark, sf_dir):
    """Every question of all sets, whole: tests/test_batch_answers.py holds the operator against a plain evaluation of each question."""
    return answered(spark, sf_dir, "c", "n", "s", "t", "p", "h", "e", "b")


@query("""WITH n AS (SELECT s_suppkey AS needle_id, lower(right(s_name, 5)) AS needle FROM supplier UNION ALL SELECT 1000000 + n_nationkey, lower(left(n_name, 2)) FROM nation)
SELECT needle_id, p_partkey AS part FROM n JOIN part ON contains(lower(p_name || ' ' || p_type || ' #' || lpad(p_partkey::VARCHAR, 9, '0')), needle)""")
def substrings_of_parts(spark, sf_dir):
    """Which parts' descriptions contain the ends of suppliers' names, or the first two letters of a nation's: postings of grams, then a check."""
    named = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("needle_id"), F.right("s_name", F.lit(5)).alias("needle"))
    short = D.table(spark, sf_dir, "nation").select((1_000_000 + F.col("n_nationkey")).cast("long").alias("needle_id"), F.left("n_name", F.lit(2)).alias("needle"))
    parts = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" #"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("said"))
    return substrings.contained(named.unionByName(short), parts, needle_key="needle_id", needle="needle", key="part", text="said")


@query(f"""WITH ed AS ({EDGES}), ends AS (SELECT subject_id AS entity_id, 'outgoing' AS direction FROM ed UNION ALL SELECT object_id, 'incoming' FROM ed WHERE subject_id <> object_id)
SELECT entity_id, count(*) AS edges, count(*) FILTER (direction = 'outgoing') AS outgoing FROM ends GROUP BY entity_id""")
def adjacency_degrees(spark, sf_dir):
    """How many edges every entity has, from the table of edges by their ends."""
    return adjacency.degrees(adjacency.adjacency(D.edges(spark, sf_dir)))


@query(f"""WITH ed AS ({EDGES}), ends AS (SELECT subject_id AS entity_id, 'outgoing' AS direction, object_id AS neighbor_id, edge_id FROM ed UNION ALL SELECT object_id, 'incoming', subject_id, edge_id FROM ed WHERE subject_id <> object_id)
SELECT entity_id, direction, neighbor_id, edge_id FROM ends WHERE entity_id IN (SELECT 'nat_' || s_nationkey FROM supplier WHERE s_acctbal < 0 UNION SELECT 'char_' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def adjacency_lookup(spark, sf_dir):
    """The edges of all nations with a supplier in debt and of all customers of one segment, by the table of edges."""
    t = lambda name: D.table(spark, sf_dir, name)
    keys = t("supplier").where("s_acctbal < 0").select(F.concat(F.lit("nat_"), "s_nationkey").alias("entity_id")).unionByName(t("customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("char_"), "c_custkey").alias("entity_id")))
    return adjacency.neighbors_of(adjacency.adjacency(D.edges(spark, sf_dir)), keys).select("entity_id", "direction", "neighbor_id", "edge_id")
