"""The query catalogue: every operator on the driver's tables, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.functions import text as T
from plotweave.operators import answers, batch_answers, cleaning, events, graph, quality, retrieval, router, rules, search, spans, states
from plotweave.plans import tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# SQL that several queries share.

SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
ENTITIES = f"""
SELECT 'reg_' || r_regionkey AS entity_id, 'location' AS entity_type, r_name AS canonical_name, {SLUG.format('r_name')} AS alias FROM region
UNION ALL SELECT 'nat_' || n_nationkey, 'location', n_name, {SLUG.format('n_name')} FROM nation
UNION ALL SELECT 'char_' || c_custkey, 'character', c_name, {SLUG.format('c_name')} FROM customer
UNION ALL SELECT 'org_' || s_suppkey, 'organization', s_name, {SLUG.format('s_name')} FROM supplier
UNION ALL SELECT 'obj_' || p_partkey, 'object', p_name, {SLUG.format('p_name')} FROM part
"""
EDGES = """
SELECT subject_id, predicate, object_id, subject_id || '|' || predicate || '|' || object_id AS edge_id FROM (
SELECT 'nat_' || n_nationkey AS subject_id, 'part_of' AS predicate, 'reg_' || n_regionkey AS object_id FROM nation
UNION ALL SELECT 'char_' || c_custkey, 'lives_in', 'nat_' || c_nationkey FROM customer
UNION ALL SELECT 'org_' || s_suppkey, 'based_in', 'nat_' || s_nationkey FROM supplier)
"""
DAY = "SELECT event_id, strftime(ts, '%Y-%m-%d') AS scene_id, ts, user_id, event_type AS label, value, props FROM events"
TURNS = "SELECT conv_id AS scene_id, turn AS sequence_in_scene, role AS speaker, text, conv_id || ':' || turn AS event_id FROM conversations"


# Entities and the knowledge graph.


@query(f"SELECT entity_id, entity_type, canonical_name, alias FROM ({ENTITIES})")
def entity_catalog(spark, sf_dir):
    return D.entities(spark, sf_dir).select("entity_id", "entity_type", "canonical_name", F.element_at("aliases", 1).alias("alias"))


@query(f"""
WITH hit AS (SELECT * FROM ({ENTITIES}) WHERE entity_type = 'character' AND (contains(lower(canonical_name), '00012') OR contains(lower(entity_id), '00012') OR contains(lower(alias), '00012')))
SELECT entity_id, canonical_name, (SELECT count(*) FROM hit)::BIGINT AS filtered, (row_number() OVER (ORDER BY entity_type, canonical_name, entity_id))::INT AS place FROM hit ORDER BY entity_type, canonical_name, entity_id LIMIT 50
""")
def entity_search(spark, sf_dir):
    return search.list_entities(D.entities(spark, sf_dir), q="00012", entity_type="character", limit=50).select("entity_id", "canonical_name", "filtered", "place")


@query(f"SELECT entity_type, count(*) AS n FROM ({ENTITIES}) GROUP BY 1")
def entity_type_counts(spark, sf_dir):
    return D.entities(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(EDGES)
def kg_edges(spark, sf_dir):
    return D.edges(spark, sf_dir)


@query(f"SELECT predicate, count(*) AS n FROM ({EDGES}) GROUP BY 1")
def kg_predicate_counts(spark, sf_dir):
    return graph.predicate_counts(D.edges(spark, sf_dir))


@query(f"""
WITH e AS ({EDGES}), n AS ({ENTITIES}), near AS (
SELECT edge_id, predicate, 'outgoing' AS direction, object_id AS neighbor_id FROM e WHERE subject_id = 'nat_3'
UNION ALL SELECT edge_id, predicate, 'incoming', subject_id FROM e WHERE object_id = 'nat_3' AND subject_id <> 'nat_3')
SELECT neighbor_id, edge_id, predicate, direction, canonical_name AS neighbor_name, entity_type AS neighbor_type FROM near LEFT JOIN n ON neighbor_id = entity_id
""")
def kg_neighbors(spark, sf_dir):
    return graph.neighbors(D.edges(spark, sf_dir), D.entities(spark, sf_dir), "nat_3")


@query(f"""
WITH e AS ({EDGES}), n AS ({ENTITIES}), near AS (
SELECT edge_id, predicate, 'outgoing' AS direction, object_id AS neighbor_id FROM e WHERE subject_id = 'nat_3'
UNION ALL SELECT edge_id, predicate, 'incoming', subject_id FROM e WHERE object_id = 'nat_3' AND subject_id <> 'nat_3'),
top AS (SELECT *, 60 AS weight FROM near LEFT JOIN n ON neighbor_id = entity_id ORDER BY coalesce(canonical_name, edge_id), edge_id LIMIT 8),
c AS (SELECT *, count(*) FILTER (entity_type = 'character') OVER () AS people FROM top),
p AS (SELECT *, row_number() OVER (ORDER BY weight DESC, coalesce(canonical_name, edge_id), edge_id) AS place FROM c WHERE people < 3 OR entity_type = 'character')
SELECT neighbor_id, edge_id, predicate, direction, canonical_name AS neighbor_name, entity_type AS neighbor_type, weight, place::INT AS place FROM p WHERE people < 3 OR place <= 6
""")
def kg_ranked_neighbors(spark, sf_dir):
    return graph.ranked_neighbors(graph.neighbors(D.edges(spark, sf_dir), D.entities(spark, sf_dir), "nat_3"))


def order_suppliers(spark, sf_dir):
    return D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_suppkey").alias("entity_id")).distinct()


PAIRS = """
WITH r AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS e FROM lineitem),
p AS (SELECT a.e AS subject_id, b.e AS object_id, count(*) AS n FROM r a JOIN r b ON a.s = b.s AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 3)
"""


@query(PAIRS + "SELECT subject_id, object_id, n FROM p ORDER BY n DESC, subject_id, object_id LIMIT 120")
def pair_cooccurrence(spark, sf_dir):
    """Suppliers by the number of orders they share, the 120 strongest pairs of three orders or more."""
    pairs = graph.pair_counts(order_suppliers(spark, sf_dir), scene="scene_id", entity="entity_id").where(F.col("n") >= graph.MIN_SCENES)
    return pairs.orderBy(F.desc("n"), "subject_id", "object_id").limit(graph.MAX_EDGES)


@query(PAIRS + """, l AS (SELECT subject_id || '::' || object_id AS pair, n, a.s_name || ' <> ' || b.s_name AS label FROM p JOIN supplier a ON a.s_suppkey = subject_id JOIN supplier b ON b.s_suppkey = object_id)
SELECT pair, n, label FROM l ORDER BY n DESC, label""")
def pair_options(spark, sf_dir):
    """All pairs of suppliers that share three orders or more, by how many, with their names."""
    pairs = graph.pair_counts(order_suppliers(spark, sf_dir), scene="scene_id", entity="entity_id").where("n >= 3")
    names = D.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    a, b = names.toDF("subject_id", "a_name"), names.toDF("object_id", "b_name")
    labelled = pairs.join(a, "subject_id").join(b, "object_id").select(F.concat_ws("::", "subject_id", "object_id").alias("pair"), "n", F.concat("a_name", F.lit(" <> "), "b_name").alias("label"))
    return labelled.orderBy(F.desc("n"), "label")


@query(PAIRS + """, known(a, b) AS (SELECT least(s_suppkey, s_suppkey + 1), greatest(s_suppkey, s_suppkey + 1) FROM supplier)
SELECT count(*) AS kept, sum(n)::BIGINT AS scenes FROM p WHERE NOT EXISTS (SELECT 1 FROM known WHERE a = least(subject_id, object_id) AND b = greatest(subject_id, object_id))""")
def manual_edge_antijoin(spark, sf_dir):
    """Pairs that no hand-made edge joins; such edges run from a supplier's successor to it."""
    pairs = graph.pair_counts(order_suppliers(spark, sf_dir), scene="scene_id", entity="entity_id").where("n >= 3")
    known = D.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("subject_id"), F.col("s_suppkey").alias("object_id"))
    return graph.without_known_pairs(pairs, known).agg(F.count("*").alias("kept"), F.sum("n").alias("scenes"))


@query("""
WITH c AS (SELECT conv_id, role FROM conversations GROUP BY 1, 2)
SELECT a.role AS subject_id, b.role AS object_id, count(*) AS n, string_agg(a.conv_id::VARCHAR, ',' ORDER BY a.conv_id) FILTER (rn <= 8) AS scene_ids
FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id) AS x FROM c) a JOIN c b ON a.conv_id = b.conv_id AND a.role < b.role
JOIN (SELECT p.conv_id, p.role AS r1, q.role AS r2, row_number() OVER (PARTITION BY p.role, q.role ORDER BY p.conv_id) AS rn FROM c p JOIN c q ON p.conv_id = q.conv_id AND p.role < q.role) k ON k.conv_id = a.conv_id AND r1 = a.role AND r2 = b.role
GROUP BY 1, 2
""")
def role_cooccurrence(spark, sf_dir):
    """Roles that speak in one conversation, with the first conversations as evidence."""
    roster = D.turn_events(spark, sf_dir).select("scene_id", F.col("speaker_entity_id").alias("entity_id")).distinct()
    found = graph.pair_counts(roster, scene="scene_id", entity="entity_id", with_scenes=True)
    return found.select("subject_id", "object_id", "n", F.array_join(F.col("scene_ids").cast("array<string>"), ",").alias("scene_ids"))


# Events in time.


def day_positions(spark, sf_dir):
    return graph.positions(D.day_events(spark, sf_dir), order=("ts", "event_id"))


@query(f"SELECT event_id AS from_event, lead(event_id) OVER w AS to_event, row_number() OVER w AS position FROM ({DAY}) WINDOW w AS (ORDER BY scene_id, ts, event_id) QUALIFY to_event IS NOT NULL")
def temporal_precedes(spark, sf_dir):
    at = day_positions(spark, sf_dir)
    follows = F.coalesce("next_event", F.when(F.col("event") == F.col("last_event"), F.col("next_scene_first")))
    return at.select(F.col("event").alias("from_event"), follows.alias("to_event"), "position").where("to_event is not null")


@query(f"SELECT event_id AS from_event, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_event FROM ({DAY}) QUALIFY to_event IS NOT NULL")
def temporal_same_scene(spark, sf_dir):
    """Each user's events in a row."""
    by_user = graph.positions(D.day_events(spark, sf_dir).drop("scene_id"), scene="user_id", order=("ts", "event_id"))
    return by_user.where("next_event is not null").select(F.col("event").alias("from_event"), F.col("next_event").alias("to_event"))


@query(f"""
WITH t AS ({TURNS}), s AS (SELECT scene_id, arg_min(event_id, sequence_in_scene) AS f, arg_max(event_id, sequence_in_scene) AS l FROM t GROUP BY 1)
SELECT l AS from_event, lead(f) OVER (ORDER BY scene_id) AS to_event FROM s QUALIFY to_event IS NOT NULL
""")
def temporal_cross_scene(spark, sf_dir):
    at = graph.positions(D.turn_events(spark, sf_dir))
    return at.where((F.col("event") == F.col("last_event")) & F.col("next_scene_first").isNotNull()).select(F.col("event").alias("from_event"), F.col("next_scene_first").alias("to_event"))


RELATIONS = f"""
WITH e AS ({DAY}),
w AS (SELECT event_id, scene_id, label, lead(event_id) OVER (ORDER BY scene_id, ts, event_id) AS nxt, lead(event_id) OVER (PARTITION BY scene_id ORDER BY ts, event_id) AS same, lead(scene_id) OVER (ORDER BY scene_id, ts, event_id) AS nxt_scene FROM e),
r AS (SELECT event_id AS from_event, nxt AS to_event, 'precedes' AS relation FROM w UNION ALL SELECT event_id, same, 'same_scene_next' FROM w
UNION ALL SELECT event_id, nxt, 'cross_scene_continuation' FROM w WHERE nxt_scene <> scene_id
UNION ALL SELECT event_id, same, 'flashback_to' FROM w WHERE label = 'error' UNION ALL SELECT event_id, nxt, 'returns_to_frame' FROM w WHERE label = 'signup')
"""


@query(RELATIONS + "SELECT from_event, to_event, relation FROM r WHERE to_event IS NOT NULL AND relation IN ('flashback_to', 'returns_to_frame')")
def temporal_marker_edges(spark, sf_dir):
    """Edges from marked events: errors stand for entering a flashback, sign-ups for returning from it."""
    found = graph.temporal_edges(day_positions(spark, sf_dir), enters="error", returns="signup")
    return found.where(F.col("relation").isin("flashback_to", "returns_to_frame")).select("from_event", "to_event", "relation")


@query(RELATIONS + "SELECT relation, count(*) AS n FROM r WHERE to_event IS NOT NULL GROUP BY 1")
def temporal_relation_counts(spark, sf_dir):
    return graph.temporal_edges(day_positions(spark, sf_dir), enters="error", returns="signup").groupBy("relation").agg(F.count("*").alias("n"))


# Event extraction.


@query(f"""
WITH s AS (SELECT scene_id, bool_or(speaker = 'system') AS framed FROM ({TURNS}) GROUP BY 1),
b AS (SELECT scene_id, -3 AS place, 'scene_entry' AS label, 1.0::DOUBLE AS confidence FROM s UNION ALL SELECT scene_id, -1, 'flashback_enter', 0.97 FROM s WHERE framed UNION ALL SELECT scene_id, 2147483647, 'scene_exit', 1.0 FROM s)
SELECT * FROM b
""")
def scene_boundary_events(spark, sf_dir):
    scenes = D.turn_events(spark, sf_dir).groupBy("scene_id").agg(F.lit(None).cast("int").alias("year_explicit"), F.when(F.bool_or(F.col("speaker_entity_id") == "system"), F.array(F.lit("flashback"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return events.boundary_events(scenes).select("scene_id", F.col("order").alias("place"), "label", "confidence")


@query(f"""
WITH e AS ({DAY}), c AS (SELECT scene_id, label, count(*) AS n FROM e GROUP BY 1, 2)
SELECT scene_id, any_value(k) AS event_count, string_agg(label || '=' || n, ',' ORDER BY label) AS label_counts, any_value(first3) AS first_events, any_value(u) AS participants
FROM c JOIN (SELECT scene_id, count(*) AS k, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (rn <= 3) AS first3, count(DISTINCT user_id) AS u FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ts, event_id) AS rn FROM e) GROUP BY 1) USING (scene_id) GROUP BY 1
""")
def scene_rollup(spark, sf_dir):
    e = D.day_events(spark, sf_dir).select("*", F.row_number().over(Window.partitionBy("scene_id").orderBy("ts", "event_id")).alias("sequence_in_scene"))
    counts = e.groupBy("scene_id", "label").agg(F.count("*").alias("n")).groupBy("scene_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "label", "n"))), ",").alias("label_counts"))
    first = F.array_sort(F.collect_list(F.when(F.col("sequence_in_scene") <= 3, F.struct("sequence_in_scene", "event_id"))))
    whole = e.groupBy("scene_id").agg(F.count("*").alias("event_count"), F.array_join(F.transform(first, lambda x: x["event_id"].cast("string")), ",").alias("first_events"), F.countDistinct("user_id").alias("participants"))
    return whole.join(counts, "scene_id")


def classified_turns(spark, sf_dir):
    """Turns with the class of each; a user's turn stands for a question, as the texts have no question marks."""
    said = events.with_answers(D.turn_events(spark, sf_dir), question=F.col("speaker_entity_id") == "user")
    none = F.lit("")
    found = rules.first_match(rules.utterance_rules(text=F.col("text"), cue=F.col("speaker_entity_id"), modifiers=F.array().cast("array<string>"), location=none, header=none, answers=F.col("answers"), low=(F.col("_low"), none, none)))
    return said.withColumn("_low", rules.lowered("text")).withColumn("class", found).drop("_low")


CLASSES = f"""
WITH t AS ({TURNS}), a AS (SELECT *, replace(lower(text), '’', '''') AS x, coalesce(lag(speaker) OVER w = 'user', false) AND speaker IS NOT NULL AND speaker IS DISTINCT FROM lag(speaker) OVER w AS answers FROM t WINDOW w AS (PARTITION BY scene_id ORDER BY sequence_in_scene)),
c AS (SELECT *, CASE
WHEN contains(upper(speaker), 'REPORTER') AND contains(text, '?') THEN 'press_qna_exchange'
WHEN (contains(x, 'committee') OR contains(x, 'senator') OR contains(x, 'press') OR contains(x, 'reporters')) AND contains(text, '?') THEN 'press_qna_exchange'
WHEN regexp_matches(x, '^\\W*(hello|hold on)\\b') OR contains(x, 'on the phone') THEN 'phone_call_conversation'
WHEN contains(text, '?') THEN 'question'
WHEN answers AND length(x) < 261 THEN 'answer_response'
WHEN regexp_matches(x, '^\\W*(hi|hello|hey|good morning|good evening)\\b') THEN 'greeting_or_opening'
WHEN regexp_matches(x, '\\b(goodbye|bye|see you)\\b') THEN 'farewell_or_closing'
WHEN regexp_matches(x, '\\bthis is\\b') AND regexp_matches(x, '\\bmeet\\b') THEN 'introduction'
WHEN regexp_matches(x, '\\b(my fault|i''m sorry|sorry)\\b') THEN 'apology_or_regret'
WHEN regexp_matches(x, '\\b(vow|i promise|i swear)\\b') THEN 'promise_or_vow'
WHEN regexp_matches(x, '\\b(shut up|idiot|stupid|moron|son of a bitch)\\b') THEN 'insult_or_disrespect'
WHEN regexp_matches(x, '\\b(kill you|dead|or else|i''ll kill|we''ll kill)\\b') THEN 'threat_verbal'
WHEN regexp_matches(x, '\\b(can you|could you|would you|please|let me|let us|let''s)\\b') THEN 'request'
WHEN length(x) < 90 AND regexp_matches(trim(x), '^(go|call|tell|take|sit|listen)(\\s|$)') THEN 'instruction_order'
WHEN regexp_matches(x, '\\b(don''t|do not|be careful|watch out|careful)\\b') THEN 'warning'
WHEN regexp_matches(x, '\\b(no|nope|can''t|cannot|won''t|wouldn''t|not gonna)\\b') AND length(x) < 120 THEN 'refusal'
WHEN regexp_matches(x, '\\b(okay|ok|all right|fine|sure|yeah)\\b') AND length(x) < 100 THEN 'agreement_acceptance'
WHEN regexp_matches(x, '\\b(cheers|toast)\\b') THEN 'joke_banter_or_toast'
WHEN regexp_matches(x, '\\b(why don''t you|you gotta|you have to|listen to me)\\b') THEN 'persuasion_attempt'
WHEN regexp_matches(x, '\\b(deal|terms|price|percent|split)\\b') THEN 'negotiation'
WHEN regexp_matches(x, '\\b(because|it turns out|the thing was|what happened)\\b') OR length(x) > 220 THEN 'explanation_account'
WHEN regexp_matches(x, '\\b(i did|i killed|i took|it was me)\\b') THEN 'confession_or_admission'
WHEN regexp_matches(x, '\\b(rally|brothers|sisters|ladies and gentlemen)\\b') THEN 'public_speech_or_address'
ELSE 'statement' END AS label FROM a)
"""


@query(CLASSES + "SELECT event_id, label FROM c")
def classify_turns(spark, sf_dir):
    return classified_turns(spark, sf_dir).select("event_id", F.col("class.label").alias("label"))


@query(CLASSES + "SELECT label, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, label LIMIT 15")
def event_type_topk(spark, sf_dir):
    return events.top_types(classified_turns(spark, sf_dir).withColumn("label", F.col("class.label")), column="label")


@query(CLASSES + "SELECT event_id FROM c WHERE answers")
def answer_after_question(spark, sf_dir):
    return classified_turns(spark, sf_dir).where("answers").select("event_id")


@query(CLASSES + """, r AS (SELECT scene_id, list_sort(list(DISTINCT speaker)) AS roster FROM t GROUP BY 1),
p AS (SELECT event_id, list_concat([{'entity_id': speaker, 'role': 'speaker'}], list_transform(list_filter(roster, lambda y: y <> speaker)[1:2], lambda y: {'entity_id': y, 'role': 'listener'}), [{'entity_id': 'conv_' || scene_id, 'role': 'location'}]) AS ps FROM c JOIN r USING (scene_id)),
u AS (SELECT event_id, unnest(ps) AS q, generate_subscripts(ps, 1) AS i FROM p)
SELECT event_id, q.entity_id AS entity_id, q.role AS role, i::INT AS participant_index FROM u""")
def participants_bridge(spark, sf_dir):
    told = classified_turns(spark, sf_dir).join(events.rosters(D.turn_events(spark, sf_dir)), "scene_id")
    people = events.participants(label=F.col("class.label"), speaker=F.col("speaker_entity_id"), mentioned=F.array().cast("array<string>"), roster=F.col("roster"), voice_over=F.lit(False), location=F.concat(F.lit("conv_"), F.col("scene_id").cast("string")), spoken=F.lit(True))
    flat = told.select("event_id", F.posexplode(people).alias("pos", "p"))
    return flat.select("event_id", F.col("p.entity_id").alias("entity_id"), F.col("p.role").alias("role"), (F.col("pos") + 1).alias("participant_index"))


@query(CLASSES + "SELECT event_id, replace(label, '_', ' ') AS shown, CASE WHEN length(q) <= 150 THEN q ELSE rtrim(q[1:147]) || '...' END AS snippet FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM c)")
def event_snippets(spark, sf_dir):
    return classified_turns(spark, sf_dir).select("event_id", F.replace("class.label", F.lit("_"), F.lit(" ")).alias("shown"), T.truncate("text", 150).alias("snippet"))


@query("""
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS scene_id FROM events), s AS (SELECT scene_id, count(*) AS n FROM e GROUP BY 1), b AS (SELECT scene_id, (sum(n) OVER (ORDER BY scene_id) - n)::BIGINT AS before FROM s)
SELECT event_id, rn::INT AS sequence_in_scene, printf('evt_%06d', before + rn) AS made_id FROM (SELECT event_id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY ts, event_id) AS rn FROM e) JOIN b USING (scene_id)
""")
def event_numbering(spark, sf_dir):
    """Ids over all scenes from counts per scene: no window holds all events."""
    e = D.day_events(spark, sf_dir).withColumnRenamed("event_id", "own_id").withColumn("scene_index", F.col("scene_id")).withColumn("order", F.struct("ts", "own_id"))
    return events.numbered(e).select(F.col("own_id").alias("event_id"), "sequence_in_scene", F.col("event_id").alias("made_id"))


# State changes.

#: A rule table over the events table: users of neighbouring numbers as pairs.
RULES = [
    {"rule_id": f"r{k:02d}", "subject_id": f"u{a}", "object_id": f"u{b}", "event_type_l2_any": kinds, "text_any": words, "min_event_confidence": least, "state_dimension": dimension, "direction": direction, "magnitude": size, "claim_type": claim, "confidence": conf, "inference_method": "rule"}
    for k, (a, b, kinds, words, least, dimension, direction, size, claim, conf) in enumerate(
        [
            (1, 2, ["purchase"], None, None, "trust", "increase", "low", "explicit", 0.9),
            (1, 2, ["error"], None, None, "trust", "decrease", None, "inferred", 0.7),
            (2, 1, None, ["view"], 0.5, "distance", "increase", "high", "inferred", 0.65),
            (3, 4, ["click", "view"], None, None, "loyalty", "increase", "medium", "explicit", 0.8),
            (5, 6, None, ["signup", "error"], 0.3, "fear", "increase", "low", "inferred", 0.6),
            (3, 4, ["view"], None, 0.2, "loyalty", "increase", "high", "explicit", 0.85),
        ],
        1,
    )
]


def rule_events(spark, sf_dir):
    """Events with two people each: the user and the next one, numbers from 0 to 9; confidence from the value."""
    e = D.day_events(spark, sf_dir)
    a = F.col("user_id") % 10
    return e.select("event_id", "scene_id", F.col("event_id").alias("position"), F.col("label").alias("event_type_l2"), F.lit("event").alias("event_type_l1"), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 2).alias("confidence"), F.lower("label").alias("haystack"), F.array(F.concat(F.lit("u"), a), F.concat(F.lit("u"), (a + 1) % 10)).alias("people"), F.array(F.concat(F.lit("ref"), F.col("event_id"))).alias("refs"))


def changes(spark, sf_dir):
    return states.state_changes(states.hits(rule_events(spark, sf_dir), states.rule_table(spark, RULES)))


def _sql_list(values):
    return "NULL" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_text(value):
    return "NULL" if value is None else f"'{value}'"


RULES_SQL = ", ".join(f"('{r['rule_id']}', '{r['subject_id']}', '{r['object_id']}', {_sql_list(r['event_type_l2_any'])}::VARCHAR[], {_sql_list(r['text_any'])}::VARCHAR[], {'NULL' if r['min_event_confidence'] is None else r['min_event_confidence']}::DOUBLE, '{r['state_dimension']}', '{r['direction']}', {_sql_text(r['magnitude'])}, '{r['claim_type']}', {r['confidence']}::DOUBLE)" for r in RULES)
CHANGES = f"""
WITH rule(rule_id, s, o, kinds, words, least_conf, dim, dir, mag, claim, conf) AS (VALUES {RULES_SQL}),
e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS scene_id, event_type, round(least(value / 100, 1.0), 2) AS c, 'u' || (user_id % 10) AS a, 'u' || ((user_id % 10 + 1) % 10) AS b FROM events),
h AS (SELECT *, round(least(greatest(0.7 * conf + 0.3 * c, 0.05), 0.999), 3) AS hit FROM e JOIN rule ON (s = a AND o = b OR s = b AND o = a)
 WHERE (kinds IS NULL OR list_contains(kinds, event_type)) AND (least_conf IS NULL OR c >= least_conf) AND (words IS NULL OR len(list_filter(words, lambda w: contains(lower(event_type), w))) > 0)),
ranked AS (SELECT *, CASE mag WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS mr FROM h),
firsts AS (SELECT scene_id, s, o, dim, dir, claim, event_id, min(rule_id) AS r1 FROM h GROUP BY ALL),
rule_first AS (SELECT scene_id, s, o, dim, dir, claim, rule_id, min(event_id) AS at1 FROM h GROUP BY ALL),
kind_first AS (SELECT scene_id, s, o, dim, dir, claim, event_type, min(event_id) AS at1 FROM h GROUP BY ALL),
g AS (SELECT scene_id, s, o, dim, dir, claim, max(hit) AS confidence, arg_max(mag, mr) AS magnitude, min(event_id) AS position FROM ranked GROUP BY ALL),
sc AS (SELECT g.*, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM firsts f WHERE (f.scene_id, f.s, f.o, f.dim, f.dir, f.claim) = (g.scene_id, g.s, g.o, g.dim, g.dir, g.claim)) AS trigger_event_ids,
 (SELECT string_agg(rule_id, ',' ORDER BY at1, rule_id) FROM rule_first f WHERE (f.scene_id, f.s, f.o, f.dim, f.dir, f.claim) = (g.scene_id, g.s, g.o, g.dim, g.dir, g.claim)) AS rule_ids,
 (SELECT string_agg(event_type, ',' ORDER BY at1) FROM kind_first f WHERE (f.scene_id, f.s, f.o, f.dim, f.dir, f.claim) = (g.scene_id, g.s, g.o, g.dim, g.dir, g.claim)) AS kinds FROM g)
"""


@query(CHANGES + "SELECT scene_id, s AS subject_id, o AS object_id, dim AS state_dimension, dir AS direction, claim AS claim_type, magnitude, confidence, position, trigger_event_ids, rule_ids, kinds FROM sc")
def state_changes(spark, sf_dir):
    found = changes(spark, sf_dir)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("scene_id", "subject_id", "object_id", "state_dimension", "direction", "claim_type", "magnitude", "confidence", "position", flat("trigger_event_ids").alias("trigger_event_ids"), flat("rule_ids").alias("rule_ids"), flat("trigger_event_type_l2s").alias("kinds"))


@query(CHANGES + """SELECT facet, value, count(*) AS n FROM (SELECT 'claim_type' AS facet, claim AS value FROM sc UNION ALL SELECT 'state_dimension', dim FROM sc UNION ALL SELECT 'direction', dir FROM sc
UNION ALL SELECT 'pair_directed', s || '->' || o FROM sc UNION ALL SELECT 'pair_undirected', least(s, o) || '<->' || greatest(s, o) FROM sc) GROUP BY 1, 2""")
def state_change_facets(spark, sf_dir):
    return states.facets(changes(spark, sf_dir))


@query(CHANGES + """SELECT w.s AS subject_id, w.o AS object_id, (SELECT count(*) FROM sc WHERE sc.s = w.s AND sc.o = w.o) AS directed_count, (SELECT count(*) FROM sc WHERE least(sc.s, sc.o) = least(w.s, w.o) AND greatest(sc.s, sc.o) = greatest(w.s, w.o)) AS undirected_count
FROM (VALUES ('u1', 'u2'), ('u4', 'u3'), ('u8', 'u9')) w(s, o)""")
def core_pair_summary(spark, sf_dir):
    wanted = spark.createDataFrame([("u1", "u2"), ("u4", "u3"), ("u8", "u9")], "subject_id string, object_id string")
    return states.core_pairs(changes(spark, sf_dir), wanted)


@query(CHANGES + ", k AS (SELECT printf('sc_%06d', row_number() OVER (ORDER BY position, scene_id, s, o, dim, dir, claim)) AS state_change_id, * FROM sc), f AS (SELECT * FROM k WHERE least(s, o) || '::' || greatest(s, o) = 'u3::u4' AND claim = 'explicit') SELECT state_change_id, s AS subject_id, o AS object_id, (SELECT count(*) FROM f) AS filtered FROM f ORDER BY state_change_id LIMIT 25")
def state_change_list(spark, sf_dir):
    found = search.list_state_changes(states.numbered_changes(changes(spark, sf_dir)), pair="u3::u4", claim_type="explicit", limit=25)
    return found.select("state_change_id", "subject_id", "object_id", "filtered")


# Searches.


def trace_tables(spark, sf_dir):
    """Events and days in the shape that searches expect."""
    e = D.day_events(spark, sf_dir)
    placed = e.withColumn("sequence_in_scene", F.row_number().over(Window.partitionBy("scene_id").orderBy("ts", "event_id")))
    person = F.struct(F.concat(F.lit("user_"), F.col("user_id")).alias("entity_id"), F.lit("actor").alias("role"))
    found = placed.select(F.col("event_id").cast("string").alias("event_id"), "scene_id", "sequence_in_scene", F.lit("event").alias("event_type_l1"), F.col("label").alias("event_type_l2"), F.concat_ws(" ", "label", "props").alias("summary"), F.array("props").alias("snippets"), F.array(person).alias("participants"))
    days = e.select("scene_id").distinct().select("scene_id", F.date_diff(F.to_date("scene_id"), F.lit("1970-01-01").cast("date")).alias("scene_index"), F.concat(F.lit("DAY "), "scene_id").alias("header_raw"), F.concat(F.lit("week "), F.weekofyear(F.to_date("scene_id"))).alias("location_raw"), F.year(F.to_date("scene_id")).alias("year_explicit"), F.lit(None).cast("int").alias("year_inferred"))
    return found, days


@query("""
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS scene_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS sequence_in_scene FROM events),
f AS (SELECT * FROM e WHERE event_type = 'purchase' AND contains(lower(event_type || ' ' || props), '7') OR event_type = 'purchase' AND contains(event_id::VARCHAR, '7') OR event_type = 'purchase' AND contains(lower(props), '7'))
SELECT event_id::VARCHAR AS event_id, scene_id, sequence_in_scene::INT AS sequence_in_scene, (SELECT count(*) FROM f) AS filtered FROM f ORDER BY scene_id, sequence_in_scene, event_id::VARCHAR LIMIT 100
""")
def trace_search(spark, sf_dir):
    found, days = trace_tables(spark, sf_dir)
    return search.trace_events(found, days, q="7", event_type="purchase", limit=100).select("event_id", "scene_id", "sequence_in_scene", "filtered")


@query("WITH f AS (SELECT event_id::VARCHAR AS event_id FROM events WHERE user_id = 7) SELECT event_id, (SELECT count(*) FROM f) AS filtered FROM f ORDER BY event_id LIMIT 150")
def semi_join_entity_events(spark, sf_dir):
    found, _ = trace_tables(spark, sf_dir)
    bridge = found.select("event_id", F.explode("participants").alias("p")).select("event_id", "p.entity_id")
    return search.list_debug_events(found, bridge, entity_id="user_7").select("event_id", "filtered")


@query(CHANGES + """, ev AS (SELECT scene_id, count(*) AS events, count(*) FILTER (event_type = 'signup') AS matching_events FROM e GROUP BY 1), ch AS (SELECT scene_id, count(*) AS matching_state_changes FROM sc GROUP BY 1)
SELECT scene_id, matching_events, events, coalesce(matching_state_changes, 0) AS matching_state_changes FROM ev LEFT JOIN ch USING (scene_id) WHERE matching_events > 0 OR coalesce(matching_state_changes, 0) > 0 ORDER BY scene_id LIMIT 24""")
def timeline_slice(spark, sf_dir):
    """Days with sign-ups or any state change: the kind of event is no condition on changes."""
    found, days = trace_tables(spark, sf_dir)
    return search.timeline_slice(found, states.numbered_changes(changes(spark, sf_dir)), days, event_type="signup").select("scene_id", "matching_events", "events", "matching_state_changes")


@query("SELECT 'event_type_l2' AS facet, event_type AS value FROM events UNION SELECT 'year', strftime(ts, '%Y') FROM events UNION SELECT 'user', user_id::VARCHAR FROM events")
def facets_distinct(spark, sf_dir):
    e = D.day_events(spark, sf_dir)
    parts = F.array(
        F.struct(F.lit("event_type_l2").alias("facet"), F.col("label").alias("value")),
        F.struct(F.lit("year").alias("facet"), F.date_format("ts", "yyyy").alias("value")),
        F.struct(F.lit("user").alias("facet"), F.col("user_id").cast("string").alias("value")),
    )
    return e.select(F.inline(parts)).where("value is not null").distinct()


@query("SELECT name, n FROM (SELECT 'customers' AS name, count(*) AS n FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'turns', count(*) FROM conversations)")
def dataset_summary(spark, sf_dir):
    t = lambda n: D.table(spark, sf_dir, n)
    return search.summary_counts(customers=t("customer"), documents=t("documents"), events=t("events"), turns=t("conversations"))


# Texts.

LINES = "SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def lines(spark, sf_dir):
    return cleaning.document_lines(D.table(spark, sf_dir, "documents"))


@query(LINES)
def document_lines(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"""
WITH l AS ({LINES}), m AS (SELECT *, length(line) < 40 AS blank FROM l),
x AS (SELECT *, min(line_no) FILTER (NOT blank) OVER (PARTITION BY doc_id) AS f, max(line_no) FILTER (NOT blank) OVER (PARTITION BY doc_id) AS t, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS b FROM m)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS line_no, line FROM x WHERE NOT (blank AND b) AND line_no BETWEEN f AND t
""")
def blank_collapse(spark, sf_dir):
    """Runs of short lines, which stand for blanks, as one."""
    return cleaning.blank_runs_collapsed(lines(spark, sf_dir), blank=F.length("line") < 40)


SYMBOLS = f"""
WITH l AS ({LINES}), s AS (SELECT *, CASE WHEN length(line) < 40 THEN 'B' WHEN line_no = 1 OR starts_with(line, 'The') THEN 'H' WHEN length(line) < 90 THEN 'A' WHEN contains(line, ',') THEN 'X' ELSE 'P' END AS symbol FROM l),
g AS (SELECT *, sum(CASE WHEN symbol IN ('H', 'A') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM s),
w AS (SELECT *, first_value(symbol) OVER p AS anchor, max(CASE WHEN symbol = 'P' THEN 1 ELSE 0 END) OVER p AS unaccepted, min(CASE WHEN symbol IN ('P', 'X') THEN line_no END) OVER p AS first_text,
 max(CASE WHEN symbol = 'B' THEN line_no END) OVER (PARTITION BY doc_id, part ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_blank FROM g WINDOW p AS (PARTITION BY doc_id, part ORDER BY line_no)),
k AS (SELECT *, CASE WHEN symbol = 'H' THEN 'scene_header' WHEN symbol = 'A' THEN 'cue' WHEN symbol = 'B' THEN NULL WHEN anchor = 'A' AND unaccepted = 0 AND (last_blank IS NULL OR last_blank < first_text) THEN 'spoken' ELSE 'action' END AS kind FROM w),
b AS (SELECT *, CASE WHEN kind IN ('scene_header', 'cue') OR kind = 'action' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM 'action' THEN 1 ELSE 0 END AS start FROM k)
SELECT doc_id, line_no, symbol, kind, (sum(start) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS block_no FROM b
"""


@query(SYMBOLS)
def line_segmentation(spark, sf_dir):
    """The windows of segmentation over a surrogate class of lines."""
    from plotweave.operators import segment

    line = F.col("line")
    symbol = F.when(F.length(line) < 40, "B").when((F.col("line_no") == 1) | line.startswith("The"), "H").when(F.length(line) < 90, "A").when(line.contains(","), "X").otherwise("P")
    return segment.with_blocks(lines(spark, sf_dir).withColumn("symbol", symbol)).select("doc_id", "line_no", "symbol", "kind", "block_no")


@query("""SELECT marker, count(*) AS n FROM (SELECT 'flashback' AS marker FROM conversations WHERE regexp_matches(text, '(?i)\\bFLASHBACK\\b') UNION ALL SELECT 'back_to' FROM conversations WHERE regexp_matches(text, '(?i)\\bBACK\\s+TO\\b')
UNION ALL SELECT 'voice_over' FROM conversations WHERE regexp_matches(text, '(?i)\\bV/O\\b') UNION ALL SELECT 'short_' || role FROM conversations WHERE length(text) < 100) GROUP BY 1""")
def marker_counts(spark, sf_dir):
    t = D.table(spark, sf_dir, "conversations")
    found = F.concat(T.markers("text"), F.when(F.length("text") < 100, F.array(F.concat(F.lit("short_"), "role"))).otherwise(F.array().cast("array<string>")))
    return t.select(F.explode(found).alias("marker")).groupBy("marker").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, 'obj_' || {SLUG.format('p_name')} AS made_id FROM part")
def slug_ids(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("obj_"), T.slug("p_name")).alias("made_id"))


@query(r"""
WITH q AS (SELECT item_id, lower(trim(text)) AS whole, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda w: length(w) >= 2) AS w FROM benchmark),
qt AS (SELECT DISTINCT item_id, unnest(w) AS w FROM q),
d AS (SELECT doc_id, lower(text) AS low, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda w: length(w) >= 2) AS w FROM documents),
dt AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(k)::BIGINT AS shared FROM qt JOIN dt USING (w) GROUP BY 1, 2),
b AS (SELECT s.item_id, s.doc_id, shared + CASE WHEN whole <> '' AND contains(low, whole) THEN 2 ELSE 0 END AS score FROM s JOIN q USING (item_id) JOIN d USING (doc_id))
SELECT item_id, doc_id, score FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 6
""")
def token_overlap_retrieval(spark, sf_dir):
    """For every question the six texts that share most words."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = D.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return retrieval.best_matches(asked, docs, question_key="item_id", question="question", key="doc_id", text="text", pass_words=retrieval.PASS_WORDS).select("item_id", "doc_id", "score")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\d{1,3}([A-Z(])', '\1'), '\s{2,}\d{1,3}$', '')) AS clean, length(text)::INT AS n FROM documents")
def text_clean(spark, sf_dir):
    squeezed = T.squeeze("text")
    bare = F.regexp_replace(F.regexp_replace(squeezed, r"^\d{1,3}([A-Z(])", "$1"), r"\s{2,}\d{1,3}$", "")
    return D.table(spark, sf_dir, "documents").select("doc_id", F.trim(bare).alias("clean"), F.length("text").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# Questions and answers.

#: Every turn of every conversation is asked as a question.
TURNS_ASKED = "SELECT conv_id || ':' || turn AS query_id, text AS question FROM conversations"


def turns_asked(spark, sf_dir):
    return D.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))


def _any_sql(words):
    return "(" + " OR ".join("contains(q, '{}')".format(w.replace("'", "''")) for w in words) + ")"


@query(f"""
WITH a AS ({TURNS_ASKED}), l AS (SELECT *, lower(trim(question)) AS q FROM a),
t AS (SELECT *, CASE WHEN {_any_sql(router.COMPARISON)} THEN 'comparison' WHEN {_any_sql(router.EVIDENCE)} OR starts_with(q, 'show ') AND contains(q, 'scene') THEN 'evidence'
WHEN contains(q, 'relationship with') OR contains(q, 'relationship between') OR contains(q, 'relationship change') OR contains(q, 'state change') OR contains(q, 'how does') AND contains(q, 'change over time')
 OR {_any_sql(router.STATE_CHANGE)} AND (contains(q, 'how does') OR contains(q, 'over time') OR contains(q, 'trajectory')) THEN 'state_change'
WHEN {_any_sql(router.CAUSAL)} THEN 'causal_chain' WHEN {_any_sql(router.TIMELINE)} OR regexp_matches(q, '\\bwhen\\b') OR contains(q, 'chronolog') THEN 'timeline' ELSE 'fact' END AS query_type FROM l)
SELECT query_id, query_type, CASE query_type WHEN 'fact' THEN 'kg' WHEN 'timeline' THEN 'ntg' WHEN 'state_change' THEN 'ntg' ELSE 'hybrid' END AS mode_used FROM t
""")
def route_questions(spark, sf_dir):
    return router.routed(turns_asked(spark, sf_dir)).select("query_id", "query_type", "mode_used")


@query("""
WITH q AS (SELECT s_suppkey AS qid, s_suppkey, s_nationkey, 'how is ' || lower(n_name) || ' tied to ' || lower(s_name) || ' and ' || lower(r_name) || '?' AS text, lower(s_name) AS s, lower(n_name) AS n, lower(r_name) AS r, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
f AS (SELECT qid, text, 'org_' || s_suppkey AS entity_id, s AS phrase FROM q UNION ALL SELECT qid, text, 'nat_' || s_nationkey, n FROM q UNION ALL SELECT qid, text, 'reg_' || n_regionkey, r FROM q),
p AS (SELECT *, strpos(text, phrase) - 1 AS start FROM f)
SELECT qid, entity_id, start::INT AS start, (start + length(phrase))::INT AS stop, (row_number() OVER (PARTITION BY qid ORDER BY start))::INT AS place FROM p
""")
def detect_entities(spark, sf_dir):
    """Entities of all kinds named in a question about every supplier."""
    t = lambda n: D.table(spark, sf_dir, n)
    asked = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    asked = asked.select(F.col("s_suppkey").alias("qid"), F.lower(F.concat(F.lit("how is "), "n_name", F.lit(" tied to "), "s_name", F.lit(" and "), "r_name", F.lit("?"))).alias("text"))
    lexicon = answers.lexicon(D.entities(spark, sf_dir), spark.createDataFrame([], "entity_id string, alias_raw string, alias_normalized string, source string"))
    return spans.detected(asked, lexicon, key="qid", text="text").select("qid", "entity_id", "start", "stop", "place")


@query("""WITH t AS (SELECT o_orderkey AS k, list('part_' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list('supp_' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b, max(l_discount) AS x, max(l_tax) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
u AS (SELECT k, x, y, unnest(list_concat(a, b, a)) AS v, unnest(range(1, 2 * len(a) + len(b) + 1)) AS i FROM t), f AS (SELECT k, v, min(i) AS i, any_value(x) AS x, any_value(y) AS y FROM u GROUP BY k, v)
SELECT k AS order_key, string_agg(v, ',' ORDER BY i) AS merged, round(least(0.93, 0.97 * greatest(any_value(x), any_value(y)) + 0.03), 6) AS confidence FROM f GROUP BY k""")
def answer_merge(spark, sf_dir):
    """Two answers' lists and confidences as one, for an order's parts and suppliers: what hybrid answers do."""
    t = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"), F.max("l_discount").alias("x"), F.max("l_tax").alias("y"))
    named = lambda p, c: F.transform("l", lambda r: F.concat(F.lit(p), r[c].cast("string")))
    none, empty = F.array().cast("array<string>"), F.lit("")
    side = lambda lists, sure: t.select(F.col("order_key").alias("question_id"), empty.alias("answer_text"), F.col(sure).alias("confidence"), lists.alias("entities_used"), none.alias("events_used"), none.alias("state_changes_used"), none.alias("evidence_refs"), empty.alias("reasoning_notes"))
    asked = t.select(F.col("order_key").alias("question_id"), F.lit("fact").alias("query_type"), F.lit(True).alias("include_evidence"))
    merged = batch_answers.hybrid_answers(asked, side(F.concat(named("part_", "l_partkey"), F.array(empty)), "x"), side(F.concat(named("supp_", "l_suppkey"), named("part_", "l_partkey")), "y"))
    return merged.select(F.col("question_id").alias("order_key"), F.array_join(T.ordered_distinct("entities_used"), ",").alias("merged"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH a(place, id) AS (VALUES (0, '5'), (1, '17'), (2, 'nowhere')), r(place, id) AS (VALUES (0, 'ref5'), (1, 'scene:3'), (2, 'ref99'))
SELECT 'event' AS kind, id, event_type AS detail FROM a JOIN events ON event_id::VARCHAR = id
UNION ALL SELECT CASE WHEN starts_with(id, 'scene:') THEN 'scene_ref' ELSE 'raw_ref' END, id, NULL FROM r WHERE id NOT IN (SELECT 'ref' || id FROM a JOIN events ON event_id::VARCHAR = id)
""")
def evidence_resolution(spark, sf_dir):
    """Asked events that exist, and refs that none of them covers."""
    asked = spark.createDataFrame([(0, "5"), (1, "17"), (2, "nowhere")], "place int, id string")
    refs = spark.createDataFrame([(0, "ref5"), (1, "scene:3"), (2, "ref99")], "place int, id string")
    e = D.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    met = e.join(F.broadcast(asked), F.col("event_id") == F.col("id"))
    covered = met.select(F.concat(F.lit("ref"), "event_id").alias("_ref"))
    left = refs.join(covered, F.col("id") == F.col("_ref"), "left_anti")
    return met.select(F.lit("event").alias("kind"), "id", F.col("event_type").alias("detail")).unionByName(left.select(F.when(F.col("id").startswith("scene:"), "scene_ref").otherwise("raw_ref").alias("kind"), "id", F.lit(None).cast("string").alias("detail")))


# Data quality.


@query("""
WITH s AS (SELECT o_custkey AS c, o_orderkey AS a, o_orderkey + o_orderkey % 50 AS b FROM orders), r AS (SELECT *, max(b) OVER (PARTITION BY c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT fault, count(*) AS n FROM (SELECT CASE WHEN a > reach + 1 THEN 'gap' WHEN a <= reach THEN 'overlap' END AS fault FROM r) WHERE fault IS NOT NULL GROUP BY 1
""")
def span_gaps_overlaps(spark, sf_dir):
    """Gaps and overlaps of a customer's orders, an order reaching over the next numbers."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.col("o_orderkey") % 50).alias("b"))
    return quality.range_faults(o, group="c", start="a", end="b").groupBy("fault").agg(F.count("*").alias("n"))


@query("""
SELECT 'turns_contiguous' AS check_id, count(*) = 0 AS passed, count(*) AS failures FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING min(turn) <> 0 OR count(*) <> count(DISTINCT turn) OR max(turn) + 1 <> count(DISTINCT turn))
UNION ALL SELECT 'lines_contiguous', count(*) = 0, count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR count(*) <> count(DISTINCT l_linenumber) OR max(l_linenumber) <> count(DISTINCT l_linenumber))
""")
def sequence_integrity(spark, sf_dir):
    turns = quality.sequence_faults(D.table(spark, sf_dir, "conversations"), group="conv_id", place="turn", first=0)
    items = quality.sequence_faults(D.table(spark, sf_dir, "lineitem"), group="l_orderkey", place="l_linenumber")
    return quality.all_checks(quality.check("turns_contiguous", turns), quality.check("lines_contiguous", items))


@query("""
WITH d AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT 'doc_id' AS key, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, 0::BIGINT AS surplus_rows
UNION ALL SELECT 'text', count(*), coalesce(sum(n - 1), 0)::BIGINT FROM d
""")
def duplicate_keys(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text"))
    one = lambda k: quality.duplicate_summary(docs, k).select(F.lit(k).alias("key"), "duplicate_keys", "surplus_rows")
    return one("doc_id").unionByName(one("text"))


@query("""
SELECT 'lineitem_orders' AS check_id, count(*) = 0 AS passed, count(*) AS failures FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels_documents', count(*) = 0, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents_labels', count(*) = 0, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def referential_integrity(spark, sf_dir):
    t = lambda n: D.table(spark, sf_dir, n)
    pairs = (("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels_documents", "labels", "doc_id", "documents", "doc_id"), ("documents_labels", "documents", "doc_id", "labels", "doc_id"))
    return quality.all_checks(*(quality.check(name, quality.orphans(t(a), t(b), key=k, parent_key=pk)) for name, a, k, b, pk in pairs))


@query("SELECT count(*) AS total, count(*) FILTER (n_chars = length(text)) AS passed, count(*) FILTER (n_chars <> length(text)) AS failed, round(count(*) FILTER (n_chars = length(text)) / count(*), 4) AS pass_rate FROM documents")
def gold_check_summary(spark, sf_dir):
    checks = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("check_id"), (F.col("n_chars") == F.length("text")).alias("passed"))
    return quality.check_summary(checks)


TYPES = [("click", "browse"), ("view", "browse"), ("purchase", "commerce"), ("refund", "commerce"), ("signup", "account")]


@query("""
WITH t(l2, l1) AS (VALUES ('click', 'browse'), ('view', 'browse'), ('purchase', 'commerce'), ('refund', 'commerce'), ('signup', 'account'))
SELECT l2 AS event_type_l2, 'covered' AS issue, (SELECT count(*) FROM events WHERE event_type = l2) AS n FROM t
UNION ALL SELECT event_type, 'unknown_l2', least(count(*), 200) FROM events WHERE event_type NOT IN (SELECT l2 FROM t) GROUP BY 1
""")
def taxonomy_coverage(spark, sf_dir):
    """Kinds of a taxonomy by their events, and up to 200 events of unknown kinds."""
    types = spark.createDataFrame(TYPES, "event_type_l2 string, event_type_l1 string")
    e = D.day_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.col("label").alias("event_type_l2"))
    told = e.join(F.broadcast(types), "event_type_l2", "left")
    seen = quality.type_coverage(e, types).select("event_type_l2", F.lit("covered").alias("issue"), "n")
    issues = quality.taxonomy_issues(told, types).groupBy("event_type_l2", "issue").agg(F.count("*").alias("n")).where("issue = 'unknown_l2'")
    return seen.unionByName(issues.select("event_type_l2", "issue", "n"))


@query("SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'assistant') AND text <> '' THEN true ELSE false END AS ok FROM conversations")
def required_fields(spark, sf_dir):
    t = D.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", quality.required_fields(t, strings=("text",), numbers=("turn",), allowed={"role": ("user", "assistant")}).alias("ok"))
