"""More of the catalogue: scripts written out from conversations, read into scenes and blocks, and what is made of those."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotweave.functions import lines as L
from plotweave.functions import text as T
from plotweave.operators import answers, cleaning, entities, events, graph, quality, router, search, segment, spans, states
from plotweave.plans import tables as D
from plotweave.plans.catalog import CHANGES, DAY, EDGES, ENTITIES, ORACLES, RELATIONS, SLUG, TURNS_ASKED, changes, day_positions, query, trace_tables, turns_asked
from plotweave.sources import envelope

# Scripts and their lines.

SCRIPT_LINES = """
SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(string_agg(part, chr(10) ORDER BY turn), chr(10)) AS l FROM (
SELECT conv_id AS doc_id, turn, array_to_string(list_filter([
 CASE WHEN turn % 4 = 1 THEN CASE (conv_id + turn) % 4 WHEN 0 THEN 'INT. ROOM ' || conv_id % 5 || ' - NIGHT' WHEN 1 THEN 'EXT. ROAD ' || conv_id % 5 || ' - DAY - 1975' WHEN 2 THEN 'INT./EXT. CAR ' || conv_id % 5 || ' - CONTINUED - LATER' ELSE 'EXT. YARD 1962 - FLASHBACK' END END,
 CASE WHEN turn % 4 = 1 THEN '' END, upper(role) || CASE (conv_id + turn) % 3 WHEN 1 THEN ' V/O' WHEN 2 THEN ' (CONT''D)' ELSE '' END, CASE WHEN (conv_id + turn) % 5 = 0 THEN '(quietly)' END, text, '',
 CASE WHEN turn % 3 = 1 THEN 'They wait at door ' || turn || '.' END, CASE WHEN turn % 3 = 1 THEN '' END], lambda x: x IS NOT NULL), chr(10)) AS part FROM conversations) GROUP BY doc_id)
"""
HEADER = r"(?i)^(INT\.|EXT\.|INT/EXT\.|EXT/INT\.|INT\./EXT\.|EXT\./INT\.)\s+(.+)$"
TRANSITION = "(" + " OR ".join(f"starts_with(line, '{t}')" for t in L.TRANSITIONS) + ")"
FLAGS = rf"""
WITH l AS (SELECT doc_id, line_no, trim(line) AS line FROM ({SCRIPT_LINES})),
f AS (SELECT *, line = '' AS blank, regexp_matches(line, '{HEADER}') AS header, length(line) >= 2 AND starts_with(line, '(') AND ends_with(line, ')') AS paren,
 length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals,
 len(list_filter(string_split_regex(trim(translate(regexp_replace(line, '\([^)]*\)', '', 'g'), '/', ' ')), '\s+'), lambda w: w <> '')) AS cue_words,
 len(list_filter(string_split_regex(line, '\s+'), lambda w: regexp_replace(w, '^[.()]+|[.()]+$', '', 'g') IN ('FINAL', 'SCRIPT', 'SCREENPLAY', 'SHOOTING'))) > 0 AND NOT contains(line, 'V/O') AND NOT contains(line, '(') AS titled FROM l),
p AS (SELECT *, letters > 0 AND 10 * capitals >= 9 * letters AS upper_case,
 line <> '' AND NOT starts_with(line, '#') AND NOT contains(line, ' - ') AND NOT regexp_matches(line, '[:;]') AND length(line) <= 80 AND NOT {TRANSITION} AND NOT header AND NOT paren AND letters > 0 AND 10 * capitals >= 9 * letters AND cue_words <= 8 AND NOT titled AS probable,
 CASE WHEN line = '' OR header THEN false WHEN paren THEN true WHEN {TRANSITION} THEN false WHEN regexp_matches(line, '\p{{Ll}}') THEN true ELSE len(string_split_regex(line, '\s+')) <= 3 AND length(line) <= 20 END AS spoken_like FROM f)
"""


def script_lines_of(spark, sf_dir):
    return cleaning.document_lines(D.scripts(spark, sf_dir))


@query(f"SELECT doc_id, line_no, line FROM ({SCRIPT_LINES})")
def script_text(spark, sf_dir):
    return script_lines_of(spark, sf_dir)


@query(FLAGS + "SELECT doc_id, line_no, header, paren, upper_case, cue_words::INT AS cue_words, probable, spoken_like FROM p")
def script_line_kinds(spark, sf_dir):
    line = F.trim("line")
    told = {"header": L.is_header(line), "paren": L.is_parenthetical(line), "upper_case": L.is_mostly_upper(line), "cue_words": L.cue_words(line), "probable": L.is_probable_cue(line), "spoken_like": L.looks_spoken(line)}
    return script_lines_of(spark, sf_dir).select("doc_id", "line_no", *(c.alias(n) for n, c in told.items()))


SYMBOLS = FLAGS + """,
said AS (SELECT doc_id, line_no, lead(line, 1) OVER w AS l1, lead(probable OR header, 1) OVER w AS e1, lead(paren, 1) OVER w AS p1, lead(spoken_like, 1) OVER w AS s1, lead(probable OR header, 2) OVER w AS e2, lead(spoken_like, 2) OVER w AS s2 FROM p WHERE NOT blank WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
s AS (SELECT p.doc_id, p.line_no, line, CASE WHEN blank THEN 'B' WHEN header THEN 'H' WHEN probable AND
 CASE WHEN coalesce(e1, true) THEN contains(line, 'V/O') OR contains(line, '(') WHEN p1 THEN CASE WHEN coalesce(e2, true) THEN contains(line, 'V/O') OR contains(line, '(') ELSE s2 END ELSE s1 END THEN 'A' WHEN probable THEN 'P' ELSE 'X' END AS symbol
 FROM p LEFT JOIN said USING (doc_id, line_no))
"""


@query(SYMBOLS + "SELECT doc_id, line_no, line, symbol FROM s")
def script_symbols(spark, sf_dir):
    return segment.with_symbols(script_lines_of(spark, sf_dir))


MARKER_SQL = "list_filter([CASE WHEN regexp_matches(m, '(?i)\\bBACK\\s+TO\\b') THEN 'back_to' END, CASE WHEN regexp_matches(m, '(?i)\\(CONT[''’]?D\\)') THEN 'contd' END, CASE WHEN regexp_matches(m, '(?i)\\bFLASHBACK\\b') THEN 'flashback' END, CASE WHEN regexp_matches(m, '(?i)\\(IN\\s+SYNC\\)') THEN 'in_sync' END, CASE WHEN regexp_matches(m, '(?i)\\(OVERLAP\\)') THEN 'overlap' END, CASE WHEN regexp_matches(m, '(?i)PRE-LAP') THEN 'pre_lap' END, CASE WHEN regexp_matches(m, '(?i)\\bV/O\\b') THEN 'voice_over' END], lambda x: x IS NOT NULL)"
BLOCKS = SYMBOLS + f""",
g AS (SELECT *, sum(CASE WHEN symbol IN ('H', 'A') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM s),
w AS (SELECT *, first_value(symbol) OVER q AS anchor, max(CASE WHEN symbol = 'P' THEN 1 ELSE 0 END) OVER q AS unaccepted, min(CASE WHEN symbol IN ('P', 'X') THEN line_no END) OVER q AS first_text,
 max(CASE WHEN symbol = 'B' THEN line_no END) OVER (PARTITION BY doc_id, part ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_blank FROM g WINDOW q AS (PARTITION BY doc_id, part ORDER BY line_no)),
k AS (SELECT *, CASE WHEN symbol = 'H' THEN 'scene_header' WHEN symbol = 'A' THEN 'cue' WHEN symbol = 'B' THEN NULL WHEN anchor = 'A' AND unaccepted = 0 AND (last_blank IS NULL OR last_blank < first_text) THEN 'spoken' ELSE 'action' END AS kind FROM w),
b AS (SELECT *, CASE WHEN kind IN ('scene_header', 'cue') OR kind = 'action' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM 'action' THEN 1 ELSE 0 END AS start FROM k),
n AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM b),
z AS (SELECT doc_id, block_no, arg_min(kind, line_no) AS first_kind, min(line_no)::INT AS line_start, max(line_no)::INT AS line_end, trim(regexp_replace(coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (kind <> 'cue'), ''), '\\s+', ' ', 'g')) AS text, max(CASE WHEN kind = 'cue' THEN line END) AS cue FROM n WHERE kind IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN first_kind = 'cue' THEN 'utterance' ELSE first_kind END AS block_type, concat_ws(' ', cue, text) AS m FROM z),
sc AS (SELECT *, (sum(CASE WHEN block_type = 'scene_header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) + CASE WHEN first_value(block_type) OVER (PARTITION BY doc_id ORDER BY block_no) = 'scene_header' THEN 0 ELSE 1 END)::BIGINT AS scene_index FROM t),
blk AS (SELECT doc_id, printf('blk_%06d', row_number() OVER d) AS block_id, printf('scene_%04d', scene_index) AS scene_id, scene_index, block_type, (sum(CASE WHEN block_type = 'scene_header' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, scene_index ORDER BY block_no))::BIGINT AS sequence_in_scene, line_start, line_end, text, {MARKER_SQL} AS marks, cue AS speaker_cue_raw,
 CASE WHEN block_type = 'utterance' THEN printf('utt_%06d', sum(CASE WHEN block_type = 'utterance' THEN 1 ELSE 0 END) OVER d) END AS utterance_id, CASE WHEN block_type = 'action' THEN printf('act_%06d', sum(CASE WHEN block_type = 'action' THEN 1 ELSE 0 END) OVER d) END AS action_id,
 CASE WHEN block_type = 'utterance' THEN list_filter([CASE WHEN contains(upper(cue), 'CONT''D') OR contains(upper(cue), 'CONT’D') THEN 'contd' END, CASE WHEN contains(upper(cue), 'IN SYNC') THEN 'in_sync' END, CASE WHEN contains(upper(cue), 'OVERLAP') THEN 'overlap' END, CASE WHEN contains(upper(cue), 'PRE-LAP') THEN 'pre_lap' END, CASE WHEN contains(upper(cue), 'V/O') THEN 'voice_over' END], lambda x: x IS NOT NULL) END AS mods
 FROM sc WINDOW d AS (PARTITION BY doc_id ORDER BY block_no))
"""


def script_blocks_of(spark, sf_dir):
    return segment.blocks(script_lines_of(spark, sf_dir))


def _flat(c):
    return F.array_join(c, ",").alias(c)


@query(BLOCKS + "SELECT doc_id, block_id, scene_id, scene_index, block_type, sequence_in_scene, line_start, line_end, text, array_to_string(marks, ',') AS markers, speaker_cue_raw, array_to_string(mods, ',') AS delivery_modifiers, utterance_id, action_id FROM blk")
def script_blocks(spark, sf_dir):
    """The whole reading of scripts: lines to symbols, blocks, scenes, markers and ids."""
    found = script_blocks_of(spark, sf_dir)
    return found.select("doc_id", "block_id", "scene_id", "scene_index", "block_type", "sequence_in_scene", "line_start", "line_end", "text", _flat("markers"), "speaker_cue_raw", _flat("delivery_modifiers"), "utterance_id", "action_id")


@query(BLOCKS + "SELECT doc_id, utterance_id, scene_id, speaker_cue_raw, array_to_string(mods, ',') AS delivery_modifiers, text, line_start, line_end, sequence_in_scene FROM blk WHERE block_type = 'utterance'")
def script_utterances(spark, sf_dir):
    return segment.utterances(script_blocks_of(spark, sf_dir)).drop("speaker_entity_id").withColumn("delivery_modifiers", _flat("delivery_modifiers"))


@query(BLOCKS + "SELECT doc_id, action_id, scene_id, text, line_start, line_end, sequence_in_scene FROM blk WHERE block_type = 'action'")
def script_action_beats(spark, sf_dir):
    return segment.action_beats(script_blocks_of(spark, sf_dir))


TIMES = ", ".join(f"'{t}'" for t in L.TIMES_OF_DAY)
TAIL = rf"regexp_matches(upper(x), '^(19\d{{2}}|20\d{{2}})$') OR upper(x) IN ('FLASHBACK', 'CONTINUED', {TIMES})"
FIELDS = rf"""
raw AS (SELECT *, upper(regexp_extract(trim(header_line), '{HEADER}', 1)) AS header_prefix, trim(regexp_extract(trim(header_line), '{HEADER}', 2)) AS rest FROM heads),
cut AS (SELECT *, list_filter(list_transform(string_split(rest, ' - '), lambda x: trim(x)), lambda x: x <> '') AS parts FROM raw),
run AS (SELECT *, coalesce(list_position(list_transform(list_reverse(parts), lambda x: NOT ({TAIL})), true) - 1, len(parts)) AS taken_n FROM cut),
tk AS (SELECT *, list_transform(parts[len(parts) - taken_n + 1 : len(parts)], lambda x: upper(x)) AS taken, array_to_string(parts[1 : len(parts) - taken_n], ' - ') AS place, regexp_extract(rest, '\b(19\d{{2}}|20\d{{2}})\b', 1) AS inline_year FROM run),
yr AS (SELECT *, list_filter(taken, lambda x: regexp_matches(x, '^\d{{4}}$')) AS years, list_filter(taken, lambda x: x IN ({TIMES})) AS times, coalesce(nullif(place, ''), rest) AS location_raw FROM tk),
fields AS (SELECT *, 'loc_' || {SLUG.format('location_raw')} AS location_canonical_id, times[1] AS time_of_day, try_cast(CASE WHEN len(years) > 0 THEN years[1] ELSE nullif(inline_year, '') END AS INT) AS year_explicit,
 list_filter([CASE WHEN list_contains(taken, 'CONTINUED') THEN 'continued' END, CASE WHEN len(years) > 0 THEN 'explicit_year' END, CASE WHEN len(years) = 0 AND inline_year <> '' THEN 'explicit_year_inline' END, CASE WHEN contains(upper(rest), 'FLASHBACK') THEN 'flashback' END, CASE WHEN header_prefix IN ('INT/EXT.', 'EXT/INT.', 'INT./EXT.', 'EXT./INT.') THEN 'mixed_interior_exterior' END], lambda x: x IS NOT NULL) AS flags FROM yr)
"""
FIELDS_OF_SCENES = """,
heads AS (SELECT doc_id, scene_id, scene_index, min(line_start)::INT AS line_start, max(CASE WHEN block_type = 'scene_header' THEN text END) AS header_line FROM blk GROUP BY 1, 2, 3), """ + FIELDS + """,
sized AS (SELECT doc_id, max(line_no)::INT AS last_line FROM p GROUP BY 1),
scene AS (SELECT doc_id, scene_id, scene_index, coalesce(header_line, 'IMPLICIT PRELUDE (NO SCENE HEADER)') AS header_raw, CASE WHEN header_line IS NULL THEN 'IMPLICIT' ELSE header_prefix END AS header_prefix, CASE WHEN header_line IS NULL THEN 'IMPLICIT PRELUDE' ELSE location_raw END AS location_raw,
 CASE WHEN header_line IS NULL THEN 'loc_implicit_prelude' ELSE location_canonical_id END AS location_canonical_id, CASE WHEN header_line IS NOT NULL THEN time_of_day END AS time_of_day, CASE WHEN header_line IS NOT NULL THEN year_explicit END AS year_explicit, CASE WHEN header_line IS NULL THEN ['synthetic_prelude_scene'] ELSE flags END AS flags,
 line_start, coalesce(lead(line_start) OVER (PARTITION BY doc_id ORDER BY scene_index) - 1, last_line)::INT AS line_end FROM fields JOIN sized USING (doc_id))
"""
SCENES = BLOCKS + FIELDS_OF_SCENES


def script_scenes_of(spark, sf_dir):
    return segment.scenes(script_blocks_of(spark, sf_dir), script_lines_of(spark, sf_dir))


@query(SCENES + "SELECT doc_id, scene_id, scene_index, header_raw, header_prefix, location_raw, location_canonical_id, time_of_day, year_explicit, array_to_string(flags, ',') AS flags, line_start, line_end FROM scene")
def script_scenes(spark, sf_dir):
    return script_scenes_of(spark, sf_dir).drop("year_inferred").withColumn("flags", _flat("flags"))


@query(BLOCKS + rf"""
SELECT doc_id, 'block_type' AS measure, block_type AS name, count(*) AS n FROM blk GROUP BY 1, 3 UNION ALL SELECT doc_id, 'marker', mark, count(*) FROM (SELECT doc_id, unnest(marks) AS mark FROM blk) GROUP BY 1, 3
UNION ALL SELECT doc_id, 'header_prefix', upper(regexp_extract(trim(text), '{HEADER}', 1)), count(*) FROM blk WHERE block_type = 'scene_header' GROUP BY 1, 3
UNION ALL SELECT doc_id, 'empty', 'utterance', count(*) FILTER (block_type = 'utterance' AND text = '') FROM blk GROUP BY 1""")
def script_summary(spark, sf_dir):
    return segment.summary(script_blocks_of(spark, sf_dir))


@query("SELECT doc_id, '# Scripts' || chr(10) || chr(10) || '```text' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || chr(10) || '```' || chr(10) AS text FROM (" + SCRIPT_LINES + ") GROUP BY 1")
def script_markdown(spark, sf_dir):
    """Scripts as markdown, as they are exchanged."""
    return envelope.markdown(script_lines_of(spark, sf_dir), "Scripts")


@query(f"SELECT doc_id, line_no, line FROM ({SCRIPT_LINES})")
def script_fenced_body(spark, sf_dir):
    """Markdown read back: the fenced body has the lines that were written."""
    return cleaning.fenced_body(envelope.markdown(script_lines_of(spark, sf_dir), "Scripts"))


def paged_scripts(spark, sf_dir):
    """A page of two lines for each turn."""
    t = D.table(spark, sf_dir, "conversations")
    page = F.concat(F.lit("## Page "), (F.col("turn") + 1).cast("string"), F.lit("\n\n```text\n"), F.upper("role"), F.lit("\n"), "text", F.lit("\n```\n"))
    rows = F.array_sort(F.collect_list(F.struct("turn", page.alias("page"))))
    return t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("# T\n\n"), F.array_join(F.transform(rows, lambda x: x["page"]), "\n")).alias("text"))


@query("""SELECT conv_id AS doc_id, (turn + 1)::INT AS page, line FROM (SELECT conv_id, turn, unnest(list_concat([upper(role)], string_split(text, chr(10)))) AS line FROM conversations)""")
def page_scan(spark, sf_dir):
    return cleaning.paged_lines(paged_scripts(spark, sf_dir)).select("doc_id", "page", "line")


# Speakers, places and aliases.

CUES = BLOCKS + rf""",
cu AS (SELECT doc_id || ':' || utterance_id AS utterance_id, doc_id || ':' || scene_id AS scene_id, speaker_cue_raw AS raw, upper(trim(regexp_replace(regexp_replace(regexp_replace(speaker_cue_raw, '(?i)\bV/O\b', '', 'g'), '\([^)]*\)', '', 'g'), '\s+', ' ', 'g'))) AS norm FROM blk WHERE block_type = 'utterance'),
ex(alias_raw, by_raw) AS (VALUES ('USER', 'char_seeker')), nm(alias_normalized, by_norm) AS (VALUES ('SYSTEM', 'org_system')),
rc AS (SELECT utterance_id, scene_id, raw, norm, coalesce(by_raw, by_norm, 'char_' || {SLUG.format('norm')}) AS entity_id, CASE WHEN by_raw IS NOT NULL THEN 'manual_exact' WHEN by_norm IS NOT NULL THEN 'manual_normalized' WHEN row_number() OVER (PARTITION BY norm ORDER BY utterance_id) = 1 THEN 'auto_from_cue' ELSE 'normalized_match' END AS alias_kind
 FROM cu LEFT JOIN ex ON raw = alias_raw LEFT JOIN nm ON norm = alias_normalized WHERE norm <> '' AND norm NOT IN ('CUT TO', 'DISSOLVE TO', 'FADE IN', 'FADE OUT') AND NOT starts_with(raw, 'NOISE') AND (by_raw IS NOT NULL OR by_norm IS NOT NULL OR NOT contains(norm, ' AND ') AND NOT contains(norm, '/')))
"""


def keyed(df, *names):
    """Ids made different between scripts."""
    return df.withColumns({n: F.concat_ws(":", F.col("doc_id").cast("string"), n) for n in names})


def script_cues_of(spark, sf_dir):
    said = keyed(segment.utterances(script_blocks_of(spark, sf_dir)), "utterance_id", "scene_id")
    exact = spark.createDataFrame([("USER", "char_seeker")], "alias_raw string, entity_id string")
    normal = spark.createDataFrame([("SYSTEM", "org_system")], "alias_normalized string, entity_id string")
    return entities.resolved_cues(said, exact, normal, {"ignored_cue_prefixes": ["NOISE"]})


@query(CUES + "SELECT utterance_id, scene_id, raw, norm, entity_id, alias_kind FROM rc")
def cue_entities(spark, sf_dir):
    return script_cues_of(spark, sf_dir)


ALIASES = CUES + """,
ar AS (SELECT raw AS alias_raw, entity_id, arg_min(alias_kind, utterance_id) AS alias_kind, min(norm) AS alias_normalized, min(scene_id) AS first_scene_id, count(*) AS n, 0 AS rank FROM rc GROUP BY 1, 2
UNION ALL SELECT norm, entity_id, 'normalized_cue', min(norm), min(scene_id), 0, 1 FROM rc WHERE raw <> norm GROUP BY 1, 2),
al AS (SELECT alias_raw, entity_id, arg_min(alias_kind, rank) AS alias_kind, arg_min(alias_normalized, rank) AS alias_normalized, min(first_scene_id) AS first_scene_id, sum(n)::BIGINT AS count FROM ar GROUP BY 1, 2)
"""


@query(ALIASES + "SELECT *, 'utterance_cue' AS source, printf('ealias_%06d', row_number() OVER (ORDER BY alias_normalized, alias_raw, entity_id)) AS alias_record_id FROM al")
def cue_aliases(spark, sf_dir):
    return entities.alias_ids(entities.alias_records(script_cues_of(spark, sf_dir)))


SEED = [("org_system", "organization", "The System", ["SYS"]), ("char_seeker", "character", "The Seeker", ["SEEKER"]), ("obj_lamp", "object", "Lamp", [])]


def cue_seed(spark):
    return spark.createDataFrame(SEED, "entity_id string, entity_type string, canonical_name string, aliases array<string>")


@query(CUES + """,
seed(entity_id, seed_type, seed_name, seed_aliases) AS (VALUES ('org_system', 'organization', 'The System', ['SYS']), ('char_seeker', 'character', 'The Seeker', ['SEEKER']), ('obj_lamp', 'object', 'Lamp', []::VARCHAR[])),
tl AS (SELECT entity_id, min(scene_id) AS first_scene_id, count(*) AS utterance_count, list(DISTINCT raw) AS cue_aliases, arg_min(norm, utterance_id) AS norm FROM rc GROUP BY 1)
SELECT coalesce(tl.entity_id, seed.entity_id) AS entity_id, coalesce(seed_type, 'character') AS entity_type, coalesce(seed_name, upper(norm[1]) || lower(norm[2:])) AS canonical_name,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(seed_aliases, []), coalesce(cue_aliases, [])))), ',') AS aliases, first_scene_id, coalesce(utterance_count, 0) AS utterance_count FROM tl FULL JOIN seed ON tl.entity_id = seed.entity_id""")
def cue_characters(spark, sf_dir):
    return entities.characters(script_cues_of(spark, sf_dir), cue_seed(spark)).withColumn("aliases", _flat("aliases"))


@query(SCENES + """
SELECT location_canonical_id AS entity_id, arg_min(location_raw, pos) AS canonical_name, min(sid) AS first_scene_id, count(*) AS scene_count, array_to_string(list_sort(list(DISTINCT header_prefix)), ',') AS header_prefixes, array_to_string(list_sort(list(DISTINCT location_raw))[1:5], ',') AS scene_location_examples
FROM (SELECT *, doc_id * 10000 + scene_index AS pos, doc_id || ':' || scene_id AS sid FROM scene WHERE NOT list_contains(flags, 'synthetic_prelude_scene')) GROUP BY 1""")
def script_locations(spark, sf_dir):
    placed = keyed(script_scenes_of(spark, sf_dir), "scene_id").withColumn("scene_index", F.col("doc_id") * 10000 + F.col("scene_index"))
    return entities.locations(placed).withColumns({c: F.array_join(c, ",") for c in ("header_prefixes", "scene_location_examples")})


@query(ALIASES + """, seed(entity_id, canonical_name, first_scene_id) AS (VALUES ('org_system', 'The System', NULL), ('char_seeker', 'The Seeker', '0:scene_0000'), ('obj_lamp', 'Lamp', NULL))
SELECT seed.entity_id, canonical_name, coalesce(seed.first_scene_id, min(al.first_scene_id)) AS first_scene_id FROM seed LEFT JOIN al USING (entity_id) GROUP BY seed.entity_id, canonical_name, seed.first_scene_id""")
def first_scenes_backfilled(spark, sf_dir):
    seed = cue_seed(spark).select("entity_id", "canonical_name", F.when(F.col("entity_id") == "char_seeker", F.lit("0:scene_0000")).alias("first_scene_id"))
    return entities.backfilled(seed, entities.alias_records(script_cues_of(spark, sf_dir)))


@query("SELECT c_custkey, trim(regexp_replace(replace(replace(upper(c_mktsegment || ' v/o (x) o''neil’s'), '’', ''''), '‘', ''''), '\\bV/O\\b|\\([^)]*\\)', '', 'g')) AS n0, 'char_' || " + SLUG.format("replace(c_name || ' ’s', '’', '''')") + " AS made FROM customer")
def alias_normal_forms(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.trim(F.regexp_replace(F.upper(T.straight_both(F.concat("c_mktsegment", F.lit(" v/o (x) o'neil’s")))), r"\bV/O\b|\([^)]*\)", "")).alias("n0"), F.concat(F.lit("char_"), T.entity_slug(F.concat("c_name", F.lit(" ’s")))).alias("made"))


PHRASES = [("p1", "of the"), ("p2", "the"), ("p3", "und"), ("p1", "que"), ("p4", "de la"), ("p2", "the in"), ("p5", "for"), ("p6", "x")]
PHRASES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in PHRASES)
MATCHES = f"""
WITH ph(entity_id, name) AS (VALUES {PHRASES_SQL}), d AS (SELECT doc_id, lower(replace(text, '’', '''')) AS x FROM documents),
m AS (SELECT doc_id, entity_id, name, regexp_extract(x, '(?s)^(.*?(?:^|[^a-z0-9]))' || name || '(?:$|[^a-z0-9])', 1) AS lead_in, regexp_matches(x, '(^|[^a-z0-9])' || name || '($|[^a-z0-9])') AS there FROM d, ph),
f AS (SELECT doc_id, entity_id, length(lead_in) AS start, length(lead_in) + length(name) AS stop FROM m WHERE there)
"""


@query(MATCHES + "SELECT doc_id, entity_id, arg_min(start, start * 1000 - stop)::INT AS start, arg_min(stop, start * 1000 - stop)::INT AS stop FROM f GROUP BY 1, 2")
def phrase_spans(spark, sf_dir):
    """Where each entity is first named in each document, by whole words."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = spark.createDataFrame(PHRASES, "entity_id string, name string")
    return spans.first_of_entity(spans.phrase_matches(docs, names, key="doc_id", text="text", phrase="name"), "doc_id")


# Events and their roll-ups.


def placed_events(spark, sf_dir):
    found, days = trace_tables(spark, sf_dir)
    return found.withColumns({"evidence_ref": F.concat(F.lit("evref_"), "event_id"), "evidence_refs": F.array(F.concat(F.lit("evref_"), "event_id")), "confidence": F.lit(0.5)}), days


@query("SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS scene_id, 'user_' || user_id AS entity_id, 'actor' AS role, 1::INT AS participant_index, 'evref_' || event_id AS ref FROM events")
def event_bridge(spark, sf_dir):
    found, _ = placed_events(spark, sf_dir)
    return events.bridge(found).select("event_id", "scene_id", "entity_id", "role", "participant_index", F.element_at("evidence_refs", 1).alias("ref"))


@query(f"""WITH e AS ({DAY}) SELECT scene_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS event_ids, count(*) AS event_count, array_to_string(list_sort(list(DISTINCT 'user_' || user_id)), ',') AS participant_entity_ids,
 'event=' || count(*) AS l1, any_value(l2) AS l2 FROM e JOIN (SELECT scene_id, string_agg(label || '=' || n, ',' ORDER BY label) AS l2 FROM (SELECT scene_id, label, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1) USING (scene_id) GROUP BY scene_id""")
def scene_rollups(spark, sf_dir):
    found, _ = placed_events(spark, sf_dir)
    counts = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return events.scene_rollup(found).select("scene_id", _flat("event_ids"), "event_count", _flat("participant_entity_ids"), counts("event_type_l1_counts").alias("l1"), counts("event_type_l2_counts").alias("l2"))


@query(f"SELECT printf('te_%06d', row_number() OVER (ORDER BY position, relation)) AS temporal_edge_id, from_event, to_event, relation FROM (SELECT r.*, pos AS position FROM ({RELATIONS} SELECT * FROM r WHERE to_event IS NOT NULL) r JOIN (SELECT event_id, row_number() OVER (ORDER BY scene_id, ts, event_id) AS pos FROM ({DAY})) ON event_id = from_event)")
def temporal_numbers(spark, sf_dir):
    """Temporal edges with ids in order: numbers over all edges without a window over all of them."""
    found = graph.temporal_edges(day_positions(spark, sf_dir), enters="error", returns="signup")
    return graph.numbered_temporal(found).select("temporal_edge_id", "from_event", "to_event", "relation")


# The graph.


@query(f"""WITH e AS ({EDGES}), n AS (SELECT entity_id FROM ({ENTITIES}) WHERE entity_id NOT LIKE '%7'), k AS (SELECT edge_id FROM e WHERE subject_id IN (SELECT entity_id FROM n) AND object_id IN (SELECT entity_id FROM n))
SELECT edge_id, edge_id IN (SELECT edge_id FROM k) AS kept FROM e""")
def manual_edges(spark, sf_dir):
    """Edges with both ends known, and those that are skipped."""
    known = D.entities(spark, sf_dir).where(~F.col("entity_id").endswith("7"))
    kept, skipped = graph.manual_edges(D.edges(spark, sf_dir), known)
    return kept.select("edge_id", F.lit(True).alias("kept")).unionByName(skipped.select("edge_id", F.lit(False).alias("kept")))


@query("""WITH r AS (SELECT DISTINCT o_custkey AS s, l_suppkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT a.e AS x, b.e AS y, count(*) AS n, list_sort(list(a.s))[1:8] AS ids FROM r a JOIN r b ON a.s = b.s AND a.e < b.e WHERE NOT (b.e = a.e + 1) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT x AS subject_id, 'co_present_dialogue' AS predicate, y AS object_id, n AS cooccurrence_scene_count, array_to_string(list_transform(ids, lambda i: 'scene:' || i), ',') AS evidence_refs FROM p ORDER BY n DESC, x, y LIMIT 120""")
def co_presence(spark, sf_dir):
    """Suppliers that serve the same customers, by the library's own derived edges; neighbours in number are known already."""
    li, o = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "orders")
    roster = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("scene_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    s = D.table(spark, sf_dir, "supplier")
    known = s.select((F.col("s_suppkey") + 1).alias("subject_id"), F.lit("associated_with").alias("predicate"), F.col("s_suppkey").alias("object_id"))
    found = graph.co_presence_edges(roster, known)
    return found.select("subject_id", "predicate", "object_id", "cooccurrence_scene_count", _flat("evidence_refs"))


@query(f"SELECT printf('kg_%05d', row_number() OVER (ORDER BY subject_id, predicate, object_id)) AS kg_id, subject_id, predicate, object_id FROM ({EDGES})")
def edge_numbers(spark, sf_dir):
    made = D.edges(spark, sf_dir).drop("edge_id").withColumn("generation_method", F.lit("manual"))
    return graph.numbered_edges(made).select(F.col("edge_id").alias("kg_id"), "subject_id", "predicate", "object_id")


@query(CUES + "SELECT DISTINCT scene_id, entity_id FROM rc WHERE raw IN ('USER', 'ASSISTANT') AND entity_id LIKE 'char_%'")
def speakers_in_scenes(spark, sf_dir):
    said = keyed(segment.utterances(script_blocks_of(spark, sf_dir)), "scene_id")
    raw = spark.createDataFrame([("USER", "char_seeker"), ("ASSISTANT", "char_assistant"), ("SYSTEM", "org_system")], "alias_raw string, entity_id string")
    people = spark.createDataFrame([("char_seeker", "character"), ("char_assistant", "character"), ("org_system", "organization")], "entity_id string, entity_type string")
    return graph.speaker_roster(said, raw, people)


# Searches and facets over state changes.

PEOPLE = "(SELECT 'u' || i AS entity_id, 'User ' || i AS canonical_name FROM range(0, 8) t(i))"


def people(spark):
    return spark.range(8).select(F.concat(F.lit("u"), "id").alias("entity_id"), F.lit("character").alias("entity_type"), F.concat(F.lit("User "), "id").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))


@query(CHANGES + f", pr AS (SELECT least(s, o) AS a, greatest(s, o) AS b, count(*) AS n FROM sc WHERE s <> o GROUP BY 1, 2) SELECT a || '::' || b AS pair, n, coalesce(x.canonical_name, a) || ' <> ' || coalesce(y.canonical_name, b) AS label FROM pr LEFT JOIN {PEOPLE} x ON a = x.entity_id LEFT JOIN {PEOPLE} y ON b = y.entity_id")
def change_pair_options(spark, sf_dir):
    return search.pair_options(changes(spark, sf_dir), people(spark))


@query(CHANGES + f""", e2 AS ({DAY}) SELECT DISTINCT facet, value FROM (SELECT 'year' AS facet, scene_id[1:4] AS value FROM e2 UNION ALL SELECT 'event_type_l2', label FROM e2 UNION ALL SELECT 'event_type_l1', 'event' FROM e2 UNION ALL SELECT 'state_dimension', dim FROM sc UNION ALL SELECT 'entity', entity_id FROM {PEOPLE} UNION ALL SELECT 'scene', scene_id FROM e2)""")
def facet_values(spark, sf_dir):
    found, days = trace_tables(spark, sf_dir)
    return search.facet_options(found, days, changes(spark, sf_dir), people(spark))


@query(f"WITH e AS ({DAY}) SELECT facet, value, count(*) AS n FROM (SELECT 'event_type_l1' AS facet, 'event' AS value FROM e UNION ALL SELECT 'event_type_l2', label FROM e UNION ALL SELECT 'scene_id', scene_id FROM e) GROUP BY 1, 2")
def kind_and_scene_counts(spark, sf_dir):
    return search.event_counts(trace_tables(spark, sf_dir)[0])


@query(CHANGES + """, ev AS (SELECT scene_id, count(*) AS events FROM e WHERE a = 'u3' GROUP BY 1), ch AS (SELECT scene_id, count(*) AS changes FROM sc WHERE s = 'u3' OR o = 'u3' GROUP BY 1),
tr AS (SELECT e.scene_id, count(DISTINCT (sc.scene_id, s, o, dim, dir, claim)) AS triggered FROM sc, e WHERE (s = 'u3' OR o = 'u3') AND list_contains(string_split(trigger_event_ids, ','), event_id::VARCHAR) AND a = 'u3' GROUP BY 1)
SELECT coalesce(ev.scene_id, ch.scene_id) AS scene_id, coalesce(events, 0) AS events, coalesce(changes, 0) AS changes, coalesce(triggered, 0) AS triggered FROM ev FULL JOIN ch ON ev.scene_id = ch.scene_id LEFT JOIN tr ON tr.scene_id = coalesce(ev.scene_id, ch.scene_id)""")
def focus_review(spark, sf_dir):
    """What happens to one person, scene by scene."""
    e = D.day_events(spark, sf_dir)
    person = F.struct(F.concat(F.lit("u"), F.col("user_id") % 10).alias("entity_id"), F.lit("actor").alias("role"))
    own = e.select(F.col("event_id").alias("event_id"), "scene_id", F.array(person).alias("participants"))
    days = e.select("scene_id").distinct().withColumn("scene_index", F.col("scene_id"))
    return search.focus_review(own, states.numbered_changes(changes(spark, sf_dir)), days, "u3").select("scene_id", "events", "changes", "triggered")


@query(SCENES + ", tb AS (SELECT doc_id || ':' || scene_id AS sid, block_id, block_type, row_number() OVER (PARTITION BY doc_id, scene_id ORDER BY sequence_in_scene, block_id) AS k FROM blk) SELECT sid AS scene_id, string_agg(block_id || ' ' || block_type, ',' ORDER BY k) FILTER (k <= 3) AS blocks FROM tb GROUP BY 1")
def timeline_blocks(spark, sf_dir):
    """Scenes with their first three blocks."""
    found = keyed(script_blocks_of(spark, sf_dir), "scene_id")
    told = search.with_blocks_of(found.select("scene_id").distinct(), found, most=3)
    return told.select("scene_id", F.array_join(F.transform("blocks", lambda b: F.concat_ws(" ", b["block_id"], b["block_type"])), ",").alias("blocks"))


@query("WITH e AS (SELECT event_id, round(least(value / 100, 1.0), 2) AS confidence, event_type FROM events), f AS (SELECT * FROM e WHERE confidence < 0.1 OR event_type = 'error') SELECT event_id, confidence, (SELECT count(*) FROM f) AS filtered FROM f ORDER BY confidence, event_id LIMIT 50")
def events_for_review(spark, sf_dir):
    e = D.day_events(spark, sf_dir).select("event_id", F.round(F.least(F.col("value") / 100, F.lit(1.0)), 2).alias("confidence"), F.col("label").alias("event_type_l2"))
    return search.for_review(e, below=0.1, labels=("error",)).select("event_id", "confidence", "filtered")


@query(f"WITH a AS ({TURNS_ASKED}) SELECT query_id FROM a WHERE contains(lower(question), 'the')")
def fixtures_found(spark, sf_dir):
    return search.fixture_search(turns_asked(spark, sf_dir), "the", ("query_id", "question")).select("query_id")


@query("SELECT vec_id::VARCHAR AS item_id, scene_id, scene_number FROM (SELECT vec_id, CASE WHEN label = 0 THEN 'none' ELSE 'scene_' || (vec_id % 97) END AS scene_id, CASE WHEN label = 0 THEN NULL ELSE (vec_id % 97)::INT END AS scene_number FROM embeddings) ORDER BY scene_number NULLS LAST, vec_id::VARCHAR LIMIT 12")
def storyboard(spark, sf_dir):
    items = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.when(F.col("label") == 0, "none").otherwise(F.concat(F.lit("scene_"), F.col("vec_id") % 97)).alias("scene_id"))
    return search.storyboard(items).select("item_id", "scene_id", "scene_number")


# Answers.

TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"
ASKED = "What did the user say about the error in room 3?"


@query(BLOCKS + f""", qq AS (SELECT {TOKENS.format("'" + ASKED + "'")} AS w),
cc AS (SELECT 'event' AS source, event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d') AS scene_id, event_type || ' ' || trim(event_type || ' ' || props || chr(10) || props) AS x FROM events
UNION ALL SELECT 'script_block', doc_id || ':' || block_id, doc_id || ':' || scene_id, block_type || ' ' || text FROM blk),
ss AS (SELECT source, id, scene_id, len(list_filter({TOKENS.format('x')}, lambda t: list_contains(w, t))) + CASE WHEN contains(lower(x), lower('{ASKED}')) THEN 2 ELSE 0 END AS score FROM cc, qq)
SELECT source, id, scene_id, score::INT AS score FROM ss WHERE score > 0 ORDER BY score DESC, scene_id, id LIMIT 6""")
def retrieved(spark, sf_dir):
    """The retrieval baseline's best pieces of events and script blocks."""
    found, days = placed_events(spark, sf_dir)
    blocks = keyed(script_blocks_of(spark, sf_dir), "block_id", "scene_id")
    none = states.numbered_changes(changes(spark, sf_dir).limit(0)).withColumn("evidence_refs", F.array().cast("array<string>"))
    n = answers.Narrative(people(spark), None, None, found, days, none, None, blocks)
    return answers.retrieval(n, ASKED, []).select("source", "id", "scene_id", "score")


@query("""WITH a(place, id) AS (VALUES (0, '5'), (1, '17'), (2, 'nowhere')), r(place, id) AS (VALUES (0, 'evref_5'), (1, 'evref_999999999'), (2, 'evref_17'))
SELECT 'event' AS kind, id, strftime(ts, '%Y-%m-%d') AS scene_id, props AS snippet FROM a JOIN events ON event_id::VARCHAR = id UNION ALL SELECT 'raw_ref', id, NULL, NULL FROM r WHERE id NOT IN ('evref_5', 'evref_17')""")
def evidence_lookup(spark, sf_dir):
    found, days = placed_events(spark, sf_dir)
    blocks = keyed(script_blocks_of(spark, sf_dir), "block_id", "scene_id")
    n = answers.Narrative(people(spark), None, None, found, days, states.numbered_changes(changes(spark, sf_dir)), None, blocks)
    return answers.evidence(n, ["5", "17", "nowhere"], [], ["evref_5", "evref_999999999", "evref_17"]).select("kind", "id", "scene_id", "snippet")


@query(f"""WITH c AS ({ENTITIES}),
n AS (SELECT entity_id, canonical_name AS phrase, 100 AS priority FROM c UNION ALL SELECT entity_id, 'the ' || alias, 80 FROM c WHERE entity_type = 'location' UNION ALL SELECT entity_id, 'the ' || alias, 75 FROM c WHERE entity_type = 'location'
UNION ALL SELECT 'reg_0', 'cape', 90 UNION ALL SELECT any_value(entity_id), last, 70 FROM (SELECT entity_id, string_split(lower(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g'))), ' ') AS w, w[-1] AS last FROM c WHERE entity_type = 'character') WHERE len(w) >= 2 AND length(last) >= 4 GROUP BY last HAVING count(*) = 1)
SELECT DISTINCT entity_id, lower(trim(regexp_replace(phrase, '\\s+', ' ', 'g'))) AS phrase, priority FROM n WHERE length(trim(phrase)) >= 3""")
def lexicon_phrases(spark, sf_dir):
    """What names an entity in a question: names, hand-made aliases, hints, last names that one person has."""
    known = D.entities(spark, sf_dir)
    places = known.where("entity_type = 'location'")
    phrase = F.concat(F.lit("the "), F.element_at("aliases", 1))
    aliases = places.select("entity_id", phrase.alias("alias_raw"), phrase.alias("alias_normalized"), F.lit("manual_alias").alias("source"))
    return answers.lexicon(known, aliases, hints=(("reg_0", "cape"), ("reg_99", "nowhere"))).select("entity_id", "phrase", "priority")


@query(f"""WITH a AS ({TURNS_ASKED}), w AS (SELECT query_id, lower(trim(question)) AS q FROM a)
SELECT query_id, regexp_matches(q, '\\bwho\\b') AS has_who, regexp_matches(q, '\\bwhen\\b') AS has_when, regexp_matches(q, '\\bwhy\\b') AS has_why, contains(q, 'rag') AS mentions_rag, contains(q, 'relationship') OR contains(q, 'connected to') OR contains(q, 'connected with') AS mentions_relationship, contains(q, 'sequence') OR contains(q, 'in order') OR contains(q, 'chronolog') OR contains(q, 'timeline') AS mentions_sequence FROM w""")
def question_signals(spark, sf_dir):
    told = turns_asked(spark, sf_dir).select("query_id", router.signals(F.col("question")).alias("s"))
    return told.select("query_id", *(f"s.{c}" for c in ("has_who", "has_when", "has_why", "mentions_rag", "mentions_relationship", "mentions_sequence")))


# Quality of scripts.


@query(SCENES + "SELECT b.doc_id || ':' || b.block_id AS block_id FROM blk b JOIN scene s ON b.doc_id = s.doc_id AND b.scene_id = s.scene_id WHERE b.line_start < s.line_start + 1 OR b.line_end > s.line_end")
def blocks_outside(spark, sf_dir):
    """Blocks that reach beyond their scenes' lines, header lines not counted as the scenes'."""
    inner = keyed(script_blocks_of(spark, sf_dir), "block_id", "scene_id")
    outer = keyed(script_scenes_of(spark, sf_dir), "scene_id").withColumn("line_start", F.col("line_start") + 1)
    return quality.outside(inner, outer, key="scene_id").select("block_id")


@query("WITH t AS (SELECT doc_id, n_chars FROM documents), u AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS n FROM documents) SELECT doc_id, n_chars, n AS other FROM t JOIN u USING (doc_id) WHERE n_chars IS DISTINCT FROM n")
def counts_that_disagree(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    other = docs.select("doc_id", (F.length("text") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)).cast("long").alias("n_chars"))
    return quality.disagreements(docs, other, key="doc_id", column="n_chars")


@query("WITH a AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS key, a.n AS expected, b.n AS actual FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def counts_reconciled(spark, sf_dir):
    count = lambda t, c: D.table(spark, sf_dir, t).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    return quality.reconciled(count("orders", "o_orderstatus"), count("lineitem", "l_linestatus"), key="k", value="n")


GOLD = [
    {"check_id": "g1", "kind": "manifest_summary_equals", "path": "block_type.utterance", "expected": 1},
    {"check_id": "g2", "kind": "scene_field_equals", "scene_id": "1:scene_0001", "field": "header_raw", "expected": "IMPLICIT PRELUDE (NO SCENE HEADER)"},
    {"check_id": "g3", "kind": "scene_field_contains", "scene_id": "1:scene_0001", "field": "flags", "expected": "synthetic_prelude_scene"},
    {"check_id": "g4", "kind": "utterance_count_by_cue", "speaker_cue_raw": "USER", "expected": 3},
    {"check_id": "g5", "kind": "utterance_modifier_contains", "utterance_id": "1:utt_000001", "expected": "voice_over"},
    {"check_id": "g6", "kind": "script_block_field_equals", "block_id": "1:blk_000001", "field": "block_type", "expected": "utterance"},
    {"check_id": "g7", "kind": "script_block_marker_contains", "block_id": "1:blk_000001", "expected": "voice_over"},
]


@query(SCENES + """
SELECT 'g1' AS check_id, (SELECT count(*) FROM blk WHERE block_type = 'utterance') = 1 AS passed UNION ALL SELECT 'g2', coalesce((SELECT header_raw FROM scene WHERE doc_id = 1 AND scene_id = 'scene_0001') = 'IMPLICIT PRELUDE (NO SCENE HEADER)', false)
UNION ALL SELECT 'g3', coalesce((SELECT list_contains(flags, 'synthetic_prelude_scene') FROM scene WHERE doc_id = 1 AND scene_id = 'scene_0001'), false) UNION ALL SELECT 'g4', (SELECT count(*) FROM blk WHERE speaker_cue_raw = 'USER') = 3
UNION ALL SELECT 'g5', coalesce((SELECT list_contains(mods, 'voice_over') FROM blk WHERE doc_id = 1 AND utterance_id = 'utt_000001'), false) UNION ALL SELECT 'g6', coalesce((SELECT block_type FROM blk WHERE doc_id = 1 AND block_id = 'blk_000001') = 'utterance', false)
UNION ALL SELECT 'g7', coalesce((SELECT list_contains(marks, 'voice_over') FROM blk WHERE doc_id = 1 AND block_id = 'blk_000001'), false)""")
def gold_checks_of_scripts(spark, sf_dir):
    """All kinds of gold checks against the facts of the scripts."""
    blocks = script_blocks_of(spark, sf_dir)
    facts = quality.script_facts(keyed(script_scenes_of(spark, sf_dir), "scene_id"), keyed(blocks, "block_id", "utterance_id", "scene_id"), segment.summary(blocks))
    return quality.gold_checks(quality.gold_table(spark, GOLD), facts).select("check_id", "passed")


@query("SELECT 'one' AS phase, 'orders' AS artifact, (SELECT count(*) FROM orders) AS rows, 'o_nothing' AS missing, false AS ok UNION ALL SELECT 'one', 'region', (SELECT count(*) FROM region), '', true UNION ALL SELECT 'two', 'absent', 0, 'a,b', false")
def artifacts_by_phase(spark, sf_dir):
    t = {n: D.table(spark, sf_dir, n) for n in ("orders", "region")}
    return quality.phases(spark, t, {"one": {"orders": ("o_orderkey", "o_nothing"), "region": ("r_name",)}, "two": {"absent": ("a", "b")}})


@query("""WITH e AS (SELECT conv_id || ':' || turn AS query_id, 'fact' AS t, CASE WHEN turn % 2 = 0 THEN 'kg' ELSE 'ntg' END AS m FROM conversations UNION ALL SELECT conv_id || ':none', 'fact', 'kg' FROM conversations GROUP BY conv_id), r AS (@ROUTED@)
SELECT e.query_id, coalesce(t = query_type, false) AS type_ok, coalesce(m = mode_used, false) AS mode_ok, coalesce(t = query_type AND m = mode_used, false) AS passed FROM e LEFT JOIN r ON r.query_id = e.query_id""".replace("@ROUTED@", ORACLES["route_questions"]))
def router_smoke(spark, sf_dir):
    """Routed turns against what is expected of them: half of the modes wrong and one turn of each conversation absent on purpose."""
    t = D.table(spark, sf_dir, "conversations")
    own = t.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.lit("fact").alias("query_type_expected"), F.when(F.col("turn") % 2 == 0, "kg").otherwise("ntg").alias("mode_expected"))
    absent = t.select(F.concat_ws(":", "conv_id", F.lit("none")).alias("query_id"), F.lit("fact").alias("query_type_expected"), F.lit("kg").alias("mode_expected")).distinct()
    return quality.smoke(own.unionByName(absent), router.routed(turns_asked(spark, sf_dir)))


@query("""WITH e AS (SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d') AS scene_id, event_type FROM events)
SELECT 'event' AS kind, id, scene_id, '/trace?focus=evidence&eventId=' || id || '&sceneId=' || scene_id AS trace_href, '/timeline?q=' || id AS timeline_href, 'event,event,' || event_type AS tags FROM e
UNION ALL SELECT 'raw_ref', 'turn ' || conv_id || ':' || turn || ' & more', NULL, '/trace?focus=evidence&q=turn+' || conv_id || '%3A' || turn || '+%26+more', '/timeline?q=turn+' || conv_id || '%3A' || turn || '+%26+more', 'raw_ref' FROM conversations
UNION ALL SELECT 'scene_ref', 'scene:' || scene_id, scene_id, '/trace?focus=evidence&sceneId=' || scene_id, '/timeline?q=' || scene_id, 'scene_ref' FROM (SELECT DISTINCT scene_id FROM e)""")
def evidence_links(spark, sf_dir):
    """Where a reader finds each event, day and turn, and what it is."""
    found, days = placed_events(spark, sf_dir)
    refs = D.table(spark, sf_dir, "conversations").select(F.lit("raw_ref").alias("kind"), F.concat(F.lit("turn "), F.concat_ws(":", "conv_id", "turn"), F.lit(" & more")).alias("id"), F.lit(None).cast("string").alias("scene_id"))
    scenes = days.select(F.lit("scene_ref").alias("kind"), F.concat(F.lit("scene:"), "scene_id").alias("id"), "scene_id")
    every = found.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "scene_id").unionByName(refs).unionByName(scenes)
    n = answers.Narrative(people(spark), None, None, found, days, states.numbered_changes(changes(spark, sf_dir)), None, None)
    return answers.with_links(every, n).withColumn("tags", F.array_join("tags", ","))


# Artifacts on disk.


def _folder(spark):
    return f"{envelope.scratch(spark)}/{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def envelope_of_any_size(spark, sf_dir):
    """Orders written as an envelope's folder and read back whole."""
    at = _folder(spark)
    envelope.write_envelope(D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), at, "orders", "1.0")
    return envelope.read_written(spark, at, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT n_nationkey, n_name FROM nation")
def envelope_document(spark, sf_dir):
    """Nations written as one JSON document and read back by the reader of such documents."""
    at = _folder(spark)
    envelope.write_file(D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at, "nations", "1.0")
    return envelope.read_items(spark, at, "n_nationkey int, n_name string")


@query("SELECT 25::BIGINT AS n, 1::INT AS starts_with_key FROM nation LIMIT 1")
def envelope_preview(spark, sf_dir):
    told = envelope.preview(D.table(spark, sf_dir, "nation"))
    return told.select("n", F.col("first").startswith('{"n_nationkey"').cast("int").alias("starts_with_key"))
