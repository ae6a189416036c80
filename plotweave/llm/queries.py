"""The operators of this subpackage as registered queries: each over its whole tables, with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import audio, collocations, decontaminate, extract, mixing, packing, periodic, preferences, repeats, simhash, tokencount, toxicity, urls
from plotweave.llm.common import table

END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hit_spans")


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = packing.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID)
    return packing.read_documents(spark, at)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mix(table(spark, sf_dir, "documents"))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.search_excerpts(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preferences.swapped_replies(table(spark, sf_dir, "conversations"))
    out = preferences.format_pairs(chosen, rejected)
    return out.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        "prompt",
        "chosen_completion",
        preferences.spans_as_text("chosen_loss_spans").alias("chosen_loss_spans"),
        "rejected_completion",
        preferences.spans_as_text("rejected_loss_spans").alias("rejected_loss_spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, share=50, top=2000)


def repeated_words(key: int | None, text: bytes) -> list[bytes]:
    """The words of a text; for one id in ten, by its CRC-32, those from some word on are made to repeat. A null id changes nothing."""
    words = text.split()
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _, runs, collapsed = periodic.periodic_runs(docs, words=repeated_words)
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = out.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-best.shorter * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2(F.col(collapsed), 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_packing, op3_html_extraction, op4_toxicity, op5_mixing, op6_repeated_windows, op7_audio_fingerprints, op8_simhash, op9_url_filters, op10_preferences, op11_collocations, op12_periodic_runs, op13_token_counts)}
ORACLE_OP1 = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT n FROM win),
cut AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, c.n, i FROM cut c JOIN win ON win.n = c.n AND win.s = c.s),
word AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word_no FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE_OP10 = r"""
WITH last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
pairs AS (SELECT a.conv_id AS pair_id, a.last_turn, b.reply FROM last a JOIN last b ON b.conv_id = a.conv_id + 1),
own AS (SELECT pair_id, turn, role, text AS c, CASE WHEN turn = last_turn AND role = 'assistant' THEN reply ELSE text END AS r FROM conversations JOIN pairs ON conv_id = pair_id WHERE turn <= last_turn),
told AS (SELECT *, min(CASE WHEN c IS NOT DISTINCT FROM r THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY turn) = 1 AS common,
  '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head FROM own),
said AS (SELECT *, head || coalesce(c, '') || '<|im_end|>' || chr(10) AS ct, head || coalesce(r, '') || '<|im_end|>' || chr(10) AS rt FROM told),
placed AS (SELECT *, coalesce(sum(length(ct)) FILTER (NOT common) OVER w, 0) AS cb, coalesce(sum(length(rt)) FILTER (NOT common) OVER w, 0) AS rb FROM said
  WINDOW w AS (PARTITION BY pair_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, count(*) FILTER (common) AS n_prompt_turns,
  coalesce(string_agg(ct, '' ORDER BY turn) FILTER (common), '') AS prompt,
  coalesce(string_agg(ct, '' ORDER BY turn) FILTER (NOT common), '') AS chosen_completion,
  coalesce(string_agg((cb + length(head))::BIGINT || ':' || (length(ct) - length(head) - 1), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS chosen_loss_spans,
  coalesce(string_agg(rt, '' ORDER BY turn) FILTER (NOT common), '') AS rejected_completion,
  coalesce(string_agg((rb + length(head))::BIGINT || ':' || (length(rt) - length(head) - 1), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS rejected_loss_spans
FROM placed GROUP BY pair_id
"""

ORACLE_OP11 = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
gram AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM cut
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM cut
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM cut),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM cand WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM cand WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * c.f),
ways AS (SELECT lang, phrase, f AS a, c, array_to_string(w[1 : c], ' ') AS one, array_to_string(w[c + 1 : k], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (SELECT ways.lang, ways.phrase, a, c, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM ways JOIN f x ON x.lang = ways.lang AND x.phrase = one JOIN f y ON y.lang = ways.lang AND y.phrase = two),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN total USING (lang) WHERE rank <= 2000
"""

#: The other operators hash, learn or walk in ways SQL has no form for; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_decontaminate": ORACLE_OP1, "op10_preferences": ORACLE_OP10, "op11_collocations": ORACLE_OP11}
