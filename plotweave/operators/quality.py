"""Data-quality checks: each gives a table of findings or one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def range_faults(spans: DataFrame, *, group: str, start: str, end: str) -> DataFrame:
    """group, start, end, fault (gap or overlap), reach: spans that do not follow on from the furthest end before them."""
    w = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    told = spans.withColumn("reach", F.max(end).over(w))
    fault = F.when(F.col(start) > F.col("reach") + 1, "gap").when(F.col(start) <= F.col("reach"), "overlap")
    return told.withColumn("fault", fault).where("fault is not null").select(group, F.col(start).alias("start"), F.col(end).alias("end"), "fault", "reach")


def sequence_faults(rows: DataFrame, *, group: str, place: str, first: int = 1) -> DataFrame:
    """Groups whose places are not first, first + 1, ... each once."""
    return rows.groupBy(group).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"), F.countDistinct(place).alias("places")).where((F.col("low") != first) | (F.col("n") != F.col("places")) | (F.col("high") - F.col("low") + 1 != F.col("places")))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """duplicate_keys, surplus_rows and the first few such keys."""
    found = duplicates(rows.where(F.col(key).isNotNull()), key)
    samples = found.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias("samples"))
    return found.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows")).join(samples)


def orphans(rows: DataFrame, parents: DataFrame, *, key: str, parent_key: str) -> DataFrame:
    ids = parents.select(F.col(parent_key).alias("_parent"))
    return rows.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_parent"), "left_anti")


def outside(inner: DataFrame, outer: DataFrame, *, key: str, start: str = "line_start", end: str = "line_end") -> DataFrame:
    """Spans that reach beyond their parent's."""
    whole = outer.select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    return inner.join(whole, F.col(key) == F.col("_key")).where((F.col(start) < F.col("_start")) | (F.col(end) > F.col("_end"))).drop("_key", "_start", "_end")


def disagreements(left: DataFrame, right: DataFrame, *, key: str, column: str) -> DataFrame:
    other = right.select(F.col(key).alias("_key"), F.col(column).alias("_other"))
    return left.join(other, F.col(key) == F.col("_key")).where(~F.col(column).eqNullSafe(F.col("_other"))).select(key, column, F.col("_other").alias("other"))


def check(name: str, failures: DataFrame) -> DataFrame:
    """One row: check_id, passed, failures."""
    n = failures.agg(F.count("*").alias("failures"))
    return n.select(F.lit(name).alias("check_id"), (F.col("failures") == 0).alias("passed"), "failures")


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def check_summary(checks: DataFrame) -> DataFrame:
    total, passed = F.count("*"), F.count_if("passed")
    rate = F.round(F.when(total > 0, passed / total).otherwise(F.lit(0.0)), 4)
    return checks.agg(total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"), rate.alias("pass_rate"))


def reconciled(expected: DataFrame, actual: DataFrame, *, key: str, value: str) -> DataFrame:
    """key, expected, actual where the two counts differ or one is missing."""
    e, a = expected.select(F.col(key).alias("key"), F.col(value).alias("expected")), actual.select(F.col(key).alias("key"), F.col(value).alias("actual"))
    return e.join(a, "key", "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def gold_checks(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """gold (check_id, locator, operation equals/contains, expected) against facts (locator, actual as JSON or text).

    equals compares texts; contains asks whether the JSON array in `actual` has the expected value.
    """
    joined = gold.join(facts, "locator", "left")
    has = F.array_contains(F.from_json("actual", "array<string>"), F.col("expected"))
    ok = F.when(F.col("operation") == "contains", F.coalesce(has, F.lit(False))).otherwise(F.col("actual").eqNullSafe(F.col("expected")))
    return joined.select("check_id", ok.alias("passed"), "expected", "actual")


#: What a gold check may ask (fixed values): how the locator is made, and whether the value is equal or contained.
GOLD_KINDS = {
    "manifest_summary_equals": ("summary:{path}", "equals"),
    "scene_field_equals": ("scene:{scene_id}:{field}", "equals"),
    "scene_field_contains": ("scene:{scene_id}:{field}", "contains"),
    "utterance_count_by_cue": ("cue:{speaker_cue_raw}", "equals"),
    "utterance_modifier_contains": ("utterance:{utterance_id}:delivery_modifiers", "contains"),
    "script_block_field_equals": ("block:{block_id}:{field}", "equals"),
    "script_block_marker_contains": ("block:{block_id}:markers", "contains"),
}


def gold_table(spark: SparkSession, checks: list[dict]) -> DataFrame:
    """Gold checks of the known kinds as rows of `gold_checks`; an unknown kind raises."""
    rows = []
    for c in checks:
        if c["kind"] not in GOLD_KINDS:
            raise ValueError(f"check {c['check_id']} is of an unknown kind: {c['kind']}")
        locator, operation = GOLD_KINDS[c["kind"]]
        rows.append((c["check_id"], locator.format(**c), operation, str(c["expected"])))
    return spark.createDataFrame(rows, "check_id string, locator string, operation string, expected string")


def script_facts(scenes: DataFrame, blocks: DataFrame, summary: DataFrame) -> DataFrame:
    """locator, actual of everything that gold checks can ask about scenes, utterances, blocks and counts."""
    shown = lambda df, c: F.to_json(F.col(c)) if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string")

    def fields(df: DataFrame, kind: str, key: str, names: tuple[str, ...]) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.inline(F.array(*(F.struct(F.concat_ws(":", F.lit(kind), F.col(key), F.lit(n)).alias("locator"), shown(df, n).alias("actual")) for n in names))))

    cues = blocks.where("block_type = 'utterance'").groupBy("speaker_cue_raw").agg(F.count("*").alias("n")).select(F.concat(F.lit("cue:"), "speaker_cue_raw").alias("locator"), F.col("n").cast("string").alias("actual"))
    counts = summary.groupBy("measure", "name").agg(F.sum("n").alias("n")).select(F.concat(F.lit("summary:"), "measure", F.lit("."), "name").alias("locator"), F.col("n").cast("string").alias("actual"))
    parts = (fields(scenes, "scene", "scene_id", ("header_raw", "header_prefix", "location_raw", "time_of_day", "year_explicit", "flags")), fields(blocks, "utterance", "utterance_id", ("delivery_modifiers",)), fields(blocks, "block", "block_id", ("block_type", "sequence_in_scene", "scene_id", "markers")), cues, counts)
    return reduce(lambda a, b: a.unionByName(b), parts)


def phases(spark: SparkSession, tables: dict[str, DataFrame | None], needed: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """phase, artifact, rows, missing (columns), ok: of every phase's artifacts whether they are there, hold rows and have the columns they need."""
    parts = []
    for phase, artifacts in needed.items():
        for name, columns in artifacts.items():
            df = tables.get(name)
            lacks = list(columns) if df is None else missing_columns(df, columns)
            n = spark.range(1).select(F.lit(0).cast("long").alias("rows")) if df is None else df.agg(F.count("*").alias("rows"))
            parts.append(n.select(F.lit(phase).alias("phase"), F.lit(name).alias("artifact"), "rows", F.lit(",".join(lacks)).alias("missing"), ((F.col("rows") > 0) & F.lit(not lacks)).alias("ok")))
    return all_checks(*parts)


def json_path(document: Column | str, dotted: str) -> Column:
    return F.get_json_object(document, "$." + dotted)


def taxonomy_issues(events: DataFrame, types: DataFrame, *, unmapped: str = "unmapped_review_required", most: int = 200) -> DataFrame:
    """issue, event_id, event_type_l1, event_type_l2: unknown kinds, first levels that disagree, kinds for review; up to `most` of each."""
    known = types.select(F.col("event_type_l2").alias("_l2"), F.col("event_type_l1").alias("_l1"))
    told = events.select("event_id", "event_type_l1", "event_type_l2").join(F.broadcast(known), F.col("event_type_l2") == F.col("_l2"), "left")
    issue = F.when(F.col("event_type_l2") == unmapped, "unmapped").when(F.col("_l2").isNull(), "unknown_l2").when(~F.col("event_type_l1").eqNullSafe(F.col("_l1")), "l1_mismatch")
    rows = told.withColumn("issue", issue).where("issue is not null")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("issue").orderBy("event_id")))
    return ranked.where(F.col("place") <= most).select("issue", "event_id", "event_type_l1", "event_type_l2")


def type_coverage(events: DataFrame, types: DataFrame, most: int = 3) -> DataFrame:
    """event_type_l2, n, examples (event ids): every kind of the taxonomy, those without events too."""
    # Counts are summed where the events are; of the events themselves only the first few of each kind are moved.
    ranked = events.withColumn("place", F.row_number().over(Window.partitionBy("event_type_l2").orderBy("event_id"))).where(F.col("place") <= most)
    first = ranked.groupBy(F.col("event_type_l2").alias("_l2")).agg(F.array_sort(F.collect_list("event_id")).alias("examples"))
    seen = events.groupBy(F.col("event_type_l2").alias("_kind")).agg(F.count("*").alias("n")).join(first, F.col("_kind") == F.col("_l2"))
    return types.join(seen, F.col("event_type_l2") == F.col("_l2"), "left").select("event_type_l2", "event_type_l1", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def required_fields(rows: DataFrame, strings: tuple[str, ...] = (), numbers: tuple[str, ...] = (), allowed: dict[str, tuple] | None = None) -> Column:
    """Whether a row is well-formed: no missing or empty text, no missing or infinite number, values among those allowed."""
    tests = [F.col(c).isNotNull() & (F.col(c) != "") for c in strings]
    tests += [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in numbers]
    tests += [F.col(c).isin(*values) for c, values in (allowed or {}).items()]
    return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def missing_columns(rows: DataFrame, needed: tuple[str, ...]) -> list[str]:
    return [c for c in needed if c not in rows.columns]


def smoke(expected: DataFrame, actual: DataFrame, *, key: str = "query_id") -> DataFrame:
    """key, type_ok, mode_ok, passed of routed questions against what is expected of them."""
    a = actual.select(F.col(key).alias("_key"), F.col("query_type"), F.col("mode_used"))
    joined = expected.join(a, F.col(key) == F.col("_key"), "left")
    kind, mode = F.col("query_type").eqNullSafe(F.col("query_type_expected")), F.col("mode_used").eqNullSafe(F.col("mode_expected"))
    return joined.select(key, kind.alias("type_ok"), mode.alias("mode_ok"), (kind & mode).alias("passed"))
