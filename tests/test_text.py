from pyspark.sql import functions as F

from plotweave.functions import lines as L
from plotweave.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_slugs_and_ids(spark):
    assert one(spark, T.slug, "Frank's  House!") == "frank_s_house"
    assert one(spark, T.slug, "***") == "unknown"
    assert one(spark, T.entity_slug, "Frank’s") == "frank_s"
    assert spark.range(1).select(T.numbered_id("evt", F.lit(7))).first()[0] == "evt_000007"


def test_truncate_squeezes_and_cuts(spark):
    assert one(spark, lambda c: T.truncate(c, 10), " a  b\n c ") == "a b c"
    assert one(spark, lambda c: T.truncate(c, 10), "abcdef ghijkl") == "abcdef..."


def test_tokens_and_overlap(spark):
    assert one(spark, T.tokens, "It's a Test, a test!") == ["it's", "test", "test"]
    assert one(spark, lambda c: T.overlap_score(F.lit("the test"), c), "The Test of the rest") == 3 + 2
    assert one(spark, lambda c: T.overlap_score(F.lit("zebra"), c), "The Test") == 0


def test_pair_keys(spark):
    row = spark.range(1).select(T.directed_pair(F.lit("b"), F.lit("a")), T.undirected_pair(F.lit("b"), F.lit("a")), T.pair_key(F.lit("b"), F.lit("a"))).first()
    assert tuple(row) == ("b->a", "a<->b", "a::b")


def test_markers_cues_and_aliases(spark):
    assert one(spark, T.markers, "FRANK V/O (CONT’D) back to the FLASHBACK") == ["back_to", "contd", "flashback", "voice_over"]
    assert one(spark, T.cue_modifiers, "FRANK V/O (CONT'D) (IN SYNC)") == ["contd", "in_sync", "voice_over"]
    assert one(spark, T.cue_base, "FRANK V/O (CONT'D)") == "FRANK"
    assert one(spark, T.alias_normal, "Jimmy’s  wife (o.s.) PRE-LAP") == "JIMMY'S WIFE"


def test_display_name(spark):
    assert one(spark, T.display_name, "FBI AGENT J. SMITH III") == "FBI Agent J. Smith III"


def test_ordered_distinct_keeps_text_whole(spark):
    df = spark.createDataFrame([([" e1", "e3", "", "e1", None],)], "x array<string>")
    assert df.select(T.ordered_distinct("x")).first()[0] == ["e1", "e3"]


def test_lenient_casts_and_year(spark):
    assert one(spark, lambda c: T.lenient_int(c, 5), "x7") == 5
    assert one(spark, T.lenient_double, "2.5") == 2.5
    assert one(spark, T.year_in, "in 1975 and 2001") == 1975
    assert one(spark, T.year_in, "12345") is None


def test_line_predicates(spark):
    assert one(spark, L.is_header, " int./ext. CAR - DAY")
    assert not one(spark, L.is_header, "INTERIOR")
    assert one(spark, L.is_probable_cue, "FRANK V/O (CONT'D)")
    for line in ("Frank", "FRANK: HELLO", "INT. HOUSE", "(QUIETLY)", "FINAL SCRIPT", "CUT TO BLACK", "# TITLE", "A - B", "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE"):
        assert not one(spark, L.is_probable_cue, line), line
    assert one(spark, L.looks_spoken, "NO!") and not one(spark, L.looks_spoken, "A LONG LINE OF SHOUTED WORDS")


def test_header_fields(spark):
    f = one(spark, L.header_fields, "INT/EXT. FRANK'S HOUSE - KITCHEN - NIGHT - FLASHBACK - 1975")
    assert (f["header_prefix"], f["location_raw"], f["location_canonical_id"], f["time_of_day"], f["year_explicit"]) == ("INT/EXT.", "FRANK'S HOUSE - KITCHEN", "loc_frank_s_house_kitchen", "NIGHT", 1975)
    assert f["flags"] == ["explicit_year", "flashback", "mixed_interior_exterior"]
    f = one(spark, L.header_fields, "EXT. DINER IN 1962 - DAY")
    assert f["year_explicit"] == 1962 and f["flags"] == ["explicit_year_inline"] and f["location_raw"] == "DINER IN 1962"
    f = one(spark, L.header_fields, "EXT. DAY")
    assert f["location_raw"] == "DAY" and f["time_of_day"] == "DAY"


def test_page_lines(spark):
    page = F.lit(7)
    assert one(spark, lambda c: L.page_lines(c, page), "(MORE) 7") == []
    assert one(spark, lambda c: L.page_lines(c, page), "12") == []
    assert one(spark, lambda c: L.page_lines(c, page), "") == [""]
    assert one(spark, lambda c: L.page_lines(c, page), "10FRANK") == ["FRANK"]
    assert one(spark, lambda c: L.page_lines(c, page), "He walks to the door slowly 7") == ["He walks to the door slowly"]
    assert one(spark, lambda c: L.page_lines(c, page), "He walks to the door slowly 9") == ["He walks to the door slowly 9"]
    assert one(spark, lambda c: L.page_lines(c, page), "I told him so. RUSSELL") == ["I told him so.", "RUSSELL"]
    assert one(spark, L.without_page_number, "No. 12") == "No. 12" and one(spark, L.without_page_number, "the end. 12") == "the end."


def test_words_end_at_letters_beyond_ascii(spark):
    from plotweave.operators import router, rules

    assert [one(spark, lambda c: rules.Words(c).word("no|ok"), x) for x in ("noñrrezar", "éno", "nox", "x_no", "no")] == [True, True, False, False, True]
    assert one(spark, lambda c: rules.Words(c).opens("hi"), "«hiß") is True
    assert one(spark, T.markers, "ÄV/OÖ flashbacké") == ["flashback", "voice_over"]
    assert one(spark, T.year_in, "ü1975ß") == 1975
    assert one(spark, lambda c: router.signals(c)["has_who"], "whoé") is True


def test_few_phrases_meet_texts_where_they_are(spark, monkeypatch):
    from plotweave.operators import spans

    texts = spark.createDataFrame([(1, "Of the sea, of THE"), (2, None), (3, "owl"), (3, "the owl"), (4, "othe")], "id long, body string")
    names = spark.createDataFrame([("a", "of the"), ("b", "the"), ("c", "the"), ("d", "zebra owl"), ("e", "..."), ("f", None)], "entity_id string, name string")
    found = lambda: spans.phrase_matches(texts, names, key="id", text="body", phrase="name").select("id", "body", "entity_id", "start", "stop")
    few = found()
    assert "_key" not in few._jdf.queryExecution().toString()  # texts are not joined by their keys
    got = sorted(map(tuple, few.collect()))
    assert got == [(1, "Of the sea, of THE", "a", 0, 6), (1, "Of the sea, of THE", "b", 3, 6), (1, "Of the sea, of THE", "c", 3, 6), (3, "the owl", "b", 0, 3), (3, "the owl", "c", 0, 3)]
    monkeypatch.setattr(spans, "FEW_PHRASES", 0)
    assert sorted(map(tuple, found().collect())) == got
