"""What a line of a script is: predicates and header fields as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import BEGINS, ENDS, cue_base, slug

#: Fixed values of the script format.
HEADER = r"(?i)^(INT\.|EXT\.|INT/EXT\.|EXT/INT\.|INT\./EXT\.|EXT\./INT\.)\s+(.+)$"
TIMES_OF_DAY = ("DAY", "NIGHT", "MORNING", "AFTERNOON", "EVENING", "DAWN", "DUSK", "LATER", "CONTINUOUS", "SAME TIME", "MOMENTS LATER", "LATE AFTERNOON", "EARLY MORNING", "SUNSET", "SUNRISE", "THE NEXT DAY")
TRANSITIONS = ("CUT TO", "FADE IN", "FADE OUT", "DISSOLVE TO", "MATCH CUT", "SMASH CUT")
NOT_CUES = ("FINAL", "SCRIPT", "SCREENPLAY", "SHOOTING")
MIXED_PREFIXES = ("INT/EXT.", "EXT/INT.", "INT./EXT.", "EXT./INT.")


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))


def is_header(c: Column) -> Column:
    return F.trim(c).rlike(HEADER)


def is_parenthetical(c: Column) -> Column:
    s = F.trim(c)
    return (F.length(s) >= 2) & s.startswith("(") & s.endswith(")")


def is_mostly_upper(c: Column) -> Column:
    """At least nine tenths of the letters are capitals, and there is a letter."""
    letters, capitals = F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return (letters > 0) & (10 * capitals >= 9 * letters)


def cue_words(c: Column) -> Column:
    bare = F.translate(F.regexp_replace(c, r"\([^)]*\)", ""), "/", " ")
    return F.size(F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != ""))


def is_probable_cue(c: Column) -> Column:
    """A line that looks like a speaker's name; whether it is one depends on what follows."""
    s = F.trim(c)
    words = F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, r"^[.()]+|[.()]+$", ""))
    titled = F.arrays_overlap(words, F.array(*map(F.lit, NOT_CUES))) & ~s.contains("V/O") & ~s.contains("(")
    return (
        (s != "") & ~s.startswith("#") & ~s.contains(" - ") & ~s.rlike("[:;]") & (F.length(s) <= 80)
        & ~_starts(s, TRANSITIONS) & ~is_header(s) & ~is_parenthetical(s) & is_mostly_upper(s) & (cue_words(s) <= 8) & ~titled
    )


def looks_spoken(c: Column) -> Column:
    s = F.trim(c)
    return (
        F.when((s == "") | is_header(s), False)
        .when(is_parenthetical(s), True)
        .when(_starts(s, TRANSITIONS), False)
        .when(s.rlike(r"\p{Ll}"), True)
        .otherwise((F.size(F.split(s, r"\s+")) <= 3) & (F.length(s) <= 20))
    )


def header_fields(c: Column) -> Column:
    """Struct of prefix, location_raw, location_canonical_id, time_of_day, year_explicit and flags of a header line.

    Segments after the place are read from the end while each is a year, a time of day or a flag;
    of several years or times the first in the line holds, being read last.
    """
    s = F.trim(c)
    prefix, rest = F.upper(F.regexp_extract(s, HEADER, 1)), F.trim(F.regexp_extract(s, HEADER, 2))
    parts = F.filter(F.transform(F.split(rest, " - "), lambda x: F.trim(x)), lambda x: x != "")
    tail = lambda x: F.upper(x).rlike(r"^(19\d{2}|20\d{2})$") | F.upper(x).isin("FLASHBACK", "CONTINUED", *TIMES_OF_DAY)
    run = F.aggregate(
        F.reverse(parts),
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("over")),
        lambda acc, x: F.when(acc["over"] | ~tail(x), F.struct(acc["n"].alias("n"), F.lit(True).alias("over"))).otherwise(F.struct((acc["n"] + 1).alias("n"), F.lit(False).alias("over"))),
    )["n"]
    taken = F.transform(F.slice(parts, F.size(parts) - run + 1, run), F.upper)
    place = F.array_join(F.slice(parts, 1, F.size(parts) - run), " - ")
    years = F.filter(taken, lambda x: x.rlike(r"^\d{4}$"))
    times = F.filter(taken, lambda x: x.isin(*TIMES_OF_DAY))
    inline = F.regexp_extract(rest, rf"{BEGINS}(19\d{{2}}|20\d{{2}}){ENDS}", 1)
    year = F.when(F.size(years) > 0, F.try_element_at(years, F.lit(1))).otherwise(F.nullif(inline, F.lit("")))
    flags = F.array_compact(
        F.array(
            F.when(F.array_contains(taken, "CONTINUED"), "continued"),
            F.when(F.size(years) > 0, "explicit_year"),
            F.when((F.size(years) == 0) & (inline != ""), "explicit_year_inline"),
            F.when(F.upper(rest).contains("FLASHBACK"), "flashback"),
            F.when(prefix.isin(*MIXED_PREFIXES), "mixed_interior_exterior"),
        )
    )
    location = F.coalesce(F.nullif(place, F.lit("")), rest)
    return F.struct(
        prefix.alias("header_prefix"),
        location.alias("location_raw"),
        F.concat(F.lit("loc_"), slug(location)).alias("location_canonical_id"),
        F.try_element_at(times, F.lit(1)).alias("time_of_day"),
        year.try_cast("int").alias("year_explicit"),
        flags.alias("flags"),
    )


# Lines of the source before cleaning.

#: Fixed values of the page format.
PAGE_HEADINGS = ("INT.", "EXT.", "INT./EXT.", "EXT./INT.", "INT/EXT.", "EXT/INT.")
HEADING_LIKE = ("BACK TO ", "INTERCUT", "MONTAGE", "SERIES OF SHOTS", "INSERT", "ANGLE", "CLOSE ON", "WIDER", "OMITTED")
PAGE_TRANSITIONS = ("CUT TO:", "SMASH CUT TO:", "DISSOLVE TO:", "MATCH CUT TO:", "FADE IN:", "FADE OUT:")
#: How an action beat that follows speech without a blank begins: names in capitals, then small letters.
ACTION_BEAT = r"^[A-Z][A-Z'’.-]+(?: [A-Z][A-Z'’.-]+){1,4}\b.*[a-z]"
CAPITALS = r"^[A-Z0-9 .,'’/()&:;?!-]+$"


def is_page_heading(c: Column) -> Column:
    return _starts(F.trim(c), PAGE_HEADINGS + HEADING_LIKE)


def is_transition(c: Column) -> Column:
    s = F.trim(c)
    return s.isin(*PAGE_TRANSITIONS) | (s.endswith(":") & (F.length(s) <= 40) & s.rlike(CAPITALS))


def is_page_cue(c: Column, cast: tuple[str, ...] = ()) -> Column:
    """A short line in capitals; where the cast is given, of one of its names, with or without marks such as V/O."""
    s = F.trim(c)
    words = F.size(F.split(s, r"\s+"))
    spaced_title = s.contains("  ") & F.replace(s, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$") & (words > 4)
    marked = s.contains("(CONT'D)") | s.contains("V/O") | s.contains("O.S.")
    return (s != "") & (F.length(s) <= 45) & s.rlike(CAPITALS) & s.rlike("[A-Z]") & ~is_page_heading(s) & ~is_transition(s) & ~spaced_title & ((words <= 6) | marked) & (cue_base(s).isin(*cast) if cast else F.lit(True))


def is_short_parenthetical(c: Column) -> Column:
    s = F.trim(c)
    return s.startswith("(") & s.endswith(")") & (F.length(s) <= 60)


def continues_heading(c: Column) -> Column:
    s = F.trim(c)
    return (F.length(s) >= 8) & s.contains(" - ") & s.rlike(CAPITALS)


def split_merged(c: Column, cast: tuple[str, ...] = ()) -> Column:
    """One or two lines of a line in which a page break has run a speaker's cue and other text together."""
    s = F.trim(c)
    shapes = (
        (r"^(.+?)\s+\d{1,3}([A-Z].*)$", 1),
        (r"^(.+?[.!?…])\s*([A-Z][A-Z0-9 .,'’/()&-]{1,60}?)(?:\s+\d{1,3})?$", 2),
        (r"^(.+?)\s{2,}([A-Z][A-Z0-9 .,'’/()&-]{1,60})\s+\d{1,3}$", 2),
    )
    out = F
    for shape, cue in shapes:
        sides = [F.trim(F.regexp_extract(s, shape, k)) for k in (1, 2)]
        out = out.when(s.rlike(shape) & is_page_cue(sides[cue - 1], cast), F.array(*sides))
    return out.otherwise(F.array(s))


def without_footer(c: Column, page: Column, cast: tuple[str, ...] = ()) -> Column:
    """Without a page number at the end: any after two blanks, and the page's own or the one before."""
    s = F.trim(c)
    bare = F.regexp_replace(s, r"\s{2,}\d{1,3}$", "")
    for number in (page, F.when(page > 1, page - 1)):
        ended = F.regexp_replace(bare, F.concat(F.lit(r"\s+"), number.cast("string"), F.lit(r"\s*$")), "")
        bare = F.when(number.isNotNull(), ended).otherwise(bare)
    s = F.when(F.length(s) > 18, bare).otherwise(s)
    short = F.regexp_replace(s, r"\s+\d{1,3}$", "")
    return F.when(is_page_cue(short, cast), short).otherwise(s)


def page_lines(c: Column, page: Column, cast: tuple[str, ...] = ()) -> Column:
    """The clean lines of a page's line: none, one, or several."""
    s = F.trim(c)
    bare = F.regexp_replace(F.regexp_replace(s, r"^\(MORE\)\s*", ""), r"^\d{1,3}(?=[A-Z(])", "")
    once = F.transform(split_merged(bare, cast), lambda x: without_footer(x, page, cast))
    twice = F.filter(F.flatten(F.transform(once, lambda x: split_merged(x, cast))), lambda x: x != "")
    return F.when(s == "", F.array(F.lit(""))).when(s.rlike(r"^\(MORE\)\s*\d*$|^\d{1,3}$"), F.array().cast("array<string>")).otherwise(twice)


def without_page_number(c: Column) -> Column:
    """Without numbers that page breaks have left within or behind a line; `No. 7` alone stays."""
    s = F.regexp_replace(c, r"\s{2,}\d{1,3}(?=\s+[A-Z])", "")
    s = F.regexp_replace(s, r"(?<=[.?!…])\s+\d{1,3}(?=\s+[A-Z])", "")
    bare = F.regexp_replace(F.regexp_replace(s, r"\s{2,}\d{1,3}$", ""), r"(?<=[A-Za-z,;:)\]’\".!?…])\s+\d{1,3}$", "")
    return F.trim(F.when(s.rlike(r"^No\.\s+\d{1,3}$"), s).otherwise(bare))
