"""Text helpers as Column expressions: normal forms, slugs, tokens, pair keys, ids. Nothing here runs Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a word of ASCII letters, digits and underscores begins and ends. Java's own \b takes letters of all alphabets for words
#: in some versions and ASCII only in others.
BEGINS, ENDS = r"(?<!\w)", r"(?!\w)"


#: Marker names and their patterns (fixed values).
MARKERS = {
    "back_to": rf"(?i){BEGINS}BACK\s+TO{ENDS}",
    "contd": r"(?i)\(CONT['’]?D\)",
    "flashback": rf"(?i){BEGINS}FLASHBACK{ENDS}",
    "in_sync": r"(?i)\(IN\s+SYNC\)",
    "overlap": r"(?i)\(OVERLAP\)",
    "pre_lap": r"(?i)PRE-LAP",
    "voice_over": rf"(?i){BEGINS}V/O{ENDS}",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def straight(c: Column | str) -> Column:
    """Right single quotes as apostrophes."""
    return F.translate(col(c), "’", "'")


def straight_both(c: Column | str) -> Column:
    """Single quotes of either side as apostrophes."""
    return F.translate(col(c), "’‘", "''")


def squeeze(c: Column | str) -> Column:
    """White-space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def strip(c: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def slug(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def entity_slug(c: Column | str) -> Column:
    return slug(straight_both(c))


def truncate(c: Column | str, most: int = 220) -> Column:
    """Squeezed text of at most so many characters; what is cut ends in three dots."""
    s = squeeze(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most - 3)), F.lit("...")))


def tokens(c: Column | str) -> Column:
    """Lower-case words of letters, digits and apostrophes, of two characters or more, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s']", " "), r"\s+"), lambda w: F.length(w) >= 2)


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Tokens of the text, repeats counted, that the query has; 2 more where the text contains the whole query."""
    asked = tokens(query)
    shared = F.size(F.filter(tokens(text), lambda w: F.array_contains(asked, w)))
    whole = F.lower(strip(query))
    return shared + F.when((whole != "") & F.contains(F.lower(col(text)), whole), 2).otherwise(0)


def has_any(c: Column, needles: Iterable[str]) -> Column:
    """Whether the text contains one of the needles; c is lower-case already."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def markers(c: Column | str) -> Column:
    """Names of the markers in a text, in alphabetical order."""
    return F.array_compact(F.array(*(F.when(col(c).rlike(p), name) for name, p in MARKERS.items())))


def cue_base(c: Column | str) -> Column:
    """A speaker cue without its modifiers."""
    return squeeze(F.regexp_replace(F.regexp_replace(col(c), rf"(?i){BEGINS}V/O{ENDS}", ""), r"\([^)]*\)", ""))


def cue_modifiers(c: Column | str) -> Column:
    u = F.upper(col(c))
    found = [("contd", u.contains("CONT'D") | u.contains("CONT’D")), ("in_sync", u.contains("IN SYNC")), ("overlap", u.contains("OVERLAP")), ("pre_lap", u.contains("PRE-LAP")), ("voice_over", u.contains("V/O"))]
    return F.array_compact(F.array(*(F.when(test, name) for name, test in found)))


def alias_normal(c: Column | str) -> Column:
    """The form under which aliases and cues are looked up."""
    s = straight_both(c)
    for p in (r"V/O(?!\w)", r"O/S(?!\w)", r"O\.S\.(?=\w)", r"O/C(?!\w)", r"O\.C\.(?=\w)", r"PRE-LAP(?!\w)"):
        s = F.regexp_replace(s, f"(?i){BEGINS}{p}", "")
    s = F.regexp_replace(s, r"\([^)]*\)", "")
    return F.upper(squeeze(s))


#: Words that a display name keeps in capitals (fixed values).
ACRONYMS = ("FBI", "TV", "USA", "US", "DC", "PA")


def display_name(c: Column | str) -> Column:
    """Title case, but roman numerals, the acronyms and initials with a dot stay."""

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, r"^[.,]+|[.,]+$", "")
        initial = w.endswith(".") & bare.rlike(r"^\p{L}$")
        titled = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))
        return F.when(bare.rlike("^[IVX]+$") | bare.isin(*ACRONYMS), w).when(initial, F.upper(w)).otherwise(titled)

    return F.array_join(F.transform(F.split(squeeze(c), " "), word), " ")


def ordered_distinct(c: Column | str) -> Column:
    """Array without blanks and repeats, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def directed_pair(a: Column | str, b: Column | str) -> Column:
    return F.concat(col(a), F.lit("->"), col(b))


def undirected_pair(a: Column | str, b: Column | str, between: str = "<->") -> Column:
    return F.concat(F.least(col(a), col(b)), F.lit(between), F.greatest(col(a), col(b)))


def pair_key(a: Column | str, b: Column | str) -> Column:
    return undirected_pair(a, b, "::")


def numbered_id(prefix: str, number: Column | str, width: int = 6) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", col(number))


def lenient_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(c).try_cast("int"), F.lit(default))


def lenient_double(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def href(base: str, **parameters: Column | str) -> Column:
    """A path with the parameters that have a value, encoded as forms are."""
    parts = [F.when(F.trim(col(c)) != "", F.concat(F.lit(f"{name}="), F.url_encode(F.trim(col(c))))) for name, c in parameters.items()]
    asked = F.concat_ws("&", *parts)
    return F.when(asked == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}?"), asked))


def literal(c: Column | str) -> Column:
    """A text as a pattern that matches only itself."""
    return F.concat(F.lit(r"\Q"), F.replace(col(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def scene_ref(c: Column | str) -> Column:
    return F.concat(F.lit("scene:"), col(c))


def ci_contains(c: Column | str, q: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(q.lower()))


def year_in(c: Column | str) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.regexp_extract(col(c), rf"{BEGINS}(19\d{{2}}|20\d{{2}}){ENDS}", 1).try_cast("int")
