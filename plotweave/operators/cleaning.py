"""Pages of a script to clean lines: page scan, line repair, blank runs, wrapped lines, split headings.

Every step keeps (doc_id, line_no, line) with lines numbered from 1 within a document; windows are
by document, so documents are cleaned in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import lines as L


def by_doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def document_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line: a text's lines in order."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r", -1)).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def paged_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, page, line_no, line of the fenced text under each `## Page N` heading.

    A page without an opened and closed fence, or a document without pages, raises an error.
    """
    raw = document_lines(docs, doc_id=doc_id, text=text)
    heading = F.regexp_extract("line", r"^## Page (\d+)\s*$", 1).try_cast("int")
    paged = raw.withColumn("page_at", F.when(heading.isNotNull(), F.col("line_no"))).withColumn("page_no", heading)
    paged = paged.withColumn("page_at", F.last("page_at", ignorenulls=True).over(so_far())).withColumn("page", F.last("page_no", ignorenulls=True).over(so_far()))
    in_page = Window.partitionBy("doc_id", "page_at").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = paged.withColumn("opened", F.sum(F.when(F.rtrim("line") == "```text", 1).otherwise(0)).over(in_page)).withColumn("closed", F.sum(F.when((F.rtrim("line") == "```") & (F.col("opened") > 0), 1).otherwise(0)).over(in_page))
    whole = Window.partitionBy("doc_id", "page_at")
    checked = fence.withColumn("ok", (F.max("opened").over(whole) > 0) & (F.max("closed").over(whole) > 0)).withColumn("pages", F.max("page_at").over(Window.partitionBy("doc_id")))
    fault = F.when(F.col("pages").isNull(), F.raise_error("no pages")).when(F.col("page_at").isNotNull() & ~F.col("ok"), F.raise_error(F.concat(F.lit("page without a whole text fence: "), F.col("page").cast("string"))))
    body = (F.col("opened") > 0) & (F.col("closed") == 0) & (F.rtrim("line") != "```text")
    return checked.where(F.coalesce(fault.cast("boolean"), F.lit(True))).where(F.col("page").isNotNull() & body).select("doc_id", "page", "line_no", "line")


def fenced_body(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line of the first ```text block of each document."""
    body = F.regexp_extract(F.col(text), r"(?s)```text\s*\n(.*?)\n```", 1)
    found = F.when(F.col(text).rlike(r"(?s)```text\s*\n.*?\n```"), body).otherwise(F.raise_error("no fenced text block"))
    return document_lines(docs.select(F.col(doc_id).alias("doc_id"), found.alias("text")))


def renumbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).select("doc_id", "line_no", "line")


def repaired(pages: DataFrame, cast: tuple[str, ...] = ()) -> DataFrame:
    """Lines without page numbers and continuation marks, merged cues on lines of their own."""
    parts = pages.select("doc_id", "line_no", F.posexplode(L.page_lines(F.col("line"), F.col("page"), cast)).alias("part", "line"))
    return renumbered(parts, "line_no", "part")


def blank_runs_collapsed(df: DataFrame, blank: Column | None = None) -> DataFrame:
    """At most one blank line in a row, none at the ends of a document."""
    is_blank = F.trim("line") == "" if blank is None else blank
    marked = df.withColumn("blank", is_blank)
    whole = Window.partitionBy("doc_id")
    ends = marked.withColumn("first", F.min(F.when(~F.col("blank"), F.col("line_no"))).over(whole)).withColumn("last", F.max(F.when(~F.col("blank"), F.col("line_no"))).over(whole))
    kept = ends.withColumn("before", F.lag("blank", 1, False).over(by_doc())).where(~(F.col("blank") & F.col("before")) & F.col("line_no").between(F.col("first"), F.col("last")))
    return renumbered(kept, "line_no")


def unwrapped(df: DataFrame, cast: tuple[str, ...] = ()) -> DataFrame:
    """Lines of one paragraph joined; a hyphen within a word, before a lower-case letter, joins without a blank.

    A paragraph ends at a blank line, a heading, a transition, a cue and a parenthetical; a line
    behind a cue or parenthetical starts one, and so does, within speech, the first line that goes
    on like an action beat. A blank line stands before every heading, transition and cue.
    """
    line = F.col("line")
    kind = F.when(F.trim(line) == "", "blank").when(L.is_page_heading(line) | L.is_transition(line), "mark").when(L.is_short_parenthetical(line), "paren").when(L.is_page_cue(line, cast), "cue").otherwise("text")
    kinds = df.withColumn("kind", kind)
    goes_on = (F.col("kind") == "text") & (F.lag("kind", 1, "blank").over(by_doc()) == "text")
    # Speech lasts from a cue to the next blank, heading or cue.
    parted = kinds.withColumn("goes_on", goes_on).withColumn("part", F.sum(F.when(F.col("kind").isin("blank", "mark", "cue"), 1).otherwise(0)).over(so_far()))
    in_part = Window.partitionBy("doc_id", "part")
    speech = F.max(F.when(F.col("kind") == "cue", True).otherwise(False)).over(in_part)
    turns = F.min(F.when(F.col("goes_on") & F.trim(line).rlike(L.ACTION_BEAT), F.col("line_no"))).over(in_part)
    starts = parted.withColumn("start", F.when(F.col("goes_on") & ~(speech & (F.col("line_no") == F.coalesce(turns, F.lit(-1)))), 0).otherwise(1))
    blocks = starts.withColumn("block", F.sum("start").over(so_far())).groupBy("doc_id", "block").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("lines"))
    joined = F.aggregate(
        "lines",
        F.lit(""),
        lambda acc, x: F.when(acc == "", x["line"]).when(acc.endswith("-") & ~acc.endswith(" -") & x["line"].rlike(r"^\p{Ll}"), F.concat(acc, x["line"])).otherwise(F.concat_ws(" ", acc, x["line"])),
    )
    before = F.lag("kind").over(Window.partitionBy("doc_id").orderBy("block"))
    apart = F.col("kind").isin("mark", "cue") & before.isNotNull() & (before != "blank")
    told = blocks.select("doc_id", "block", joined.alias("line"), apart.alias("apart"))
    return renumbered(told.select("doc_id", "block", F.posexplode(F.when(F.col("apart"), F.array(F.lit(""), "line")).otherwise(F.array("line"))).alias("part", "line")), "block", "part")


def headings_merged(df: DataFrame) -> DataFrame:
    """A heading's prefix alone on its line joins the next line that is not blank, where that continues a heading."""
    alone = F.trim("line").isin(*L.PAGE_HEADINGS)
    ahead = F.first(F.when(F.trim("line") != "", F.struct("line_no", "line")), ignorenulls=True).over(by_doc().rowsBetween(1, Window.unboundedFollowing))
    told = df.withColumn("next", F.when(alone, ahead)).withColumn("next", F.when(L.continues_heading(F.col("next")["line"]), F.col("next")))
    # Lines from behind the prefix to the line that is taken in go.
    eaten = F.max(F.col("next")["line_no"]).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    merged = told.withColumn("eaten", eaten).where(F.col("eaten").isNull() | (F.col("line_no") > F.col("eaten")))
    return renumbered(merged.withColumn("line", F.when(F.col("next").isNotNull(), F.concat_ws(" ", F.trim("line"), F.col("next")["line"])).otherwise(F.col("line"))), "line_no")


def cleaned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cast: tuple[str, ...] = ()) -> DataFrame:
    """The whole way from paged text to clean lines.

    cast: the names of all speakers, where they are known; no other line is a cue then, however short and in capitals.
    """
    pages = blank_runs_collapsed(repaired(paged_lines(docs, doc_id=doc_id, text=text), cast))
    joined = headings_merged(blank_runs_collapsed(unwrapped(pages, cast)))
    return blank_runs_collapsed(joined.withColumn("line", L.without_page_number(F.col("line"))))
