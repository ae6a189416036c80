"""HTML main-text extraction by wrapper induction over pages of one host.

Every page becomes a tree of labels (tag and class) in which siblings of one label are one
repeated node. A host's different trees are few; simple tree matching aligns them, a few at a time
and then the merged ones, into the host's wrapper, whose nodes are the slots of its pages. Pages
are then read through the wrapper, and Spark counts over all different pages of the host how many
have a text in a slot, and how much text each slot has, a text counted once however many pages have
it. The content part is the deepest node of the wrapper below which most of the host's varying text
lies; what is outside of it is no content, whatever its name. In it a text that most pages of a host
have in one slot is template, unless such texts are half of the host's usual page or more: then the
host has copies of one article, and all of them stay. Names of parts (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) decide in the content part only where they leave no doubt, `share-links` but
not `share-prices`; on pages that have nothing in a content part any such word does.

Hot hosts cost no more per row than others: trees are counted with map-side sums before they meet,
texts likewise, and a page meets its host's wrapper, one row, by a join.

Defined cases: null or empty html has empty text; a page whose url has no host is read by itself,
without a wrapper; markup that is not closed is closed where its parent ends; elements nested
deeper than MOST_DEPTH are taken for children of the one at that depth, with their own names and
those of what they lie in; numbers in names of classes (`post-12`, `id1234`) are one to a wrapper; character references are decoded once;
pages that are repeated, also under one id, are read each, but show a host's template only once.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import settle
from plotweave.llm.urls import host_of

#: A text is template where at least this share of a host's different pages, and so many of them, have it in one slot.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 2
#: The content part holds at least this share of a host's varying text.
CONTENT_SHARE = 0.7
MOST_DEPTH = 100
#: Comments and tags; nothing is tried twice, so text full of `<` costs no more than other text.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])|\d{3,}")
CLASS = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What the start of a block ends, within its parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tags and class words of parts that are no content.
OFF_TAGS = frozenset("nav footer aside form script style head button select dialog menu input label fieldset".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist respond disqus reply replies related recommended recommendations widget widgets toolbar pagination pager skip hidden".split()
)
#: Words that say nothing about what a part holds: beside these a word of OFF_WORDS names the part.
SHAPE_WORDS = frozenset("area bar block body bottom box btn button buttons col column container content footer form global group header icon icons inner item items left link links list main middle module outer panel primary region right row secondary section side site slot small top unit wrap wrapper".split())
ON_TAGS = frozenset(["article", "main"])
ON_WORDS = frozenset(["article", "main", "post", "entry", "story"])


#: What is known of a part: it may be content, a word of its names speaks against it, or its names leave no doubt that it is none.
OPEN, DOUBTED, OFF = 0, 1, 2


class Node:
    __slots__ = ("label", "children", "off", "on", "number")

    def __init__(self, label: str, off: int = OPEN, on: bool = False):
        self.label, self.off, self.on, self.children, self.number = label, off, on, {}, 0


def _marks(tag: str, attributes: str) -> tuple[str, int, bool]:
    """Label of an element, how far it marks a part as no content, and whether it marks it as the content."""
    words: list[str] = []
    shown = ""
    hidden = False
    for name, value in CLASS.findall(attributes) if attributes else ():
        value = value.strip("\"'").lower()
        hidden |= name.lower() == "hidden"
        if name.lower() in ("class", "role"):
            # Numbers tell rows of a page, or pages, apart, but not parts.
            shown += f".{' '.join(sorted({NUMBER.sub('#', x) for x in value.split()}))}"
        words += re.split(r"[\s_-]+", value)
    kinds = set(words)
    on = tag in ON_TAGS or bool(kinds & ON_WORDS) and tag in ("div", "section") and not kinds & OFF_WORDS
    named = tag not in ("body", "html", "article", "main") and bool(kinds & OFF_WORDS)
    sure = hidden or tag in OFF_TAGS or named and all(w in OFF_WORDS or w in SHAPE_WORDS or not w.isalpha() for w in kinds)
    return f"{tag}{shown}", OFF if sure else DOUBTED if named else OPEN, on


def parse(html: str) -> tuple[Node, list[tuple[int, str]]]:
    """The tree of labels, numbered in order of first sight, and the text of each block with its node's number."""
    root = Node("")
    path: list[tuple[str, Node]] = [("", root)]
    nodes, blocks, run, at, open_tags = 1, [], [], 0, Counter()
    owner: Node | None = None

    def text(piece: str) -> None:
        nonlocal owner
        if piece:
            run.append(piece)
            if owner is None and not piece.isspace():
                # Inline elements do not own text: their block does.
                owner = next(n for t, n in reversed(path) if t in BLOCK or not t)

    def close() -> None:
        nonlocal owner
        if run:
            line = " ".join(entities.unescape("".join(run)).split())
            if line and owner is not None:
                blocks.append((owner.number, line))
            run.clear()
        owner = None

    size = len(html)
    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(path) - 1, 0, -1) if path[k][0] == tag), 0) if open_tags[tag] else 0
            # An end tag closes what is open inside its element, but not beyond a block it is inline to.
            if depth and (tag in BLOCK or not any(t in BLOCK for t, _ in path[depth + 1 :])):
                if tag in BLOCK:
                    close()
                open_tags.subtract(t for t, _ in path[depth:])
                del path[depth:]
            continue
        if tag in BLOCK:
            close()
            ends = ENDS.get(tag, set()) | {"p"}
            k = len(path) - 1
            while k > 0 and (path[k][0] in ends or path[k][0] not in BLOCK):
                k -= 1
            if k < len(path) - 1 and any(t in ends for t, _ in path[k + 1 :]):
                open_tags.subtract(t for t, _ in path[k + 1 :])
                del path[k + 1 :]
        elif tag == "br":
            text(" ")
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else size
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        label, off, on = _marks(tag, m[3])
        off = max(off, path[-1][1].off)
        on = on or len(path) > MOST_DEPTH and path[-1][1].on
        # Siblings that are marked differently are different nodes, whatever marks them.
        label += "!" * off
        parent = path[min(len(path) - 1, MOST_DEPTH)][1]
        node = parent.children.get(label)
        if node is None:
            node = parent.children[label] = Node(label, off, on)
            node.number, nodes = nodes, nodes + 1
        path.append((tag, node))
        open_tags[tag] += 1
    close()
    return root, blocks


def as_lists(node: Node) -> list:
    """[label, no content, content, number, children]."""
    return [node.label, int(node.off), int(node.on), node.number, [as_lists(c) for c in node.children.values()]]


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes that match in order, below two nodes of one label, and pairs of children."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[4], b[4]
    if [c[0] for c in x] == [c[0] for c in y]:
        return 1 + sum(matching(p, q)[0] for p, q in zip(x, y, strict=True)), [(i, i) for i in range(len(x))]
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    gain = np.array([[matching(p, q)[0] if p[0] == q[0] else 0 for q in y] for p in x], int).reshape(len(x), len(y))
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + gain[i, j])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + int(best[-1, -1]), pairs[::-1]


def merge(wrapper: list, tree: list) -> list:
    """The wrapper with what the tree has beyond it, in the tree's order."""
    pairs = matching(wrapper, tree)[1]
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(wrapper[4]), len(tree[4]))]:
        children += wrapper[4][i:p] + tree[4][j:q]
        if p < len(wrapper[4]) and q < len(tree[4]):
            children.append(merge(wrapper[4][p], tree[4][q]))
        i, j = p + 1, q + 1
    return [wrapper[0], wrapper[1], wrapper[2], wrapper[3], children]


def slots_of(wrapper: list, tree: list) -> dict[int, str]:
    """The slot of each node of the tree: its place in the wrapper as a path of labels."""
    found: dict[int, str] = {}

    def walk(w: list, t: list, path: str) -> None:
        found[t[3]] = path
        aligned = dict((j, i) for i, j in matching(w, t)[1])
        for j, child in enumerate(t[4]):
            i = aligned.get(j)
            if i is None:
                unmatched(child, f"{path}/?{child[0]}")
            else:
                walk(w[4][i], child, f"{path}/{i}{child[0]}")

    def unmatched(t: list, path: str) -> None:
        found[t[3]] = path
        for child in t[4]:
            unmatched(child, f"{path}/{child[0]}")

    walk(wrapper, tree, "")
    return found


def shown(tree: list, least: int) -> set[int]:
    """Numbers of the nodes whose text may be content, if marks from `least` on speak against that."""
    nodes: list[tuple[list, bool]] = []

    def walk(t: list, on: bool) -> None:
        # A header within the content holds its title; any other is no content.
        on = on or bool(t[2])
        off = t[1] >= least or t[0].split(".")[0].rstrip("!") == "header" and not on
        if not off:
            nodes.append((t, on))
            for c in t[4]:
                walk(c, on)

    walk(tree, False)
    main = {t[3] for t, on in nodes if on}
    return main or {t[3] for t, _ in nodes}


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _as_text(tree: list) -> str:
    return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            trees = [_as_text(as_lists(parse(text or "")[0])) for text in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": part.column("host"), "tree_key": pa.array([_key(t) for t in trees], pa.int64()), "tree": trees})


def _wrapped(key, table):
    """One wrapper of the trees of a group; trees by how many pages have them, then by their text."""
    order = sorted(zip(table.column("pages").to_pylist(), table.column("tree").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    wrapper = json.loads(order[0][1])
    for _, tree in order[1:]:
        wrapper = merge(wrapper, json.loads(tree))
    return pa.table({"host": [key[0].as_py()], "pages": pa.array([sum(n for n, _ in order)], pa.int64()), "tree": [_as_text(wrapper)]})


def wrappers(pages: DataFrame, groups: int = 32) -> DataFrame:
    """host, pages, wrapper of pages (host, html): the host's trees merged by groups, and the groups' wrappers merged."""
    found = pages.select("host", "html").mapInArrow(_trees, "host string, tree_key long, tree string")
    trees = found.groupBy("host", "tree_key").agg(F.count("*").alias("pages"), F.first("tree").alias("tree"))
    first = trees.withColumn("part", F.pmod("tree_key", F.lit(groups))).groupBy("host", "part").applyInArrow(_wrapped, "host string, pages long, tree string")
    return first.groupBy("host").applyInArrow(_wrapped, "host string, pages long, tree string").withColumnRenamed("tree", "wrapper")


class Reader:
    """Reads pages through their hosts' wrappers; a tree and wrapper that were met before are not aligned again."""

    def __init__(self):
        self.known: dict[tuple, tuple[dict[int, str], set[int], set[int]]] = {}

    def blocks(self, host: str, wrapper: str, html: str | None) -> list[tuple[str, bool, bool, str]]:
        """The slot of each block, whether names leave it open, or let it be content beyond any doubt, and its text."""
        root, found = parse(html or "")
        own = as_lists(root)
        key = (host, _as_text(own))
        if key not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[key] = slots_of(json.loads(wrapper), own), shown(own, OFF), shown(own, DOUBTED)
        slots, may, surely = self.known[key]
        return [(slots[n], n in may, n in surely, line) for n, line in found]


def _slot_key(slot: str, line: str) -> int:
    return _key(f"{slot}\n{line}")


def _texts_in_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's different texts in slots, with the hash of the whole page."""
    reader = Reader()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [sorted({(slot, _slot_key(slot, line), len(line)) for slot, _, _, line in reader.blocks(*row)}) for row in zip(*(part.column(c).to_pylist() for c in ("host", "wrapper", "html")), strict=True)]
            rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
            slots, keys, sizes = (pa.array([x[k] for page in found for x in page], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_pydict({"host": part.column("host").take(rows), "body": part.column("body").take(rows), "slot": slots, "text_in_slot": keys, "chars": sizes})


def _label(step: str) -> tuple[str, set[str]]:
    """Tag and class words of a step of a slot's path."""
    tag, _, classes = step.lstrip("?0123456789").rstrip("!").partition(".")
    return tag, set(re.split(r"[\s_.-]+", classes))


def content_slot(chars: dict[str, int], share: float = CONTENT_SHARE) -> str:
    """The content part (a path of slots): the deepest element around slots below which that share of the characters lies.

    A title may lie one level above the rest: the part is the nearest element around it that is
    called an article or the like, else the one next above, if the page's body is not that.
    """
    total, below = sum(chars.values()), Counter()
    for slot, n in chars.items():
        steps = slot.split("/")
        for k in range(1, max(2, len(steps))):
            below["/".join(steps[:k])] += n
    steps = max((s for s, n in below.items() if n >= share * total), key=lambda s: (s.count("/"), s), default="").split("/")
    for k in range(len(steps), 0, -1):
        tag, words = _label(steps[k - 1])
        if tag in ON_TAGS or words & ON_WORDS and not words & OFF_WORDS:
            return "/".join(steps[:k])
    return "/".join(steps[:-1] if len(steps) > 1 and _label(steps[-2])[0] not in ("", "html", "body") else steps)


def _content_slots(key, table):
    chars = dict(zip(table.column("slot").to_pylist(), table.column("chars").to_pylist(), strict=True))
    return pa.table({"_host": [key[0].as_py()], "content": [content_slot(chars)]})


def chosen(blocks: list[tuple[str, bool, bool, str]], content: str | None, template: set[int]) -> tuple[list[str], int]:
    """The content of a page's blocks, and how many blocks of the content part were template."""
    part = [(slot, line) for slot, may, _, line in blocks if may and content and (slot == content or slot.startswith(f"{content}/"))]
    part = part or [(slot, line) for slot, _, surely, line in blocks if surely]
    kept = [line for slot, line in part if _slot_key(slot, line) not in template]
    return kept, len(part) - len(kept)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts, sizes, dropped = [], [], []
            for host, wrapper, html, content, template in zip(*(part.column(c).to_pylist() for c in ("host", "wrapper", "html", "content", "template")), strict=True):
                kept, n = chosen(reader.blocks(host, wrapper, html), content, set(template or ()))
                texts.append("\n".join(kept))
                sizes.append(len(kept))
                dropped.append(n)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int32()), pa.array(dropped, pa.int32())], names=["page_id", "url", "text", "n_chars", "blocks", "template_blocks"])


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, blocks, template_blocks (how many blocks of the content part were template).

    Pages are read three times rather than moved: wrappers, content parts and template texts are
    small tables by host, which Spark broadcasts where their files are below its threshold and
    joins by host beyond.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    wrapped = settle(wrappers(named.where("host <> ''")).drop("pages"), "wrappers")
    with_wrapper = named.join(wrapped, "host", "left").withColumn("wrapper", F.coalesce("wrapper", F.lit(_as_text(as_lists(Node(""))))))
    rows = with_wrapper.select("host", "wrapper", "html", F.xxhash64("html").alias("body")).mapInArrow(_texts_in_slots, "host string, body long, slot string, text_in_slot long, chars long")
    # Copies of a page are one body; a text that many pages have in a slot is one text.
    texts = settle(rows.distinct().groupBy("host", "slot", "text_in_slot").agg(F.count("*").alias("n"), F.first("chars").alias("chars")), "slot-texts")
    bodies = named.select("host", F.xxhash64("html").alias("body")).distinct().groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("bodies"))
    parts = texts.where("host <> ''").groupBy("host", "slot").agg(F.sum("chars").alias("chars")).groupBy("host").applyInArrow(_content_slots, "_host string, content string")
    inside = texts.join(parts, F.col("host") == F.col("_host")).where((F.col("content") != "") & ((F.col("slot") == F.col("content")) | F.startswith("slot", F.concat("content", F.lit("/")))))
    judged = inside.drop("_host").join(bodies, F.col("host") == F.col("_host")).withColumn("common", (F.col("n") >= least) & (F.col("n") >= share * F.col("bodies")))
    # A slot has at most 1/share such texts, so a host's list is as short as its wrapper.
    template = judged.groupBy(F.col("host").alias("_of")).agg(
        F.collect_set(F.when(F.col("common"), F.col("text_in_slot"))).alias("texts"),
        F.sum(F.when(F.col("common"), F.col("chars")).otherwise(0)).alias("common_chars"),
        (F.sum(F.col("n") * F.col("chars")) / F.first("bodies")).alias("usual_chars"),
    ).select("_of", F.when(2 * F.col("common_chars") < F.col("usual_chars"), F.col("texts")).alias("template"))
    told = settle(parts.join(template, F.col("_host") == F.col("_of"), "left").select("_host", "content", "template"), "template")
    return with_wrapper.join(told, F.col("host") == F.col("_host"), "left").select("page_id", "url", "host", "wrapper", "html", "content", "template").mapInArrow(_contents, f"page_id {kind}, url string, text string, n_chars long, blocks int, template_blocks int")
