"""Main text of pages by wrapper induction over the pages of a host.

Each page becomes a tree and a list of text blocks. A host's commonest tree is its reference; every other tree of the
host is aligned to it by simple tree matching, so blocks get slots that mean the same across the host's pages. A
text that fills one slot on pages of otherwise different content is template and goes. Of the slots that vary, those
count as content that stand under the deepest node with most of the host's varying text outside links; menus and lists of
related pages vary too, but as links, and notices with little text. Markup comes second: inside that region it rules
out what it declares to be something else, and an article element that most of the region's text stands in bounds it.
Hosts with too few different pages to align have their markup alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html_tree import BLOCK, RAW, Node, match, parse, read_skeleton, repeated, skeleton

ORACLE_SQL = None

#: Tags, roles and words of classes and ids that mark a region as no part of an article.
OTHER_TAGS = frozenset("#root head title script style noscript template svg math iframe object canvas audio video form button select textarea input label fieldset nav footer aside dialog menu search".split()) - {"#root"}
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
OTHER_WORDS = re.compile(
    r"^(ads?|adverts?|advertise\w*|advertising|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|sidebars?|aside|nav\w*|menus?|breadcrumbs?|footers?|headers?|masthead"
    r"|comments?|commentlist|commentform|replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|newsletter\w*|subscri\w*|signup|login|popups?|modal|overlay|toolbar|pagination|pager|widgets?|skip|teasers?)$"
)
MAIN_WORDS = re.compile(r"^(content|post|entry|article|story|main|maincontent|articlebody|postbody)$")
#: Words by which a name like with-sidebar or comments-open tells a state of the page, not what the element is.
STATE_WORDS = frozenset("has have with without no not non open opened closed enabled disabled".split())
COMMENT_WORDS = re.compile(r"^(comments?|commentlist|commentform|replies|reply|respond|disqus)$")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What a browser doesn't show as text of the page.
_UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select button textarea".split())
#: Containers that the search for the content's node goes down into.
_HOLDERS = frozenset("#root html body main article section div center table tbody tr td form".split())
#: What may stand for each of several like things on a page.
_GROUPS = frozenset("article section div li dd blockquote tr td".split())


def _names(node: Node) -> list[list[str]]:
    """The words of each class and id."""
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split()
    return [[w for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", n).lower()) if w] for n in names]


def _is_other(words: list[str]) -> bool:
    """Whether a name says what no article is; entry-header and its like are a part of one."""
    if not STATE_WORDS.isdisjoint(words):
        return False
    other = [w for w in words if OTHER_WORDS.match(w)]
    return bool(other) and not (all(w in ("header", "headers") for w in other) and any(w != "main" and MAIN_WORDS.match(w) for w in words))


def declared_other(node: Node) -> bool:
    """Whether tag, role or visibility declare ``node`` to be no part of an article."""
    if node.tag in ("html", "body", "main", "#root"):
        return False
    if node.tag in OTHER_TAGS or not node.attrs:
        return node.tag in OTHER_TAGS
    a = node.attrs
    return a.get("role", "").lower() in OTHER_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def named_other(node: Node) -> bool:
    """Whether a class or id says that ``node`` is no part of an article."""
    return bool(node.attrs) and node.tag not in ("html", "body", "main", "#root") and any(map(_is_other, _names(node)))


def _is_region(node: Node) -> bool:
    if node.tag in ("html", "body", "#root"):
        return False
    if node.tag in ("article", "main") or node.attrs.get("role") == "main" or node.attrs.get("itemprop") == "articleBody":
        return True
    return bool(node.attrs) and any(any(MAIN_WORDS.match(w) for w in n) and not _is_other(n) for n in _names(node))


def _read(root: Node, number: dict[int, int], shield: set[int]) -> tuple[list[tuple[int, str, bool, int, bool]], dict[int, Node], list[Node]]:
    """Blocks (skeleton node, text, ruled out, outermost region, mostly links), the outermost regions, and those that
    only class or id words rule out. Such words don't count for nodes in ``shield``."""
    found: list[list] = []  # node, pieces of text, characters, of them in links, ruled out, outermost region
    regions: dict[int, Node] = {}
    held: list[Node] = []

    def walk(node: Node, block: list | None, out: bool, named: bool, region: int, link: bool, head: bool) -> list | None:
        """Returns the open block, or None once a block element has closed it."""
        own = node.tag in BLOCK
        if node.tag == "header":
            head, out = True, out or not region
        elif declared_other(node):
            out = True
        elif not named and id(node) not in shield and named_other(node):
            named = True
        if not out and (named or not region) and _is_region(node):
            if named:
                held.append(node)
                out = True
            else:
                region = id(node)
                regions[region] = node
        if own:
            block = None
        for c in node.children:
            if isinstance(c, str):
                if c.isspace() and block is None:
                    continue
                if block is None:
                    block = [number.get(id(_holder(node)), 0), [], 0, 0, out or named or head and _holder(node).tag not in _HEADINGS, region]
                    found.append(block)
                if (out or named) and not block[4]:  # an inline element that is ruled out
                    continue
                block[1].append(c)
                block[2] += len(c)
                block[3] += len(c) if link else 0
            elif c.tag == "br" or c.tag == "hr":
                if block is not None:
                    block[1].append(" ")
                if c.tag == "hr":
                    block = None
            elif c.tag in RAW or c.tag in _UNSEEN:
                block = None if c.tag in BLOCK else block
            else:
                block = walk(c, block, out, named, region, link or c.tag == "a", head)
        return None if own else block

    walk(root, None, False, False, 0, False, False)
    rows = []
    for node, pieces, size, linked, out, region in found:
        text = " ".join("".join(pieces).split())
        if text:
            rows.append((node, text, out, region, 2 * linked > size))
    return rows, regions, held


def _choose(rows: list, regions: dict[int, Node]) -> tuple[list[tuple[int, str, bool]], bool, int]:
    """(blocks with what is ruled out, whether there is a region, characters left)."""
    sizes = dict.fromkeys(regions, 0)
    for _, text, out, region, _ in rows:
        if region and not out:
            sizes[region] += len(text)
    chosen = max(sizes, key=sizes.__getitem__, default=0)
    is_region = bool(chosen and sizes[chosen])
    if is_region:
        kept = {r for r, node in regions.items() if _siblings(regions[chosen], node)}
        done = [(n, t, out or region not in kept) for n, t, out, region, _ in rows]
    else:
        done = [(n, t, out or links) for n, t, out, _, links in rows]
    return done, is_region, sum(len(t) for _, t, out in done if not out)


def read_page(html: str | None) -> tuple[str, bool, list[tuple[int, str, bool, bool, bool]], list[int]]:
    """(skeleton, whether markup names a main region, blocks in reading order, skeleton nodes that repeat) of a page; a block
    is (skeleton node, text, kept by markup alone, ruled out by markup, mostly links).

    Of the outermost article and main regions the one with the most text is kept whole, with its siblings. Class and
    id words rule out no element that is or holds a region with more text than is left otherwise.
    """
    root = parse(html or "")
    shape, number = skeleton(root)
    rows, regions, held = _read(root, number, set())
    done, is_region, left = _choose(rows, regions)
    best, size = None, 0
    for node in held:
        above = _above(node)
        if is_region and any(COMMENT_WORDS.match(w) for a in above for n in _names(a) if _is_other(n) for w in n):
            continue  # comments on the article
        own = sum(len(t) for _, t, out, _, _ in _read(node, number, {id(node)})[0] if not out)
        if own > size and (own > left or not is_region and (node.tag == "main" or node.attrs.get("role") == "main")):
            best, size = node, own
    if best:
        shield = {id(a) for node in held if _siblings(best, node) for a in _above(node)}
        rows, regions, _ = _read(root, number, shield)
        done, is_region, _ = _choose(rows, regions)
    return shape, is_region, [(n, t, not gone, out, links) for (n, t, gone), (_, _, out, _, links) in zip(done, rows, strict=True)], repeated(root, number)


def blocks_of(html: str | None) -> tuple[str, list[tuple[int, str, bool]]]:
    """(skeleton, [(skeleton node, text, whether markup alone leaves it out)]) of a page, in reading order."""
    shape, _, rows, _ = read_page(html)
    return shape, [(n, t, not kept) for n, t, kept, _, _ in rows]


def _above(node: Node) -> list[Node]:
    """``node`` and all it stands in."""
    out = [node]
    while (node := node.parent) is not None:
        out.append(node)
    return out


def _siblings(chosen: Node, other: Node) -> bool:
    """Whether ``other`` belongs with ``chosen``: articles in like places, and named regions and headings beside it."""
    if chosen.tag == other.tag == "article":
        return _place(chosen) == _place(other)
    return chosen is other or chosen.parent is other.parent and (other.tag in _HEADINGS or "article" not in (chosen.tag, other.tag))


def _place(node: Node) -> list[tuple[str, str]]:
    return [(a.tag, a.attrs.get("class", "")) for a in _above(node)[1:]]


def _holder(node: Node) -> Node:
    while node.tag not in BLOCK and node.parent is not None:
        node = node.parent
    return node


def slots(shape: str, reference: str) -> list[int]:
    """For each node of a page's skeleton the node of the reference it is aligned to; a node without one has -2 - r, where
    r is the node its nearest aligned ancestor has (-1: none has any)."""
    tree = read_skeleton(shape)
    out = [-1] * len(re.findall(r"[^()\s]+", shape))
    for mine, other in match(tree, read_skeleton(reference))[1]:
        out[mine] = other
    todo = [(tree, -1)]
    while todo:
        (_, n, kids), above = todo.pop()
        if out[n] >= 0:
            above = out[n]
        elif above >= 0:
            out[n] = -2 - above
        todo += [(k, above) for k in kids]
    return out


def content_slots(reference: str, mass: dict[int, tuple[int, int]], repeats: frozenset[int] | set[int] = frozenset(), most: float = 0.8) -> tuple[list[int], list[int]]:
    """(slots of the content's region, those of them that are content): the region is the deepest container of
    ``reference`` with at least ``most`` of all varying text outside links.

    ``mass`` has by slot the characters of its different texts that are mostly links, and of the others; ``repeats`` the
    slots that stand for several neighbours on many pages. Of these, groups (list items and what has blocks inside, as comments have) don't count on
    the way down, unless they hold more text than all else; inside the region groups without headings are no
    content, but for plain list items. Headings that stand beside the way down belong to the region; slots with more text in links
    than outside are no content. Text in nodes the reference lacks (slot -2 - r) goes with node r.
    """
    own: dict[int, int] = {}
    for slot, (_, plain) in mass.items():
        at = slot if slot >= 0 else -2 - slot
        own[at] = own.get(at, 0) + plain
    top = read_skeleton(reference)
    order, groups = [], set()  # nodes with whether they stand in a group, and the groups
    todo = [(top, False)]
    while todo:
        node, inner = todo.pop()
        tag, n, kids = node
        if n in repeats and (tag == "li" or kids and tag in _GROUPS) and not inner:
            groups.add(n)
            inner = True
        order.append((node, inner))
        todo += [(k, inner) for k in kids]
    text = {inner: sum(own.get(node[1], 0) for node, i in order if i == inner) for inner in (True, False)}
    if not text[True] + text[False]:
        return [], []
    if text[True] > text[False]:
        groups = set()
    total: dict[int, int] = {}
    for (tag, n, kids), inner in reversed(order):
        total[n] = (own.get(n, 0) if not (inner and groups) else 0) + sum(total[k[1]] for k in kids)
    goal, heads, node = most * total[top[1]], [], top
    while True:
        best = max(node[2], key=lambda k: total[k[1]], default=None)
        if best is None or best[0] not in _HOLDERS or total[best[1]] < goal or best[1] in groups:
            break
        heads += [k[1] for k in node[2] if k[0] in _HEADINGS]
        node = best
    inside, dropped, todo = set(heads), set(), [(node, False)]
    while todo:
        one, out = todo.pop()
        tag, n, kids = one
        out = out or n in groups and (tag != "li" or bool(kids)) and not _has_heading(one)
        inside |= {n, -2 - n}
        dropped |= {n, -2 - n} if out else set()
        todo += [(k, out) for k in kids]
    return sorted(inside), sorted(n for n in inside - dropped if mass.get(n, (0, 0))[0] <= mass.get(n, (0, 0))[1])


def _has_heading(node: tuple) -> bool:
    return node[0] in _HEADINGS or any(map(_has_heading, node[2]))


PARSED = "page_id long, url string, host string, shape string, region boolean, repeated array<int>, blocks array<struct<node: int, text: string, kept: boolean, gone: boolean, links: boolean>>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """A row a page with its skeleton and its blocks, all that a reader would see among them."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("kept", pa.bool_()), ("gone", pa.bool_()), ("links", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                done = [read_page(h) for h in part.column(3).to_pylist()]
                blocks = [[dict(zip(("node", "text", "kept", "gone", "links"), r, strict=True)) for r in d[2]] for d in done]
                cols = [part.column(0), part.column(1), part.column(2), pa.array([d[0] for d in done]), pa.array([d[1] for d in done]), pa.array([d[3] for d in done], pa.list_(pa.int32())), pa.array(blocks, kind)]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "shape", "region", "repeated", "blocks"])

    return pages.mapInArrow(run, PARSED)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _aligned(shapes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [slots(s, r) for s, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["host", "shape", "slots"])

    return shapes.select("host", "shape", "reference").mapInArrow(run, "host string, shape string, slots array<int>")


def _induced(masses: DataFrame) -> DataFrame:
    """host, inside, content (slots): a row a host, from its reference, the characters of its slots and those that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [content_slots(r, {m["slot"]: (m["linked"], m["plain"]) for m in ms}, set(again or ())) for r, ms, again in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            cols = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["host", "inside", "content"])

    return masses.select("host", "reference", "masses", "repeats").mapInArrow(run, "host string, inside array<int>, content array<int>")


def extract(pages: DataFrame, least_pages: int = 5, share: float = 0.5, few_bytes: int = 16 << 20, trace: bool = False, repeats: float = 0.3) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A block is template if its text stands in its slot on pages with at least ``least_pages`` different longest other
    blocks, and these are at least ``share`` of the host's; so copies of a page can't make its text template. A host
    needs pages with ``least_pages`` different longest blocks for ``content_slots`` to be looked for; different texts of
    a slot count once each. Slots bound the content; inside, markup removes what it declares to be something else, and keeps
    what it names as the article where that holds most of the content. A page that the host's slots don't fit (they hold less than half
    of the article markup names), or a host without slots, has its markup alone. A slot counts as repeated where it stands for several
    neighbours on a share of ``repeats`` of the host's pages. Null and empty html give an empty text; pages without a host form one host; repeated rows and
    null ids are extracted one by one; other columns are ignored; an empty table gives an empty result. Tables of a
    row a host or skeleton are sent to all tasks up to ``few_bytes`` (measured) and joined by shuffles beyond.
    ``trace`` adds markup_text and slot_text, what either would give alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    parsed = common.materialise(parsed_pages(rows), "html-blocks")
    shapes = common.materialise(parsed.groupBy("host", "shape").agg(F.count("*").alias("n")), "html-shapes")
    best = F.max_by("shape", F.struct("n", -F.length("shape"), "shape")).alias("reference")
    references = common.materialise(shapes.groupBy("host").agg(best), "html-references")
    aligned = common.materialise(_aligned(shapes.join(_sent(references, few_bytes), "host")), "html-slots")
    blocks = parsed.join(_sent(aligned, few_bytes), ["host", "shape"])
    lengths = F.transform("blocks", lambda b: F.struct(F.length(b["text"]).alias("n"), F.xxhash64(b["text"]).alias("h")))
    blocks = blocks.select("host", "blocks", "slots", F.slice(F.sort_array(lengths, asc=False), 1, 2).alias("longest"))
    each = blocks.select("host", "slots", "longest", F.explode("blocks").alias("b"))
    each = each.select("host", F.get("slots", F.col("b.node")).alias("slot"), F.xxhash64("b.text").alias("text"), F.length("b.text").alias("size"), "b.links", "longest")
    others = F.filter("longest", lambda x: x["h"] != F.col("text"))
    each = each.withColumn("other", F.get(others, F.lit(0))["h"]).drop("longest")
    each = common.materialise(each.distinct(), "html-texts")
    whole = each.where("other IS NOT NULL").select("host", "other").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    whole = common.materialise(whole, "html-pages")
    fixed = each.where("other IS NOT NULL").groupBy("host", "slot", "text").agg(F.count_distinct("other").alias("n")).where(F.col("n") >= least_pages)
    fixed = fixed.join(whole, "host").where(F.col("n") >= share * F.col("pages"))
    fixed = common.materialise(fixed.groupBy("host").agg(F.collect_set(F.struct("slot", "text")).alias("fixed")), "html-template")
    texts = each.groupBy("host", "slot", "text").agg(F.max("size").alias("size"), F.max("links").alias("links"))
    size = lambda links: F.sum(F.when(F.col("links") == links, F.col("size")).otherwise(0))
    masses = texts.groupBy("host", "slot").agg(size(True).alias("linked"), size(False).alias("plain"))
    masses = masses.groupBy("host").agg(F.collect_list(F.struct("slot", "linked", "plain")).alias("masses"))  # as many as the reference has nodes, twice at most
    all_pages = parsed.groupBy("host").agg(F.count("*").alias("all_pages"))
    again = parsed.select("host", "shape", "repeated").join(_sent(aligned, few_bytes), ["host", "shape"]).select("host", F.explode(F.array_distinct(F.transform("repeated", lambda n: F.get("slots", n)))).alias("slot"))
    again = again.where("slot >= 0").groupBy("host", "slot").agg(F.count("*").alias("n")).join(all_pages, "host").where(F.col("n") >= repeats * F.col("all_pages"))
    again = again.groupBy("host").agg(F.collect_list("slot").alias("repeats"))
    masses = masses.join(whole.where(F.col("pages") >= least_pages), "host", "left_semi").join(references, "host").join(again, "host", "left")
    content = common.materialise(_induced(masses), "html-content")
    final = parsed.join(_sent(aligned, few_bytes), ["host", "shape"]).join(_sent(fixed, few_bytes), "host", "left").join(_sent(content, few_bytes), "host", "left")
    mine = F.transform("blocks", lambda b: F.struct(F.get("slots", b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("text"), b["text"].alias("words"), b["kept"].alias("kept"), b["gone"].alias("gone")))
    template = lambda b: F.coalesce(F.array_contains("fixed", F.struct(b["slot"].alias("slot"), b["text"].alias("text"))), F.lit(False))
    final = final.select("page_id", "url", "region", "inside", "content", F.filter(mine, lambda b: ~template(b)).alias("left"))
    within = lambda slots, b: F.coalesce(F.array_contains(slots, b["slot"]), F.lit(False))
    final = final.select(
        "page_id", "url", "region", F.filter("left", lambda b: b["kept"]).alias("marked"), F.filter("left", lambda b: b["kept"] & within("inside", b)).alias("bounded"),
        F.filter("left", lambda b: ~b["gone"] & within("content", b)).alias("induced"),
    )
    chars = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b["words"]))
    size = F.struct(*(chars(F.col(c)).alias(c) for c in ("marked", "bounded", "induced")), chars(F.filter("induced", lambda b: b["kept"])).alias("shared"))
    final = final.withColumn("n", size)
    joined = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["words"]), "\n")
    agreed = F.col("region") & (2 * F.col("n.shared") >= F.col("n.induced"))  # markup names a region that holds the content
    fits = 2 * F.col("n.bounded") >= F.col("n.marked")  # the host's slots fit this page
    text = F.when((F.col("n.induced") == 0) | agreed & ~fits, joined("marked")).when(agreed, joined("bounded")).otherwise(joined("induced"))
    more = [joined("marked").alias("markup_text"), joined("induced").alias("slot_text")] if trace else []
    return final.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), *more)


def _sent(df: DataFrame, few_bytes: int) -> DataFrame:
    """``df``, to be sent to all tasks if it is small: its strings and arrays are measured as the JSON they would be."""
    size = df.select(F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= few_bytes else df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
