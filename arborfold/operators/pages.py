"""Relations made of pages in the pass that parses them.

Each function takes pages (page_id, url, html) and parses every page once, in Arrow batches, without a shuffle:
selectors are matched and text is gathered where the tree is, and only what was asked for leaves the worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import tree, url
from ..functions.page import ActionError, Page, attr, match, role
from ..functions.script_tokens import ScriptSyntaxError, tokens
from ..functions.script_tree import number_text
from ..functions.script_tree import walk as walk_tree

BATCH, TEXT = 20_000, 4 << 20  # rows, and characters of text, with which a batch leaves a worker


def per_page(pages: DataFrame, make: Callable[[int, Page], Iterable[tuple]], schema: str, bare: bool = True) -> DataFrame:
    """The rows that ``make`` (page_id, parsed page) gives for each page; null html is an empty page. Without ``bare`` a
    named reference counts only where a semicolon ends it, here and in the functions that take it."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)
            yield from _batches((make(page_id, Page(html.as_py(), at, bare)) for page_id, at, html in found), arrow)

    given = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    return pages.select(F.col("page_id").cast("long"), given, F.col("html").cast("string")).mapInArrow(run, schema)


def _batches(found: Iterable[Iterable[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of pages in batches, each full by its rows or by their text: a worker never holds that of a whole batch of pages."""
    rows, held = [], 0
    for made in found:
        for row in made:
            rows.append(row)
            held += sum(len(x) for x in row if type(x) is str)
            if len(rows) >= BATCH or held >= TEXT:
                yield _batch(rows, schema)
                rows, held = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def select(pages: DataFrame, *selectors: str, text: bool = False, bare: bool = True) -> DataFrame:
    """Hits of one or more selectors: page_id, selector, node_id, parent_id, depth, ref, role, tag, attrs, and text if asked for."""
    for s in selectors:
        match([], s)  # a selector that can't be read fails here

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        for s in selectors:
            for r in page.select(s):
                attrs = [{"name": k, "value": v} for k, v in r.attrs]
                yield page_id, s, r.node_id, r.parent_id, r.depth, r.ref, role(r), r.tag, attrs, *([page.text(r)] if text else [])

    return per_page(pages, make, "page_id long, selector string, node_id int, parent_id int, depth int, ref int, role string, tag string, attrs array<struct<name: string, value: string>>" + ", text string" * text, bare)


def count(pages: DataFrame, selector: str) -> DataFrame:
    """Hits a page, for pages that have any: page_id, n."""
    match([], selector)

    def make(page_id: int, page: Page) -> list[tuple]:
        n = len(page.select(selector))
        return [(page_id, n)] if n else []

    return per_page(pages, make, "page_id long, n long")


def within(pages: DataFrame, root: str, selector: str) -> DataFrame:
    """Hits that stand below a hit of ``root``: page_id, node_id."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        spans = [(r.node_id, r.subtree_end) for r in page.select(root)]
        end = 0  # hits come in document order, so one span that reaches furthest tells
        at = 0
        for r in page.select(selector):
            while at < len(spans) and spans[at][0] < r.node_id:
                end = max(end, spans[at][1])
                at += 1
            if r.node_id < end:
                yield page_id, r.node_id

    return per_page(pages, make, "page_id long, node_id int")


def closest(pages: DataFrame, targets: str, selector: str) -> DataFrame:
    """For each hit of ``targets`` the nearest of itself and its ancestors that matches: page_id, node_id, closest_id."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        hits = set(match(page.rows, selector))
        for r in page.select(targets):
            up = r
            while up is not None and up.node_id not in hits:
                up = page.rows[up.parent_id] if up.parent_id is not None else None
            yield page_id, r.node_id, None if up is None else up.node_id

    return per_page(pages, make, "page_id long, node_id int, closest_id int")


def contains(pages: DataFrame, outer: str, inner: str) -> DataFrame:
    """For the first hits of two selectors whether the one is or holds the other: page_id, contains."""

    def make(page_id: int, page: Page) -> list[tuple]:
        a, b = page.select(outer)[:1], page.select(inner)[:1]
        return [(page_id, a[0].node_id <= b[0].node_id < a[0].subtree_end)] if a and b else []

    return per_page(pages, make, "page_id long, contains boolean")


#: Kinds by the bit a walker's mask has for them.
MASK = {"element": 1, "text": 4, "comment": 128, "document": 256, "fragment": 1024}
ACCEPT, REJECT, SKIP = 1, 2, 3


def walk(page: Page, mask: int = 0xFFFFFFFF, verdict: Callable | None = None, root: int = 0) -> Iterator:
    """The nodes a tree walker goes through from its root on: kinds not in the mask are skipped unasked, a rejected
    node takes its subtree along, a skipped one does not; the root itself is left out."""
    k, end = root + 1, page.rows[root].subtree_end
    while k < end:
        r = page.rows[k]
        k += 1
        if not mask & MASK.get(r.kind, 0):
            continue
        v = ACCEPT if verdict is None else verdict(r)
        if v not in (ACCEPT, REJECT, SKIP):
            raise ValueError(f"no verdict of a walker: {v!r}")
        if v == REJECT:
            k = r.subtree_end
        elif v == ACCEPT:
            yield r


def walked(pages: DataFrame, mask: int = 0xFFFFFFFF, rejected: str | None = None, skipped: str | None = None) -> DataFrame:
    """What a walker shows, with its neighbours in its order: page_id, node_id, kind, previous_id, next_id. Hits of
    ``rejected`` go with their subtrees, hits of ``skipped`` alone."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        no, over = (set(match(page.rows, s)) if s else set() for s in (rejected, skipped))
        shown = list(walk(page, mask, lambda r: REJECT if r.node_id in no else SKIP if r.node_id in over else ACCEPT))
        for k, r in enumerate(shown):
            yield page_id, r.node_id, r.kind, shown[k - 1].node_id if k else None, shown[k + 1].node_id if k + 1 < len(shown) else None

    return per_page(pages, make, "page_id long, node_id int, kind string, previous_id int, next_id int")


def titles(pages: DataFrame, bare: bool = True) -> DataFrame:
    def make(page_id: int, page: Page) -> list[tuple]:
        title = page.title()
        return [] if title is None else [(page_id, title)]

    return per_page(pages, make, "page_id long, title string", bare)


def stats(pages: DataFrame) -> DataFrame:
    """page_id, nodes, names (distinct ones of tags and attributes)."""
    return per_page(pages, lambda page_id, page: [(page_id, *page.stats())], "page_id long, nodes long, names int")


def _resolved(page: Page, text: str) -> tuple[str | None, str | None]:
    try:
        return page.resolve(text), None
    except url.UrlError as e:
        return None, str(e)


def links(pages: DataFrame, bare: bool = True) -> DataFrame:
    """Every a[href] with its text, and where it leads: page_id, node_id, ref, text, href, target_url, error."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        for r in page.rows:
            if r.tag == "a" and (href := attr(r, "href")) is not None:
                yield page_id, r.node_id, r.ref, page.text(r), href, *_resolved(page, href)

    return per_page(pages, make, "page_id long, node_id int, ref int, text string, href string, target_url string, error string", bare)


def json_blocks(pages: DataFrame) -> DataFrame:
    """Embedded JSON: page_id, node_id, selector, raw (white space collapsed); a block counts for its first selector."""
    return per_page(pages, lambda page_id, page: [(page_id, r.node_id, s, raw) for r, s, raw in page.json_blocks()], "page_id long, node_id int, selector string, raw string")


def json_lines(pages: DataFrame, path: str | None = None) -> DataFrame:
    """What the blocks hold at a dotted path, or whole: page_id, seq, line."""
    return per_page(pages, lambda page_id, page: [(page_id, k, line) for k, line in enumerate(page.json_lines(path))], "page_id long, seq int, line string")


def form_fields(pages: DataFrame) -> DataFrame:
    """Successful controls of every form: page_id, form_node, seq, name, value."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        for form in page.rows:
            if form.tag == "form":
                for k, (name, value) in enumerate(page.form_fields(form), 1):
                    yield page_id, form.node_id, k, name, value

    return per_page(pages, make, "page_id long, form_node int, seq int, name string, value string")


def _request(make: Callable[[], tuple]) -> tuple:
    try:
        return *make(), None
    except (ActionError, url.UrlError) as e:
        return None, None, None, str(e)


def submit_requests(pages: DataFrame, selector: str | None = None, values: list[tuple[str, str]] = (), every: bool = True) -> DataFrame:
    """The requests that forms make: page_id, form_node, method, url, body (null for GET), error.

    Every form, or with ``selector`` the first form among its hits; ``values`` replace or add fields.
    """

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        first = page.find_form(selector)
        for form in [r for r in page.rows if r.tag == "form"] if every and not selector else [first] if first else []:
            method, at, body, error = _request(lambda f=form: page.submit(f, list(values)))
            yield page_id, form.node_id, method, at, body if method == "POST" else None, error

    return per_page(pages, make, "page_id long, form_node int, method string, url string, body string, error string")


def click_requests(pages: DataFrame, bare: bool = True) -> DataFrame:
    """What clicking each numbered element asks for: page_id, ref, action (link, submit, unsupported), method, url, body."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        sent: dict[int, tuple] = {}  # a form's request is the same for all that send it
        for ref, r in page.refs().items():
            form = page.form_of(r)
            if form is None:
                method, at, body, error = _request(lambda ref=ref: page.click(ref))
            else:
                if form.node_id not in sent:
                    sent[form.node_id] = _request(lambda f=form: page.submit(f))
                method, at, body, error = sent[form.node_id]
            link = r.tag == "a" and attr(r, "href") is not None
            submit = not link and not (error or "").startswith("unsupported: click")
            yield page_id, ref, "link" if link else "submit" if submit else "unsupported", method, at, body

    return per_page(pages, make, "page_id long, ref int, action string, method string, url string, body string", bare)


def fetch_calls(pages: DataFrame) -> DataFrame:
    """The fetch calls in pages' own scripts, as far as their text tells, as requests that can be made again: page_id, seq,
    method, url, body, replay. Read from the scripts' trees, so comments and texts give none."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        for k, (method, at, body) in enumerate(page.fetches()):
            yield page_id, k, method, at, body, replay(method, at, body)

    return per_page(pages, make, "page_id long, seq int, method string, url string, body string, replay string")


def replay(method: str, at: str, body: str = "") -> str:
    """A request as a line of a script."""
    quoted = body.replace("\\", "\\\\").replace('"', '\\"')
    return f"replay: req {at} -X {method}" + (f' -d "{quoted}"' if body else "")


def script_tokens(pages: DataFrame) -> DataFrame:
    """The tokens of pages' inline scripts: page_id, script (its place among them), seq, kind, text, value, at, line_before.

    A script that can't be read gives one row of kind error, with the reason as its value.
    """

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        for n, body in enumerate(b for _, _, b in page.scripts() if b is not None):
            try:
                for k, t in enumerate(tokens(body)):
                    yield page_id, n, k, t.kind, t.text, number_text(t.value) if isinstance(t.value, float) else t.value, t.at, t.line_before
            except ScriptSyntaxError as e:
                yield page_id, n, 0, "error", None, str(e), None, None

    return per_page(pages, make, "page_id long, script int, seq int, kind string, text string, value string, at int, line_before boolean")


def script_nodes(pages: DataFrame) -> DataFrame:
    """The trees of pages' inline scripts as a relation: page_id, script, node (in the order of the text), parent, part (what it
    is to its parent), depth, kind, value, at. A script that can't be read gives one row of kind error, with the reason as its value."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        for n, (_, root, error) in enumerate(page.trees()):
            if root is None:
                yield page_id, n, 0, None, None, 0, "error", error, None
                continue
            for k, parent, part, depth, node in walk_tree(root):
                yield page_id, n, k, parent, part, depth, node.kind, node.value, node.at

    return per_page(pages, make, "page_id long, script int, node int, parent int, part string, depth int, kind string, value string, at int")


def bridge(pages: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """The navigation that a page's scripts ask for, where they do: page_id, kind (link, submit, postback), method, url, body.

    With ``responses`` (as ``scripts.answers`` takes them) it is followed, once: status, at, html and error of the
    answer, by one join; a page that is reached is not asked again.
    """

    def make(page_id: int, page: Page) -> list[tuple]:
        asked = page.bridge()
        return [(page_id, *asked)] if asked else []

    asked = per_page(pages, make, "page_id long, kind string, method string, url string, body string")
    if responses is None:
        return asked
    from .scripts import answers

    held = answers(responses)
    fits = (F.col("method") == F.col("r_method")) & (F.regexp_replace("url", "#.*$", "") == F.col("r_url")) & (F.col("r_form").isNull() | (F.col("body") == F.col("r_form")))
    out = asked.join(held, fits, "left")
    return out.select("page_id", "kind", "method", "url", "body", F.col("r_status").alias("status"), F.col("r_at").alias("at"), F.col("r_html").alias("html"), F.when(F.col("r_url").isNull(), "not found").otherwise(F.col("r_error")).alias("error"))


def serialize(pages: DataFrame, selector: str | None = None, inner: bool = False, bare: bool = True) -> DataFrame:
    """HTML text of whole pages, or of each hit: page_id, node_id, html."""

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        nodes = tree.from_rows(page.rows)
        for k in match(page.rows, selector) if selector else [0]:
            yield page_id, k, nodes[k].inner_html() if inner else nodes[k].outer_html()

    return per_page(pages, make, "page_id long, node_id int, html string", bare)


def raw_text(pages: DataFrame, selector: str, bare: bool = True) -> DataFrame:
    """The text below each hit as it stands: page_id, node_id, text."""
    return per_page(pages, lambda page_id, page: [(page_id, r.node_id, page.raw_text(r)) for r in page.select(selector)], "page_id long, node_id int, text string", bare)


def edit(pages: DataFrame, edits: list[tuple], bare: bool = True) -> DataFrame:
    """Pages after edits (operation, selector, more; see ``tree.edit``) in turn: page_id, url, html, edited (hits in all)."""

    def make(page_id: int, page: Page) -> list[tuple]:
        root = tree.from_rows(page.rows)[0]
        n = sum(tree.edit(root, *e) for e in edits)
        return [(page_id, page.at, root.outer_html(), n)]

    return per_page(pages, make, "page_id long, url string, html string, edited int", bare)


def written(pages: DataFrame) -> DataFrame:
    """Pages after what their own scripts plainly write (``Page.write``), scripts left in: page_id, url, html, writes."""
    return per_page(pages, lambda page_id, page: [(page_id, page.at, *tree.written(page))], "page_id long, url string, html string, writes int")


def script_sources(pages: DataFrame, responses: DataFrame, most: int = 32) -> DataFrame:
    """What pages would run: page_id, seq, src (its address, null for inline), body (inline, or that of the source's response).

    Addresses are resolved against the page's, http and https alone, each once and ``most`` a page; those without a
    response in ``responses`` (url, body) have a null body. One join on the address.
    """

    def make(page_id: int, page: Page) -> Iterator[tuple]:
        seen: set[str] = set()
        for k, (_, src, body) in enumerate(page.scripts(1 << 30)):
            at = None
            if src is not None:
                at, _ = _resolved(page, src)
                if at is None or not at.startswith(("http:", "https:")) or at in seen or len(seen) >= most:
                    continue
                seen.add(at)
            yield page_id, k, at, body

    found = per_page(pages, make, "page_id long, seq int, src string, body string")
    got = responses.select(F.col("url").alias("src"), F.col("body").alias("fetched"))
    return found.join(got, "src", "left").select("page_id", "seq", "src", F.coalesce("body", "fetched").alias("body"))
