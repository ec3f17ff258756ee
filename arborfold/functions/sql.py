"""The page functions in SQL: table functions to put behind LATERAL or over a whole table, and scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import json_text, patterns, url
from .html import parse
from .page import Page
from .snapshot import page_snapshot

_NODE = "node_id int, parent_id int, depth int, subtree_end int, kind string, tag string, text string, ref int"


class HtmlNodes:
    """The nodes of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        for r in parse(html or ""):
            yield r.node_id, r.parent_id, r.depth, r.subtree_end, r.kind, r.tag, r.text, r.ref


class HtmlSelect:
    """The hits of a selector with their text; no hits of a null one."""

    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        page = Page(html)
        for r in page.select(selector) if selector else ():
            yield r.node_id, r.tag, page.text(r), dict(reversed(r.attrs))


class FormFields:
    """The successful controls of every form."""

    def eval(self, html: str) -> Iterator[tuple]:
        page = Page(html)
        for form in page.rows:
            if form.tag == "form":
                for k, (name, value) in enumerate(page.form_fields(form), 1):
                    yield form.node_id, k, name, value


class JsonBlocks:
    """Embedded JSON by the first selector that finds it."""

    def eval(self, html: str) -> Iterator[tuple]:
        for k, (_, selector, raw) in enumerate(Page(html).json_blocks()):
            yield k, selector, raw


class PageFetches:
    """The fetch calls of a page's scripts, as far as their text tells."""

    def eval(self, html: str, at: str) -> Iterator[tuple]:
        for k, (method, address, body) in enumerate(Page(html, at).fetches()):
            yield k, method, address, body


class PagesNodes:
    """The nodes of all pages of a table (page_id, html, more), a batch at once."""

    KIND = f"page_id long, {_NODE}"
    ARROW = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in KIND.split(", ")])

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        schema, rows = self.ARROW, []
        for page_id, html in zip(pages.column("page_id").to_pylist(), pages.column("html").to_pylist(), strict=True):
            rows += [(page_id, *row) for row in HtmlNodes().eval(html)]
        yield pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


#: Table functions by name: what a row of each is.
TABLES = {
    "html_nodes": (HtmlNodes, _NODE), "html_select": (HtmlSelect, "node_id int, tag string, text string, attrs map<string, string>"), "form_fields": (FormFields, "form_node int, seq int, name string, value string"),
    "json_blocks": (JsonBlocks, "seq int, selector string, raw string"), "page_fetches": (PageFetches, "seq int, method string, url string, body string"),
}
SCALARS = {
    "page_snapshot": page_snapshot, "url_parts": url.url_parts, "url_join": url.url_join, "json_get": json_text.json_get, "json_normal": json_text.json_normal, "regex_exec": patterns.regex_exec,
    "regex_match": patterns.regex_match, "regex_replace_bounded": patterns.regex_replace, "regex_split_bounded": patterns.regex_split,
}


def register(spark: SparkSession) -> None:
    """Make all of them known to a session: ``SELECT p.page_id, f.* FROM pages p, LATERAL form_fields(p.html) f``, or
    ``SELECT * FROM pages_nodes(TABLE(SELECT page_id, html FROM pages))``."""
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
    spark.udtf.register("pages_nodes", F.arrow_udtf(PagesNodes, returnType=PagesNodes.KIND))
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
