"""A page as short lines of roles, names and numbered actions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import INTERACTIVE, SKIPPED, Row, collapse, parse

#: Fixed values.
INLINE = frozenset("b i em strong u s small abbr code mark sub sup wbr br font q cite time kbd samp var".split())
STRUCTURE = frozenset(
    "html body head div span section article header footer main colgroup tbody thead tfoot tr dl dd dt figure figcaption picture fieldset legend center hgroup".split()
)
KEPT_ATTRS = ("id", "type", "name", "placeholder", "value", "role", "aria-label", "alt", "title")
NAMING_ATTRS = ("placeholder", "aria-label", "alt", "title")
KEPT_LINES = frozenset("nav form table ul ol select iframe video audio details".split())
ROLES = {"a": "link", "p": "paragraph", "img": "image", "textarea": "textbox", "select": "combobox", "ul": "list", "ol": "list", "li": "listitem", "th": "columnheader", "td": "cell", "nav": "navigation", "hr": "separator"}
INPUT_ROLES = {"submit": "button", "button": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "hidden": "hidden-input"}


def role_of(tag: str, attrs: list[tuple[str, str]]) -> str:
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "0123456789":
        return "heading"
    if tag == "input":
        return INPUT_ROLES.get(next((v for k, v in attrs if k == "type"), "text"), "textbox")
    return ROLES.get(tag, tag)


def truncate(text: str, most: int) -> str:
    """At most ``most`` UTF-8 bytes, cut between characters."""
    data = text.encode()
    return text if len(data) <= most else data[:most].decode(errors="ignore")


class Renderer:
    """Writes the rows of a page as lines."""

    def __init__(self, rows: list[Row]):
        self.rows, self.children = rows, [[] for _ in rows]
        for r in rows[1:]:
            self.children[r.parent_id].append(r)
        self.lines: list[str] = []
        self.ref = 0

    def inline(self, n: int) -> str:
        found, todo = [], self.children[n][::-1]
        while todo:
            r = todo.pop()
            if r.kind == "text":
                found.append(r.text)
            elif r.tag in INLINE:
                todo += self.children[r.node_id][::-1]
        return collapse(" ".join(found))

    def line(self, r: Row, text: str) -> str:
        out = f"- {role_of(r.tag, r.attrs)}"
        if r.tag in INTERACTIVE:
            self.ref += 1
            out += f" #{self.ref}"
        if text:
            out += f" '{truncate(text, 120)}'"
        for name in ("href", "src"):
            value = next((v for k, v in r.attrs if k == name), None)
            if value is not None:
                out += f" -> {truncate(value, 120)}"
        kept = [(k, v) for k, v in r.attrs if v and k in KEPT_ATTRS and not (text and k in NAMING_ATTRS)]
        return out + "".join(f" [{k}={truncate(v, 80)}]" for k, v in kept)

    def render(self) -> str:
        title = next((self.inline(r.node_id) for r in self.rows if r.tag == "title"), "")
        todo = [(r, 1) for r in self.children[0][::-1]]
        while todo:
            r, depth = todo.pop()
            pad = "  " * depth
            if r.kind == "text":
                if shown := collapse(r.text):
                    self.lines.append(f"{pad}'{shown}'")
                continue
            if r.kind != "element" or r.tag in SKIPPED or r.tag == "title":
                continue
            kids = self.children[r.node_id]
            named = any(v and (k in KEPT_ATTRS or k in ("href", "src")) for k, v in r.attrs)
            text = self.inline(r.node_id)
            silent = not text and r.tag not in INTERACTIVE and r.tag not in KEPT_LINES and r.tag not in INLINE
            if not named and (r.tag in STRUCTURE or silent):
                todo += [(c, depth) for c in kids[::-1]]
                continue
            self.lines.append(pad + self.line(r, text))
            todo += [(c, depth + 1) for c in kids[::-1] if c.kind != "text" and c.tag not in INLINE]
        return "\n".join([f"page '{title}'" if title else "page", *self.lines]) + "\n"


def snapshot(html: str) -> str:
    return Renderer(parse(html)).render()


@F.arrow_udf(T.StringType())
def page_snapshot(html: pa.Array) -> pa.Array:
    """The snapshot of each page; null for null."""
    return pa.array([None if h is None else snapshot(h) for h in html.to_pylist()], pa.string())
