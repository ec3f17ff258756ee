"""HTML text to a table of nodes in document order.

The recovery rules are this engine's own and deliberately simple: an end tag closes the nearest open element of its
name; a few tags end the nearest open element of the same name wherever it stands; nothing is synthesised.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .entities import decode

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = frozenset("script style title textarea".split())
IMPLIED_END = frozenset("li p tr td th dt dd option".split())
SKIPPED = frozenset("script style svg noscript template".split())
INTERACTIVE = frozenset("a input button select textarea summary".split())

_NAME = re.compile(r"[^\s/>=]*", re.A)
_SPACE = re.compile(r"\s*", re.A)
#: An attribute as most are written; others are read in steps.
_PLAIN = re.compile(r"""\s*([^\s/>="']+)(?:="([^"]*)"|(?=>|\s+[^\s=]))""", re.A)
#: What counts as white space, by Unicode.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


class Row(NamedTuple):
    """A node; ``elem_ord`` counts element siblings from 1; descendants are the ids between node_id and subtree_end."""

    node_id: int
    parent_id: int | None
    ord: int
    elem_ord: int | None
    elem_total: int
    depth: int
    subtree_end: int
    kind: str
    tag: str | None
    attrs: list[tuple[str, str]]
    text: str | None
    ref: int | None


class Draft:
    """A node of which its place among others is not yet told."""

    __slots__ = ("kind", "tag", "attrs", "text", "parent", "children", "depth")

    def __init__(self, kind: str, tag: str | None, attrs: list[tuple[str, str]], text: str | None, parent: int | None):
        self.kind, self.tag, self.attrs, self.text, self.parent = kind, tag, attrs, text, parent
        self.children: list[int] = []
        self.depth = 0


class _Builder:
    def __init__(self) -> None:
        self.rows: list[Draft] = []
        self.open: list[int] = []
        self.open.append(self.add("document"))

    def add(self, kind: str, tag: str | None = None, attrs: list | None = None, text: str | None = None) -> int:
        n, parent = len(self.rows), self.open[-1] if self.open else None
        own = Draft(kind, tag, attrs or [], text, parent)
        self.rows.append(own)
        if parent is not None:
            above = self.rows[parent]
            above.children.append(n)
            own.depth = above.depth + 1
        return n

    def text(self, text: str) -> None:
        kids = self.rows[self.open[-1]].children
        if kids and self.rows[kids[-1]].kind == "text":
            self.rows[kids[-1]].text += text
        elif text:
            self.add("text", text=text)

    def close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[k]].tag == tag:
                del self.open[k:]
                return


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def _attributes(html: str, at: int, bare: bool) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes from ``at`` on: (pairs, whether the tag closes itself, position behind the tag)."""
    if html.startswith(">", at):
        return [], False, at + 1
    found = []
    while True:
        while plain := _PLAIN.match(html, at):
            found.append((plain[1], decode(plain[2] or "", bare)))
            at = plain.end()
        at = _SPACE.match(html, at).end()
        if at >= len(html) or html[at] == ">":
            return found, False, min(at + 1, len(html))
        if html[at] == "/":
            if html.startswith("/>", at):
                return found, True, at + 2
            at += 1
            continue
        name = _NAME.match(html, at)
        at = _SPACE.match(html, name.end()).end()
        value = ""
        if at < len(html) and html[at] == "=":
            at = _SPACE.match(html, at + 1).end()
            if at < len(html) and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                end = len(html) if end < 0 else end
                value, at = html[at + 1 : end], min(end + 1, len(html))
            else:
                word = _NAME.match(html, at)
                value, at = word[0], word.end()
        if name[0]:
            found.append((name[0], decode(value, bare)))


def parse(html: str, bare: bool = True) -> list[Row]:
    """The nodes of a page, the document first; ``bare`` as in ``entities.decode``."""
    b, at = _Builder(), 0
    behind = lambda k: (html.find(">", k) + 1) or len(html)
    while at < len(html):
        lead = html[at + 1 : at + 2]
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            if html[at:end].strip(_SPACES):
                b.text(decode(html[at:end], bare))
            at = end
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            b.add("comment", text=html[at + 4 : end if end >= 0 else len(html)])
            at = end + 3 if end >= 0 else len(html)
        elif lead and lead in "!?":
            at = behind(at)
        elif lead == "/":
            name = _NAME.match(html, at + 2)
            b.close(_lower(name[0]))
            at = behind(name.end())
        elif lead.isascii() and lead.isalpha():
            name = _NAME.match(html, at + 1)
            tag = _lower(name[0])
            attrs, closed, at = _attributes(html, name.end(), bare)
            if tag in IMPLIED_END:
                b.close(tag)
            n = b.add("element", tag, attrs)
            if closed or tag in VOID:
                continue
            b.open.append(n)
            if tag in RAW_TEXT:
                end = html.find(f"</{tag}", at)
                raw = html[at : end if end >= 0 else len(html)]
                b.text(decode(raw, bare) if tag in ("title", "textarea") else raw)
                b.open.pop()
                at = behind(end) if end >= 0 else len(html)
        else:
            b.text("<")
            at += 1
    return _finish(b.rows)


def _finish(rows: list[Draft]) -> list[Row]:
    last = list(range(1, len(rows) + 1))
    for n in range(len(rows) - 1, 0, -1):
        parent = rows[n].parent
        if last[n] > last[parent]:
            last[parent] = last[n]
    place: list[tuple] = [(0, None, 1)] * len(rows)
    for row in rows:
        if not row.children:
            continue
        elements = [rows[c].kind == "element" for c in row.children]
        total, k = sum(elements), 0
        for i, c in enumerate(row.children):
            k += elements[i]
            place[c] = i, k if elements[i] else None, total
    out, ref, skip = [], 0, 0
    for n, row in enumerate(rows):
        own = None
        if row.tag in SKIPPED:
            skip = max(skip, last[n])
        if row.tag in INTERACTIVE and n >= skip:
            ref += 1
            own = ref
        out.append(Row(n, row.parent, *place[n], row.depth, last[n], row.kind, row.tag, row.attrs, row.text, own))
    return out


_SPACE_RUN = re.compile(f"[{_SPACES}]+")


def collapse(text: str) -> str:
    """Runs of Unicode white space as one space, none at the ends."""
    return _SPACE_RUN.sub(" ", text.strip(_SPACES))
