"""CSS selectors as syntax trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class CssError(ValueError):
    """A selector that can't be read."""


@dataclass
class Compound:
    """What one element must be; ``tag`` None matches any."""

    tag: str | None = None
    id: str | None = None
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str]] = field(default_factory=list)  # name, operator ("" for presence), value
    pseudos: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Selector:
    """``compounds[i] combinators[i] compounds[i + 1]``; combinators are " ", ">", "+" and "~"."""

    compounds: list[Compound]
    combinators: list[str]


_IDENT = re.compile(r"[A-Za-z0-9_-]+")
_SIMPLE = ("first-child", "last-child", "only-child", "empty")
_STEP = re.compile(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?\Z")


def parse(text: str) -> list[Selector]:
    """The groups of a selector list; raises ``CssError``."""
    groups = [_Reader(g.strip()).selector() for g in _split(text)]
    if not groups:
        raise CssError("empty selector")
    return groups


def _split(text: str) -> list[str]:
    """Cut at commas outside brackets, parentheses and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and depth:
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:k])
            start = k + 1
    return [*parts, text[start:]]


def nth(text: str) -> tuple[int, int]:
    """(a, b) of an+b."""
    t = text.strip().lower()
    if t in ("odd", "even"):
        return 2, int(t == "odd")
    if re.fullmatch(r"[+-]?\d+", t):
        return 0, int(t)
    if m := _STEP.match(t):
        a = {"": 1, "+": 1, "-": -1}.get(m[1]) or int(m[1])
        return a, int((m[2] or "") + (m[3] or "0"))
    raise CssError(f"bad nth expression {text!r}")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def ident(self) -> str:
        m = _IDENT.match(self.text, self.at)
        if not m:
            raise CssError(f"a name is missing in {self.text!r}")
        self.at = m.end()
        return m[0]

    def selector(self) -> Selector:
        if not self.text:
            raise CssError("empty selector")
        found = Selector([self.compound()], [])
        while self.at < len(self.text):
            m = re.compile(r"\s*([>+~])\s*|\s+").match(self.text, self.at)
            if not m:
                raise CssError(f"unexpected {self.peek()!r}")
            self.at = m.end()
            found.combinators.append(m[1] or " ")
            found.compounds.append(self.compound())
        return found

    def compound(self) -> Compound:
        c, start = Compound(), self.at
        if self.peek() == "*":
            self.at += 1
        elif _IDENT.match(self.text, self.at):
            c.tag = self.ident().lower()
        while (p := self.peek()) and p in "#.[:":
            self.at += 1
            if p == "#":
                c.id = self.ident()
            elif p == ".":
                c.classes.append(self.ident())
            elif p == "[":
                c.attrs.append(self.attribute())
            else:
                c.pseudos.append(self.pseudo())
        if self.at == start:
            raise CssError(f"a compound is missing in {self.text!r}")
        return c

    def attribute(self) -> tuple[str, str, str]:
        m = re.compile(r"\s*([A-Za-z0-9_-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([A-Za-z0-9_./-]*))\s*)?\]").match(self.text, self.at)
        if not m:
            raise CssError(f"bad or unclosed attribute in {self.text!r}")
        self.at = m.end()
        return m[1].lower(), m[2] or "", next((g for g in m.groups()[2:] if g is not None), "")

    def pseudo(self) -> tuple[str, object]:
        name = self.ident().lower()
        if name in _SIMPLE:
            return name, None
        if name in ("nth-child", "not") and self.peek() == "(":
            end = self.text.find(")", self.at)
            if end < 0:
                raise CssError("unclosed parenthesis")
            inner = self.text[self.at + 1 : end]
            self.at = end + 1
            if name == "nth-child":
                return name, nth(inner)
            reader = _Reader(inner.strip())
            held = reader.compound()
            if reader.at < len(reader.text):
                raise CssError(":not takes one compound")
            return name, held
        raise CssError(f"unsupported pseudo-class {name!r}")
