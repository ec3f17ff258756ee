"""Tokens of page scripts.

A token keeps the text it was read from and its place, so the texts, with the white space and comments between them,
make up the script again. A slash starts a pattern where no value can end before it; a closing brace goes on with a
template where one was left open.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class ScriptSyntaxError(ValueError):
    """A script that can't be read; its text tells where."""


class Token(NamedTuple):
    """kind (number, string, name, keyword, mark, pattern, template, end), text as it stands, value (cooked text, or the number;
    null for a template piece with a bad escape), at (its place), line_before (whether a line ends before it)."""

    kind: str
    text: str
    value: str | float | None
    at: int
    line_before: bool


#: The words that are no names, and the marks, of the dialect.
KEYWORDS = frozenset(
    "var let const function return if else while for break continue true false null undefined typeof new in instanceof async await throw try catch finally "
    "switch case default do void delete class extends super".split()
)
MARKS = r">>>=|\*\*=|===|!==|>>>|\*\*|<<=|>>=|=>|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&&|\|\||<<|>>|&=|\|=|\^=|\?\?|\?\.(?![0-9])|\.\.\.|[-=<>+*/%!~&|^()\[\]{},;.?:]"
#: Keywords behind which a value begins.
OPENING = frozenset("return typeof new in instanceof throw delete void do else case".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\u2028": "", "\u2029": ""}

_GAP = re.compile(r"(?:[ \t\r\n]+|//[^\n]*|/\*.*?\*/)+", re.S)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_NAME = re.compile(r"(?:[A-Za-z_$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[A-Za-z0-9_$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_STRING = re.compile(r""""[^"\\\n\r]*(?:\\.[^"\\\n\r]*)*"|'[^'\\\n\r]*(?:\\.[^'\\\n\r]*)*'""", re.S)
_PATTERN = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_PIECE = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*(`|\$\{)", re.S)
_MARK = re.compile(MARKS)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)


def cook(raw: str) -> str:
    """The text that escapes stand for; raises ``ValueError`` for those that stand for none."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16))
        if m[4] in "ux":
            raise ValueError(m[0])
        return "" if m[4] in ("\r\n", "\r") else ESCAPES.get(m[4], m[4])

    if "\\" not in raw and raw.isascii():
        return raw
    text = _ESCAPE.sub(one, raw)
    # two halves of a character beyond 16 bits are one
    return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)


def number(text: str) -> float:
    return float(int(text, 0)) if text[:2].lower() in ("0x", "0b", "0o") else float(text)


def _pattern_can_start(last: Token | None) -> bool:
    if last is None:
        return True
    if last.kind == "mark":
        return last.text not in (")", "]", "++", "--")
    return last.kind == "keyword" and last.text in OPENING or last.kind == "template" and last.text.endswith("${")


def tokens(script: str) -> list[Token]:
    """The tokens of a script, the end last; raises ``ScriptSyntaxError``."""
    found: list[Token] = []
    braces: list[bool] = []  # of open braces, whether they belong to a template
    at, line = 0, False

    def put(kind: str, end: int, value: str | float | None = None) -> None:
        nonlocal at, line
        text = script[at:end]
        found.append(Token(kind, text, text if value is None and kind != "template" else value, at, line))
        at, line = end, False

    def piece() -> None:
        """A part of a template, from a backtick or a closing brace up to the next expression or the end."""
        m = _PIECE.match(script, at + 1)
        if m is None:
            raise ScriptSyntaxError(f"unterminated template at {at}")
        if m[1] == "${":
            braces.append(True)
        try:
            value = cook(m[0][: -len(m[1])].replace("\r\n", "\n").replace("\r", "\n"))
        except ValueError:
            value = None
        put("template", m.end(), value)

    while True:
        if gap := _GAP.match(script, at):
            line, at = line or "\n" in gap[0], gap.end()
        if at >= len(script):
            put("end", at)
            return found
        c = script[at]
        if script.startswith("/*", at):
            raise ScriptSyntaxError(f"unterminated comment at {at}")
        if c in "0123456789." and (m := _NUMBER.match(script, at)):
            if re.match(r"0[xXbBoO]", m[0] + script[m.end() : m.end() + 1]) and len(m[0]) < 3:
                raise ScriptSyntaxError(f"bad number at {at}")
            put("number", m.end(), number(m[0]))
        elif c in "\"'":
            m = _STRING.match(script, at)
            if m is None:
                raise ScriptSyntaxError(f"unterminated string at {at}")
            try:
                put("string", m.end(), cook(m[0][1:-1]))
            except ValueError as e:
                raise ScriptSyntaxError(f"bad escape at {at}: {e}") from None
        elif (c.isalpha() or c in "_$\\") and (m := _NAME.match(script, at)):
            name = cook(m[0])
            put("keyword" if m[0] in KEYWORDS else "name", m.end(), name)
        elif c == "/" and _pattern_can_start(found[-1] if found else None):
            m = _PATTERN.match(script, at)
            if m is None:
                raise ScriptSyntaxError(f"unterminated pattern at {at}")
            put("pattern", m.end())
        elif c == "`":
            piece()
        elif c == "}" and braces and braces[-1]:
            braces.pop()
            piece()
        elif m := _MARK.match(script, at):
            if c == "{":
                braces.append(False)
            elif c == "}" and not (braces and braces.pop() is False):
                raise ScriptSyntaxError(f"unbalanced }} at {at}")
            put("mark", m.end())
        else:
            raise ScriptSyntaxError(f"unexpected character {c!r} at {at}")
