"""Patterns of the script dialect rewritten for the JVM's engine.

The dialect: flags g i m s; ``.`` leaves out LF and CR alone; ``$`` without m stands at the very end; ``\\d \\w \\s \\b``
are ASCII; a backreference to a group that has not matched matches the empty text; ``[]`` matches nothing, ``[^]`` anything; a brace
that is no quantifier is itself.
"""

from __future__ import annotations

import re


class RegexError(ValueError):
    """A pattern outside the dialect."""


_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_INSIDE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_LINES = r"\n\r\x{2028}\x{2029}"
_PIECE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\(.)|(\[\^?\])|(\[)|(\{[0-9]+(?:,[0-9]*)?\})|(\(\?[:=!])|(\(\?)|([^\\])", re.S)


def to_java(pattern: str, flags: str = "") -> str:
    """The same pattern for ``rlike``, ``regexp_extract`` and the like; raises ``RegexError``.

    A group that is referred back to gets an empty group as its last part, which tells whether it has matched; groups
    opened behind it thus have higher numbers (``group_numbers``).
    """
    return _translate(pattern, flags)[0]


def group_numbers(pattern: str, flags: str = "") -> list[int]:
    """The number that each group of ``pattern`` has in the rewritten one."""
    return _translate(pattern, flags)[1]


def _translate(pattern: str, flags: str) -> tuple[str, list[int]]:
    if set(flags) - set("gims") or len(set(flags)) != len(flags):
        raise RegexError(f"bad flags {flags!r}")
    multi = "m" in flags
    groups = len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?)", pattern))
    out, at, depth = [], 0, 0
    referred = {int(k) for k in re.findall(r"(?<!\\)(?:\\\\)*\\([1-7])", pattern)}
    numbers: list[int] = []  # by group
    marks: dict[int, int] = {}  # of closed groups, the group that tells whether they have matched
    opened: list[int] = []  # groups still open, 0 for those that capture nothing
    made = 0
    while at < len(pattern):
        m = _PIECE.match(pattern, at)
        if not m:
            raise RegexError("trailing backslash")
        at = m.end()
        if m[1] or m[2]:
            out.append(rf"\x{{{m[1] or m[2]}}}")
        elif m[3] and m[3] in "1234567" and int(m[3]) <= groups:
            k = int(m[3])
            out.append(rf"(?:\{numbers[k - 1]}|(?!\{marks[k]}))" if k in marks else "(?:)")
        elif m[3]:
            out.append(_escape(m[3]))
        elif m[4]:
            out.append(r"[\s\S]" if m[4] == "[^]" else r"(?!)")
        elif m[5]:
            text, at = _class(pattern, at)
            out.append(text)
        elif m[6]:
            out.append(m[6])
        elif m[8]:
            raise RegexError("unsupported group")
        elif m[7] or m[9] == "(":
            depth += 1
            out.append(m[0])
            if m[7]:
                opened.append(0)
            else:
                made += 1
                numbers.append(made)
                opened.append(len(numbers))
        elif m[9] == ")":
            depth -= 1
            if depth < 0:
                raise RegexError("unmatched )")
            k = opened.pop()
            if k in referred:
                made += 1
                marks[k] = made
                out.append("()")
            out.append(")")
        elif m[9] == ".":
            out.append(r"[\s\S]" if "s" in flags else r"[^\n\r]")
        elif m[9] == "^":
            out.append(rf"(?<![^{_LINES}])" if multi else r"\A")
        elif m[9] == "$":
            out.append(rf"(?![^{_LINES}])" if multi else r"\z")
        else:
            out.append(rf"\{m[9]}" if m[9] in "{}]" else m[9])
    if depth:
        raise RegexError("unclosed group")
    return ("(?iu)" if "i" in flags else "") + "".join(out), numbers


def _escape(c: str) -> str:
    if c in "bB":
        return _BOUNDARY if c == "b" else _INSIDE
    if c in "dDwWsSnrtfv":
        return {"v": r"\x0B", "s": r"[ \t\n\x0B\f\r]", "S": r"[^ \t\n\x0B\f\r]"}.get(c, rf"\{c}")
    if c == "0":
        return r"\x00"
    if c.isdigit():
        return re.escape(chr(int(c, 8))) if c in "1234567" else c
    return re.escape(c) if not c.isalnum() else c


def _class(pattern: str, at: int) -> tuple[str, int]:
    """A bracket class from behind its bracket: (text, position behind it)."""
    start, out = at, ["["]
    if pattern.startswith("^", at):
        out.append("^")
        at += 1
    while at < len(pattern):
        c = pattern[at]
        if c == "]" and at > start:
            return "".join(out) + "]", at + 1
        if c == "\\":
            m = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S).match(pattern, at)
            if not m:
                break
            at = m.end()
            if m[1] or m[2]:
                out.append(rf"\x{{{m[1] or m[2]}}}")
            elif m[3] in "dDwWnrtf":
                out.append(rf"\{m[3]}")
                if m[3] in "dDwW" and pattern[at : at + 1] == "-":  # a class is no end of a range
                    out.append(r"\-")
                    at += 1
            elif m[3] in "sS":
                out.append(r" \t\n\x0B\f\r" if m[3] == "s" else r"[^ \t\n\x0B\f\r]")
            elif m[3] in "bv0":
                out.append({"b": r"\x08", "v": r"\x0B", "0": r"\x00"}[m[3]])
            else:
                out.append(rf"\{m[3]}" if not m[3].isalnum() else m[3])
            continue
        out.append(rf"\{c}" if c in "[&~" else c)
        at += 1
    raise RegexError("unclosed class")
