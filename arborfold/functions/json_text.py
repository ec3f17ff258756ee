"""JSON with key order kept: a lenient-number parser, dotted paths and the engine's own text form."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .url import per_value

MAX_DEPTH = 200
_NUMBER = re.compile(r"-?[0-9][0-9.eE+-]*")
_SPACE = re.compile(r"[ \t\n\r]*")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class JsonError(ValueError):
    """Text that is no JSON."""


class Pairs(list):
    """An object: (key, value) pairs in order, repeated keys kept."""


def parse(text: str):
    """None, bool, float, str, list or ``Pairs``."""
    value, at = _value(text, _SPACE.match(text).end(), 0)
    if _SPACE.match(text, at).end() != len(text):
        raise JsonError("trailing data")
    return value


def _value(s: str, at: int, depth: int):
    if depth > MAX_DEPTH:
        raise JsonError("too deep")
    c = s[at : at + 1]
    if c == "{" or c == "[":
        return _container(s, at, depth, c == "{")
    if c == '"':
        return _string(s, at + 1)
    for word, value in (("true", True), ("false", False), ("null", None)):
        if s.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(s, at)
    if m:
        try:
            return float(m[0]), m.end()
        except ValueError:
            pass
    raise JsonError(f"unexpected text at {at}")


def _container(s: str, at: int, depth: int, keyed: bool):
    out, close = (Pairs(), "}") if keyed else ([], "]")
    at = _SPACE.match(s, at + 1).end()
    if s.startswith(close, at):
        return out, at + 1
    while True:
        if keyed:
            if not s.startswith('"', at):
                raise JsonError(f"a key is missing at {at}")
            key, at = _string(s, at + 1)
            at = _SPACE.match(s, at).end()
            if not s.startswith(":", at):
                raise JsonError(f"a colon is missing at {at}")
            at = _SPACE.match(s, at + 1).end()
        value, at = _value(s, at, depth + 1)
        out.append((key, value) if keyed else value)
        at = _SPACE.match(s, at).end()
        if s.startswith(close, at):
            return out, at + 1
        if not s.startswith(",", at):
            raise JsonError(f"a comma is missing at {at}")
        at = _SPACE.match(s, at + 1).end()


def _string(s: str, at: int) -> tuple[str, int]:
    out = []
    while True:
        end = re.compile(r'["\\]').search(s, at)
        if not end:
            raise JsonError("unterminated string")
        out.append(s[at : end.start()])
        at = end.end()
        if end[0] == '"':
            return "".join(out), at
        c = s[at : at + 1]
        if c == "u":
            m = re.compile(r"([0-9a-fA-F]{4})(?:\\u([dD][c-fC-F][0-9a-fA-F]{2}))?").match(s, at + 1)
            if not m:
                raise JsonError("bad escape")
            n = int(m[1], 16)
            if 0xD800 <= n < 0xDC00 and m[2]:
                out.append(chr(0x10000 + ((n - 0xD800) << 10) + int(m[2], 16) - 0xDC00))
                at = m.end()
            else:
                out.append("�" if 0xD800 <= n < 0xE000 else chr(n))
                at += 5
        elif c in _ESCAPES and c:
            out.append(_ESCAPES[c])
            at += 1
        else:
            raise JsonError("bad escape")


MISSING = object()


def get(value, path: str):
    """The value at a dotted path, ``MISSING`` where there is none; a number is an index in arrays, a key in objects."""
    for part in path.split("."):
        if isinstance(value, Pairs):
            value = next((v for k, v in value if k == part), MISSING)
        elif isinstance(value, list) and re.fullmatch(r"\+?[0-9]+", part) and int(part) < len(value):
            value = value[int(part)]
        else:
            return MISSING
        if value is MISSING:
            return MISSING
    return value


def dump(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, float):
        return _float(value)
    if isinstance(value, str):
        return '"' + "".join(_char(c) for c in value) + '"'
    if isinstance(value, Pairs):
        return "{" + ",".join(f"{dump(k)}:{dump(v)}" for k, v in value) + "}"
    return "[" + ",".join(map(dump, value)) + "]"


def _char(c: str) -> str:
    known = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return known.get(c) or (f"\\u{ord(c):04x}" if c < " " else c)


def _float(x: float) -> str:
    if x == int(x) if abs(x) < 9e15 else False:
        return str(int(x))
    text = repr(x)
    if "e" in text:  # decimal digits throughout
        text = format(x, "f") if abs(x) >= 1 else f"{x:.{abs(int(text.split('e')[1])) + len(text.split('e')[0].replace('.', '').replace('-', '')) - 1}f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
    return text


@F.arrow_udf(T.StringType())
def json_get(text: pa.Array, path: pa.Array) -> pa.Array:
    """The value at a dotted path in its own text form; null for bad JSON and missing paths."""

    def one(t: str, p: str) -> str | None:
        try:
            found = get(parse(t), p)
        except JsonError:
            return None
        return None if found is MISSING else dump(found)

    return per_value(one, pa.string(), text, path)


@F.arrow_udf(T.StringType())
def json_normal(text: pa.Array) -> pa.Array:
    """JSON parsed and written again; null for bad JSON."""

    def one(t: str) -> str | None:
        try:
            return dump(parse(t))
        except JsonError:
            return None

    return per_value(one, pa.string(), text)
