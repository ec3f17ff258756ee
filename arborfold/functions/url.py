"""URLs: parsing, joining and their text, as plain functions and as Arrow UDFs."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import quote_from_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_PATH_UNSAFE, _QUERY_UNSAFE = ' "<>\\^`{|}', ' "#<>'
_SAFE = {unsafe: (safe := "".join(chr(c) for c in range(0x20, 0x7F) if chr(c) not in unsafe), re.compile(f"[{re.escape(safe)}]*")) for unsafe in (_PATH_UNSAFE, _QUERY_UNSAFE)}
_LOW = "".join(map(chr, range(33)))


class UrlError(ValueError):
    """Its text is one of Empty, MissingScheme, BadScheme, MissingHost, BadPort."""


class Url(NamedTuple):
    scheme: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        tail = self.path + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")
        if self.scheme not in DEFAULT_PORTS:
            return f"{self.scheme}:{tail}"
        return f"{self.scheme}://{self.bare_host}{'' if self.port is None else f':{self.port}'}{tail}"

    @property
    def bare_host(self) -> str:
        return f"[{self.host}]" if ":" in self.host and not self.host.startswith("[") else self.host

    @property
    def host_header(self) -> str:
        return self.bare_host + ("" if self.port in (None, DEFAULT_PORTS.get(self.scheme)) else f":{self.port}")

    @property
    def port_or_default(self) -> int:
        return self.port if self.port is not None else DEFAULT_PORTS.get(self.scheme, 80)

    @property
    def origin(self) -> tuple[str, str, int]:
        return self.scheme, self.host, self.port_or_default


def _cut(text: str, mark: str) -> tuple[str, str | None]:
    head, found, tail = text.partition(mark)
    return head, tail if found else None


def _encode(text: str, unsafe: str) -> str:
    safe, plain = _SAFE[unsafe]
    return text if plain.fullmatch(text) else quote_from_bytes(text.encode(), safe)


def _port(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > 65535:
        raise UrlError("BadPort")
    return int(text)


def _authority(text: str) -> tuple[str, int | None]:
    text = text.rpartition("@")[2]
    if text.startswith("["):
        host, found, tail = text[1:].partition("]")
        if not found:
            raise UrlError("MissingHost")
        return host, _port(tail[1:]) if tail.startswith(":") else None
    host, found, port = text.rpartition(":")
    return (_lower(host), _port(port)) if found else (_lower(text), None)


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def _plain_path(path: str) -> str:
    """Dot segments resolved; two dots also take the empty segment before the first slash, which is then put back."""
    if "." not in path:
        return path
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    out = "/".join(kept)
    if path.startswith("/") and not out.startswith("/"):
        out = f"/{out}"
    if path.endswith(("/", "/.", "/..")) and not out.endswith("/"):
        out += "/"
    return out or "/"


def _hierarchical(scheme: str, host: str, port: int | None, path: str, query: str | None, fragment: str | None) -> Url:
    return Url(scheme, host, port, _encode(_plain_path(path), _PATH_UNSAFE), None if query is None else _encode(query, _QUERY_UNSAFE), fragment)


def parse(text: str) -> Url:
    text = text.strip(_LOW)
    if not text:
        raise UrlError("Empty")
    if ":" not in text:
        raise UrlError("MissingScheme")
    m = _SCHEME.match(text)
    if not m:
        raise UrlError("BadScheme")
    scheme, rest = _lower(m[1]), text[m.end() :]
    if scheme not in DEFAULT_PORTS:
        rest, fragment = _cut(rest, "#")
        return Url(scheme, "", None, *_cut(rest, "?"), fragment)
    rest = rest.removeprefix("//")
    authority = re.match(r"[^/?#]*", rest)[0]
    host, port = _authority(authority)
    if not host:
        raise UrlError("MissingHost")
    rest, fragment = _cut(rest[len(authority) :], "#")
    path, query = _cut(rest, "?")
    return _hierarchical(scheme, host, port, path or "/", query, fragment)


def join(base: Url, text: str) -> Url:
    text = text.strip(_LOW)
    if not text:
        return base._replace(fragment=None)
    if _SCHEME.match(text):
        return parse(text)
    if base.scheme not in DEFAULT_PORTS:
        raise UrlError("MissingHost")
    rest, fragment = _cut(text, "#")
    if rest.startswith("//"):
        authority = re.match(r"[^/?]*", rest[2:])[0]
        path, query = _cut(rest[2 + len(authority) :], "?")
        return _hierarchical(base.scheme, *_authority(authority), path or "/", query, fragment)
    path, query = _cut(rest, "?")
    if not path:
        return _hierarchical(base.scheme, base.host, base.port, base.path, base.query if query is None else query, fragment)
    if not path.startswith("/"):
        path = (base.path.rpartition("/")[0] + "/" if "/" in base.path else "/") + path
    return _hierarchical(base.scheme, base.host, base.port, path, query, fragment)


_TEXT = ("scheme", "host", "port", "path", "query", "fragment", "href", "error")
#: Types are built as objects: a worker that imports this module has no session to read a type's text.
PARTS = T.StructType([T.StructField(n, T.IntegerType() if n == "port" else T.StringType()) for n in _TEXT])
_PARTS = pa.struct([(n, pa.int32() if n == "port" else pa.string()) for n in _TEXT])


def _row(make) -> dict | None:
    try:
        u = make()
        return None if u is None else u._asdict() | {"href": str(u), "error": None}
    except UrlError as e:
        return {"error": str(e)}


def per_value(make, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What ``make`` gives for the rows of a batch, worked out once for each different row; null where any value is null."""
    codes = [c.dictionary_encode() for c in columns]
    at = {}
    rows = [at.setdefault(row, len(at)) for row in zip(*(c.indices.to_pylist() for c in codes), strict=True)]
    values = [c.dictionary.to_pylist() for c in codes]
    made = [None if None in row else make(*(v[k] for v, k in zip(values, row, strict=True))) for row in at]
    return pa.array(made, kind).take(pa.array(rows, pa.int64()))


@F.arrow_udf(PARTS)
def url_parts(text: pa.Array) -> pa.Array:
    """The parts of a URL and its text, or the error; null for null."""
    return per_value(lambda t: _row(lambda: parse(t)), _PARTS, text)


@F.arrow_udf(PARTS)
def url_join(base: pa.Array, text: pa.Array) -> pa.Array:
    """``text`` resolved against ``base``; null where either is null."""
    return per_value(lambda b, t: _row(lambda: join(parse(b), t)), _PARTS, base, text)


def same_origin(a: Column, b: Column) -> Column:
    """Whether two ``url_parts`` share scheme, host and effective port."""

    def port(u: Column) -> Column:
        known = F.create_map(*(F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv))
        return F.coalesce(u["port"], F.try_element_at(known, u["scheme"]), F.lit(80))

    return (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & (port(a) == port(b))


def urlencode(fields: Column) -> Column:
    """Form encoding of an array of (name, value) structs."""
    pair = lambda f: F.concat(F.url_encode(f["name"]), F.lit("="), F.url_encode(f["value"]))
    return F.array_join(F.transform(fields, pair), "&")
