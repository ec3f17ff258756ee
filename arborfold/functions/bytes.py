"""Bytes of responses: charsets, compression, chunked bodies, checksums."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels by encoding.
LABELS = {
    "utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8"),
    "windows-1252": ("windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "latin1", "latin-1", "l1", "ascii", "us-ascii"),
    "utf-16le": ("utf-16", "utf-16le"),
    "utf-16be": ("utf-16be",),
}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels}
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
_META = re.compile(rb"charset[ =\"']*([a-z0-9_.:-]+)")


def charset_of(content_type: str | None) -> str | None:
    """The charset parameter of a content type."""
    m = re.search(r"charset[ =\"']*([^; \"']*)", content_type or "", re.I)
    return m[1] if m and m[1] else None


def detect(data: bytes, declared: str | None = None) -> str:
    """By byte-order mark, then the declared label, then a label in the first 1,024 bytes, else UTF-8."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name
    if declared and (name := _BY_LABEL.get(declared.strip().lower())):
        return name
    m = _META.search(data[:1024])
    return _BY_LABEL.get(m[1].decode(), "utf-8") if m else "utf-8"


def decode(data: bytes, encoding: str) -> str:
    """Text of ``data``; a byte-order mark stays, what can't be read becomes U+FFFD, an odd last byte of UTF-16 goes."""
    if encoding == "windows-1252":
        return "".join(_WINDOWS[b] for b in data)
    if encoding.startswith("utf-16"):
        return data[: len(data) // 2 * 2].decode(encoding, errors="replace")
    return data.decode("utf-8", errors="replace")


def _windows(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


_WINDOWS = [_windows(b) for b in range(256)]


def _limited(data: bytes, wbits: int, limit: int) -> tuple[bytes, bytes]:
    """(inflated bytes, what follows the stream); ``ValueError`` for bad data or more than ``limit`` bytes."""
    engine = zlib.decompressobj(wbits)
    try:
        out = engine.decompress(data, limit + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(out) > limit:
        raise ValueError("output too large")
    if not engine.eof:
        raise ValueError("unexpected end")
    return out, engine.unused_data


def inflate(data: bytes, limit: int = 16 << 20) -> bytes:
    """Raw deflate."""
    return _limited(data, -15, limit)[0]


def zlib_decode(data: bytes, limit: int = 16 << 20) -> bytes:
    """zlib with its checksum; raw deflate where the header is none; preset dictionaries are refused."""
    if len(data) >= 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        if data[1] & 32:
            raise ValueError("preset dictionary")
        return _limited(data, 15, limit)[0]
    return inflate(data, limit)


def gzip_decode(data: bytes, limit: int = 16 << 20) -> bytes:
    """The first gzip member, its checksum and size verified; reserved flags are refused."""
    if len(data) < 18 or data[:3] != b"\x1f\x8b\x08":
        raise ValueError("no gzip data")
    if data[3] & 0xE0:
        raise ValueError("reserved flags")
    return _limited(data, 31, limit)[0]


def dechunk(data: bytes) -> bytes:
    """The body of a chunked transfer; extensions and trailers are ignored."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("unexpected end")
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise ValueError("bad chunk size") from None
        if size == 0:
            return b"".join(out)
        at = end + 2
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("bad chunk end")
        out.append(data[at : at + size])
        at += size + 2


def frame(status: int, headers: list[tuple[str, str]], raw: bytes) -> bytes:
    """The body behind a response's head: none for 1xx, 204 and 304; chunks; the stated length, as far as it is there; else all."""
    if status < 200 or status in (204, 304):
        return b""
    named = {k.lower(): v.strip() for k, v in reversed(headers)}
    if "chunked" in named.get("transfer-encoding", "").lower():
        return dechunk(raw)
    size = named.get("content-length", "")
    return raw[: int(size)] if re.fullmatch("[0-9]+", size) else raw


def decode_content(data: bytes, encoding: str | None, limit: int = 16 << 20) -> bytes:
    kind = (encoding or "").strip().lower()
    return gzip_decode(data, limit) if kind in ("gzip", "x-gzip") else zlib_decode(data, limit) if kind == "deflate" else data


def _binary(one):
    def run(data: pa.Array) -> pa.Array:
        def safe(d: bytes | None) -> bytes | None:
            try:
                return None if d is None else one(d)
            except ValueError:
                return None

        return pa.array([safe(d) for d in data.to_pylist()], pa.binary())

    return run


#: Binary columns; null for null and for data that can't be decoded.
gunzip = F.arrow_udf(T.BinaryType())(_binary(gzip_decode))
unzlib = F.arrow_udf(T.BinaryType())(_binary(zlib_decode))
undeflate = F.arrow_udf(T.BinaryType())(_binary(inflate))
unchunk = F.arrow_udf(T.BinaryType())(_binary(dechunk))


@F.arrow_udf(T.StringType())
def decode_auto(data: pa.Array, content_type: pa.Array) -> pa.Array:
    """Text of a body under its content type; null for null."""
    pairs = zip(data.to_pylist(), content_type.to_pylist(), strict=True)
    return pa.array([None if d is None else decode(d, detect(d, charset_of(c))) for d, c in pairs], pa.string())


@F.arrow_udf(T.BinaryType())
def response_body(status: pa.Array, headers: pa.Array, raw: pa.Array) -> pa.Array:
    """The body that ``headers`` (an array of name, value) frame and encode in the raw bytes; null for what can't be read."""

    def one(code: int | None, pairs: list[dict] | None, data: bytes | None) -> bytes | None:
        if data is None:
            return None
        known = [(h["name"], h["value"]) for h in pairs or ()]
        try:
            return decode_content(frame(code or 200, known, data), next((v for k, v in known if k.lower() == "content-encoding"), None))
        except ValueError:
            return None

    return pa.array([one(*x) for x in zip(status.to_pylist(), headers.to_pylist(), raw.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(T.LongType())
def adler32(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else zlib.adler32(d) for d in data.to_pylist()], pa.int64())


def est_tokens(text: Column) -> Column:
    """UTF-8 bytes over four."""
    return F.floor(F.octet_length(text) / 4).cast("long")
