"""Token ids by the tokenizers library, each distinct piece of text encoded once per Python worker."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Kinds of characters as the byte-level pre-tokenizer tells them apart; those up to QUOTE are no white space, 0 is none.
LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(1, 7)


def _begins(before: int, last: int, this: int) -> bool:
    """Whether the pre-tokenizer always cuts between ``last`` and ``this``, and cuts the two sides alike when they stand alone.

    Runs of a kind end before any other kind, except that a quote may begin a contraction with letters. A single
    white character, not the space, stands alone; longer runs of white space are left to the library.
    """
    if last in (LETTER, NUMBER, OTHER, QUOTE):
        return (last, this) != (QUOTE, LETTER) and min(last, OTHER) != (OTHER if this == QUOTE else this)
    return last == WHITE and before < SPACE and this < SPACE


_BEGINS = np.array([_begins(*k) for k in product(range(8), repeat=3)])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Kept(dict):
    """Ids by string, as little-endian unsigned 32-bit bytes. What was not asked for since the last half fill goes."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Texts are cut where the byte-level pre-tokenizer always cuts, by the kinds of their characters, which are asked
    of it, each once. Arrow tells the pieces apart, the library encodes each distinct one, and numpy lays the ids
    out. Texts that hold one of the vocabulary's added strings are encoded whole by the library, which takes such
    strings out first, and so are all texts if the vocabulary is no plain byte-level one. ``limit`` bounds the pieces kept.
    """

    def __init__(self, path: str, limit: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        cuts = json.loads(self.pre.__getstate__()) if self.pre and not self.tokenizer.normalizer else {}
        self.plain = cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]
        self.chars = _byte_chars()
        self.kinds = bytearray(0x110000)
        self.kind_of = np.frombuffer(self.kinds, np.uint8)
        self.pieces = _Kept(self._piece, limit)

    def _ids(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _kind(self, char: str) -> int:
        if char in "' ":
            return QUOTE if char == "'" else SPACE
        return next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")) if len(self.pre.pre_tokenize_str(x + char + x)) == 1), WHITE)

    def _piece(self, piece: str) -> bytes:
        kind = self.kinds[ord(piece[0])]
        if len(piece) > 1 and kind == SPACE:
            kind = self.kinds[ord(piece[1])]
        if len(piece) == 1 or kind < SPACE and "'" not in piece:  # a run of one kind
            return self._ids(piece.encode().decode("latin-1").translate(self.chars))
        return b"".join(self._ids(p) for p, _ in self.pre.pre_tokenize_str(piece))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for null or empty text."""
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array, size: int = 1 << 22) -> Iterator[np.ndarray]:
        """Ids of each text, in order; neighbours of some ``size`` bytes are encoded together."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.plain:
            yield from (np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, "<u4") for t in texts)
            return
        whole = pc.match_substring_regex(texts, self.added) if self.added else pa.repeat(False, len(texts))
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        k = 0
        while k < len(texts):
            stop = max(k + 1, int(np.searchsorted(ends, size + (ends[k - 1] if k else 0), side="right")))
            part, odd = texts[k:stop], whole[k:stop]
            together = self._together(pc.if_else(odd, "", part) if odd.true_count else part)
            for j, ids in enumerate(together, k):
                yield np.array(self.tokenizer.encode(texts[j].as_py(), add_special_tokens=False).ids, "<u4") if odd.true_count and whole[j].as_py() else ids
            k = stop

    def _together(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        _, at, data = texts.buffers()
        at = np.frombuffer(at, "<i8")[texts.offset : texts.offset + len(texts) + 1]
        if at[0] == at[-1]:
            return [np.empty(0, "<u4")] * len(texts)
        raw, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
        leads = (raw & 0xC0) != 0x80
        chars = raw if leads.all() else np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        kinds = np.zeros(len(chars) + 2, np.uint16)
        kinds[2:] = self.kind_of[chars]
        if not kinds[2:].all():
            for c in np.unique(chars[kinds[2:] == 0]).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds[2:] = self.kind_of[chars]
        begins = np.zeros(len(raw) + 1, bool)
        begins[:-1][leads] = _BEGINS[kinds[:-2] << 6 | kinds[1:-1] << 3 | kinds[2:]]
        begins[at] = True
        edges = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        ids = list(map(self.pieces.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        n = sizes[which]
        stops = np.cumsum(n)
        first = (np.cumsum(sizes) - sizes)[which] - (stops - n)
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first, n) + np.arange(stops[-1])]
        return np.split(out, np.append(0, stops)[np.searchsorted(edges, at[1:-1])])


@lru_cache(maxsize=2)
def encoder(path: str, limit: int = 600_000) -> Encoder:
    return Encoder(path, limit)
