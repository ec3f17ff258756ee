"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

log P(token) = log P(class | context) + log P(token | class, context). The most frequent training tokens ("head")
stand in classes of equal size by frequency; rarer ones in classes by training count; unseen tokens are one event in
a class of its own. The class softmax has hashed features of the token before, of the one before that (a skip) and
of both (an n-gram); the softmax inside a head class has a hashed feature of class and token before. Hashed rows grow
with the root of the training tokens up to a bound, classes with the largest counts. Inside every class the pairs (token
before, token) are counted exactly over all training documents, in buckets as many as the input asks for, those of frequent tokens before by the
pair, so none of these makes a large bucket: with n the pair's
count, N and T the count and number of the pairs of its token before and class, P(token | class, context) =
max(n - D, 0) / N + D * T / N * q, the closed form of maximum entropy with discounted pair features, where q is the head
softmax or, for rarer tokens, in proportion to training counts; each class has its discount D from its pairs that
occur once and twice. All probabilities over the training vocabulary and the unseen event add up to 1.

Counts cover every training document: tokens are hashed to 64 bits, chunks of documents list their distinct tokens,
buckets of tokens add the chunks' counts up and send them back, so no task or driver ever holds the vocabulary.
Weights are trained by distributed gradient updates: in each round a different share of the chunks sums its
gradient under the weights sent out, and the driver, which holds the fixed-size table, makes a preconditioned step.
A rare training token stands for the class of a count one less, as if its own occurrence were left out; so the
unseen event is learnt from tokens that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mix, word_hashes

ORACLE_SQL = None

END = np.uint64(0xE4D)  # the end token; words are mixed hashes, so it meets none of them
HEAD, CLASS = 1024, 32  # head tokens, and head tokens a class
BANDS = np.array([0, 1, 2, 3, 4, 8, 16, 32] + [128 << 2 * k for k in range(20)])  # lower training counts of the other classes
CLASSES = HEAD // CLASS + len(BANDS)  # of them those up to the largest count are used
BITS, MOST_BITS = 12, 16  # bits of class features, each of the token before, the skip, the pair; head features have one more
PAIR_TURNS = 2  # rounds in which pairs are counted
SLICE = 4096  # tokens a softmax takes at once: its table stays in the processor's cache


@dataclass
class Model:
    """Head tokens by rank, totals of the other classes, weights."""

    head: np.ndarray
    n: int
    v: int
    sums: np.ndarray  # what P(token | class) divides by
    class_bias: np.ndarray
    head_bias: np.ndarray
    bits: int = BITS
    weights: np.ndarray = field(init=False)
    head_weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.weights = np.zeros((3 << self.bits, len(self.class_bias)), np.float32)
        self.head_weights = np.zeros((2 << self.bits, CLASS), np.float32)

    def rank(self, words: np.ndarray) -> np.ndarray:
        """The head rank of each token hash, -1 elsewhere."""
        order = np.argsort(self.head)
        at = np.minimum(np.searchsorted(self.head, words, sorter=order), max(0, len(self.head) - 1))
        if not len(self.head):
            return np.full(len(words), -1)
        found = order[at]
        return np.where(self.head[found] == words, found, -1)


def band(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, counts, side="right") - 1


def contexts(feat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token before, one before that) as 32-bit features; 0 and 1 before a document's start."""
    before, skip = np.empty_like(feat), np.empty_like(feat)
    before[1:], skip[2:] = feat[:-1], feat[:-2]
    before[starts] = 0
    skip[starts] = 1
    inner = starts + 1
    skip[inner[inner < len(feat)]] = 0
    return before, skip


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of a class feature for ``n`` training tokens: rows grow with the root of ``n``, up to ``most`` bits, where the
    weights take some 60 MB; from there on the counted pairs alone grow with the input."""
    return min(most, max(BITS, (int(n).bit_length() - 1) // 2))


def rows_of(before: np.ndarray, skip: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    a, b = before.astype(np.uint32), skip.astype(np.uint32)
    pair = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
    mask, kind = np.uint32((1 << bits) - 1), np.uint16 if bits <= 14 else np.uint32
    return [(a & mask).astype(kind), ((1 << bits) + (b & mask)).astype(kind), ((2 << bits) + pair).astype(kind)]


def head_row(before: np.ndarray, cls: np.ndarray, bits: int = BITS) -> np.ndarray:
    mixed = before.astype(np.uint32) * np.uint32(0xC2B2AE3D) + cls.astype(np.uint32) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(31 - bits)).astype(np.uint16 if bits <= 15 else np.uint32)


def softmax(x: np.ndarray) -> np.ndarray:
    """In place; biases are logs of shares and steps are bounded, so no term overflows."""
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def predict(m: Model, rows: list[np.ndarray]) -> np.ndarray:
    x = m.weights.take(rows[0], axis=0)
    x += m.weights.take(rows[1], axis=0)
    x += m.weights.take(rows[2], axis=0)
    x += m.class_bias
    return softmax(x)


def predict_head(m: Model, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
    x = m.head_bias.take(cls, axis=0)
    x += m.head_weights.take(row, axis=0)
    return softmax(x)


def _error(width: int, right: np.ndarray, guess) -> np.ndarray:
    """1 for the right choice less the probabilities that ``guess`` gives a slice of tokens; a row a choice."""
    error = np.empty((width, len(right)), np.float32)
    for at in range(0, len(right), SLICE):
        j = slice(at, at + SLICE)
        np.negative(guess(j).T, out=error[:, j])
    error[right, np.arange(len(right))] += 1
    return error


def _add(grad: np.ndarray, seen: np.ndarray, row: np.ndarray, error: np.ndarray) -> None:
    """Add ``error``, a row a class, to the rows of ``grad``, and their counts to ``seen``; the rows lie close together."""
    lo = int(row.min())
    row, n = row.astype(np.intp) - lo, int(row.max()) - lo + 1
    for k, e in enumerate(error):
        grad[lo : lo + n, k] += np.bincount(row, e, n)
    seen[lo : lo + n] += np.bincount(row, minlength=n)


# Chunks ------------------------------------------------------------------------------------------------------------

CHUNKS = "kind int, chunk long, bucket int, ids array<long>, train binary, sizes binary, words binary, counts binary, tokens binary"


def _row(**cols) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "chunk": pa.int64(), "bucket": pa.int32(), "ids": pa.list_(pa.int64())}
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([cols.get(c)], kinds.get(c, pa.binary())) for c in names], names=names)


def chunked(docs: DataFrame, bits: int, tokens_a_chunk: int) -> DataFrame:
    """Rows of kind 0, the documents of a chunk with tokens as positions in its sorted distinct words; of kind 1, a
    bucket's share of those words (by their top ``bits`` bits) with their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held, ids, train, size = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, ids, train, size
            chunk = (part << 24) + made
            sizes = np.array([len(h) for h in held], np.int32)
            words, tokens = np.unique(np.concatenate(held), return_inverse=True)
            flags = np.array(train, bool)
            counts = np.bincount(tokens[np.repeat(flags, sizes)], minlength=len(words)).astype("<i4")
            yield _row(kind=0, chunk=chunk, ids=ids, train=flags.tobytes(), sizes=sizes.tobytes(), words=words.tobytes(), tokens=_pack(tokens.astype("<u4")))
            cuts = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for k in range(1 << bits):
                if cuts[k] < cuts[k + 1]:
                    yield _row(kind=1, chunk=chunk, bucket=k, words=words[cuts[k] : cuts[k + 1]].tobytes(), counts=_pack(counts[cuts[k] : cuts[k + 1]]))
            made += 1
            held, ids, train, size = [], [], [], 0

        for b in batches:
            for doc_id, text, learn in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                _, h = word_hashes((text.as_py() or "").encode().lower())
                held.append(np.append(h, END))
                ids.append(doc_id)
                train.append(learn)
                size += len(h) + 1
                if size >= tokens_a_chunk:
                    yield from close()
        if held:
            yield from close()

    return docs.mapInArrow(run, CHUNKS)


TOTALS = "chunk long, bucket int, counts binary, stats array<double>, top binary, top_counts binary"


def _total(table: pa.Table) -> pa.Table:
    """Add up a bucket's counts; a row a chunk with its words' totals, and one of statistics and the most frequent words."""
    rows = table.select(["chunk", "words", "counts"]).to_pylist()
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    counts = np.concatenate([_unpack(r["counts"], "<i4") for r in rows])
    known, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, counts)
    back, at, out = total[inverse], 0, []
    bucket = table.column("bucket")[0].as_py()
    for r, w in zip(rows, words, strict=True):
        out.append((r["chunk"], bucket, _pack(back[at : at + len(w)].astype("<i8")), None, None, None))
        at += len(w)
    seen = total[total > 0]
    stats = [float(len(seen)), float(seen.sum())]
    for k in range(len(BANDS)):
        own = seen[band(seen) == k]
        stats += [float(len(own)), float(own.sum())]
    top = np.lexsort((known, -total))[:HEAD]
    top = top[total[top] > 0]
    out.append((-1, bucket, None, stats, known[top].tobytes(), total[top].astype("<i8").tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in TOTALS.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _start(stats: list, tops: list[tuple[int, int]]) -> Model:
    """The model before any step: head, class totals and biases from the counts."""
    s = np.array(stats[2:]).reshape(-1, 2)
    n, v = int(stats[1]), int(stats[0])
    head = np.array([w for w, _ in tops], np.uint64)
    freq = np.array([c for _, c in tops], np.float64)
    types, sums = s[:, 0].copy(), s[:, 1].copy()
    for c in freq.astype(np.int64):  # head tokens leave the classes by count
        k = int(band(np.array([c]))[0])
        types[k] -= 1
        sums[k] -= c
    padded = np.zeros(HEAD)
    padded[: len(freq)] = freq
    mass = np.zeros(CLASSES)
    mass[: HEAD // CLASS] = padded.reshape(-1, CLASS).sum(axis=1)
    mass[HEAD // CLASS : -1] = sums[1:]  # tokens of each count stand for the count one less
    with np.errstate(divide="ignore"):
        class_bias = np.log(np.maximum(mass, 0) + 0.5) - np.log(n + 0.5 * CLASSES)
        class_bias[: HEAD // CLASS][padded.reshape(-1, CLASS).sum(axis=1) == 0] = -np.inf  # no such token
        class_bias[HEAD // CLASS + 1 :][types[1:] <= 0] = -np.inf
        head_bias = np.log(padded).reshape(-1, CLASS)
    head_bias[~np.isfinite(head_bias).any(axis=1)] = 0.0
    sums[0] = 1.0
    used = HEAD // CLASS + 1 + int(np.flatnonzero(types[1:] > 0).max(initial=-1) + 1)
    return Model(head, n, v, sums, class_bias[:used].astype(np.float32), head_bias.astype(np.float32), bits_for(n))


READY = "chunk long, turn int, ids array<long>, train binary, sizes binary, known binary, base binary, code binary, within binary, words binary, tokens binary"
MESSAGES = "chunk long, bucket int, befores binary, runs binary, classes binary, pairs binary, counts binary"
START = np.uint64(0x57A7)  # stands before a document's first token


def _pack(x: np.ndarray) -> bytes:
    """Compressed, as shuffles hardly shrink numbers."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def _prepare(model, slices: int):
    """Chunks with their words' totals -> what training and scoring need: codes (as scored and as seen in training) and the
    share of its class a word; the tokens' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for k in range(b.num_rows):
                ids, train, sizes, words, tokens, totals, chunk = (b.column(c)[k] for c in range(7))
                words, sizes = np.frombuffer(words.as_py(), np.uint64), np.frombuffer(sizes.as_py(), np.int32)
                total = np.concatenate([_unpack(t["counts"], "<i8") for t in totals.as_py()])
                packed, chunk = tokens.as_py(), chunk.as_py()
                tokens = _unpack(packed, "<u4")
                rank = m.rank(words)
                code = np.where(rank >= 0, rank, HEAD + band(total))
                base = np.log10((total + 1) / (m.n + m.v + 1))
                # the share of its class, of tokens outside the head; the unseen event is alone in its class
                share = np.where(rank >= 0, 0.0, np.maximum(total, 1) / np.maximum(m.sums[band(total)], 1)).astype("<f4")
                # as seen in training: a count less, for tokens outside the head
                less = np.where(rank >= 0, rank, HEAD + band(np.maximum(total - 1, 0)))
                starts = np.cumsum(sizes) - sizes
                cols = {
                    "chunk": chunk, "turn": turn_of(chunk, slices), "ids": ids.as_py(), "train": train.as_py(), "sizes": sizes.tobytes(),
                    "known": _pack(np.add.reduceat((total > 0)[tokens].astype(np.int64), starts)), "base": np.add.reduceat(base[tokens], starts).tobytes(),
                    "code": _pack(np.append(code, less).astype("<u2")), "within": _pack(share), "words": words.tobytes(), "tokens": packed,
                }
                kinds = {"chunk": pa.int64(), "turn": pa.int32(), "ids": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array([x], kinds.get(c, pa.binary())) for c, x in cols.items()], names=list(cols))

    return run


def turn_of(chunk: int, turns: int) -> int:
    """The round in which a chunk is learnt from, and scored."""
    return int(mix(np.array([chunk], np.int64).view(np.uint64))[0] % np.uint64(turns))


@dataclass
class Pairs:
    """The distinct pairs of a chunk: hash and head rank of the token before (START has rank ``HEAD``, others -1), the word,
    a hash of both, and by token the number of its pair. Pairs behind frequent tokens (``head``) are in the order of their hash and go to buckets by
    it, so no frequent token makes a large bucket; ``rest`` are in the order of the token before, and go by that."""

    before: np.ndarray
    rank: np.ndarray
    second: np.ndarray
    both: np.ndarray
    which: np.ndarray
    rest: np.ndarray
    head: np.ndarray


def pairs_of(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> Pairs:
    hashed = mix(np.append(words, START))
    order = np.argsort(hashed)
    row = np.empty(len(order), np.uint64)
    row[order] = np.arange(len(order), dtype=np.uint64)
    before = np.empty(len(tokens), np.uint64)
    before[1:] = row[tokens[:-1]]
    before[np.cumsum(sizes) - sizes] = row[-1]
    wide = np.uint64(len(words) + 1)
    both, which = np.unique(before * wide + tokens, return_inverse=True)
    first, second = np.divmod(both, wide)
    ranks = np.append(np.where(code < HEAD, code.astype(np.int32), -1), HEAD)[order]  # START is the last word
    hashed, rank = hashed[order][first], ranks[first]
    pair = mix(hashed ^ words[second] * np.uint64(0x9E3779B97F4A7C15))
    head = np.flatnonzero(rank >= 0)
    return Pairs(hashed, rank, second, pair, which, np.flatnonzero(rank < 0), head[np.argsort(pair[head])])


def _messages(bits: int, turn: int, turns: int):
    """A bucket's share of a chunk's pairs with their counts in training documents; of the buckets those whose turn it is.
    Buckets from 2^bits on are those of pairs behind frequent tokens."""
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
    names = [f.split()[0] for f in MESSAGES.split(", ")]
    edges = np.arange((1 << bits) + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words, tokens, sizes = np.frombuffer(r["words"], np.uint64), _unpack(r["tokens"], "<u4"), np.frombuffer(r["sizes"], np.int32)
                code = _unpack(r["code"], "<u2")[: len(words)]
                p = pairs_of(words, tokens, sizes, code)
                counts = np.bincount(p.which[np.repeat(np.frombuffer(r["train"], bool), sizes)], minlength=len(p.second)).astype("<i4")
                cls = _classes(code)[p.second].astype("<u2")
                for own, place in ((p.rest, p.before), (p.head, p.both)):
                    cuts = np.searchsorted(place[own] >> np.uint64(64 - bits), edges)
                    for at in np.flatnonzero(np.diff(cuts)):
                        if at % turns != turn:
                            continue
                        i = own[cuts[at] : cuts[at + 1]]
                        if own is p.rest:
                            starts = np.flatnonzero(np.append(True, p.before[i][1:] != p.before[i][:-1]))
                            befores, runs = p.before[i[starts]].tobytes(), _pack(np.diff(np.append(starts, len(i))).astype("<u4"))
                        else:
                            befores, runs = b"", _pack(p.rank[i].astype("<u2"))
                        short = p.both[i].astype("<u8").view("<u2").reshape(-1, 4)[:, :3]  # 48 bits tell a bucket's pairs of one token before apart
                        cols = [r["chunk"], int(at) + (0 if own is p.rest else 1 << bits), befores, runs, _pack(cls[i]), short.tobytes(), _pack(counts[i])]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cols, kinds, strict=True)], names=names)

    return run


PAIRS = "chunk long, turn int, bucket int, own binary, total binary, kinds binary, once array<double>, twice array<double>, context array<int>, seen array<long>, types array<long>"


def _pair_total(bits: int, turns: int):
    """Add up a bucket's pairs; a row a chunk with its pairs' counts and, but for frequent tokens before, those of their
    contexts; and one of the numbers of pairs by class that occur once and twice and, for frequent tokens before, of the counts and pairs
    of each context (rank and class), which other buckets add to."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "befores", "runs", "classes", "pairs", "counts"]).to_pylist()
        bucket = table.column("bucket")[0].as_py()
        if bucket < 1 << bits:
            before = np.concatenate([np.repeat(np.frombuffer(r["befores"], np.uint64), _unpack(r["runs"], "<u4")) for r in rows])
        else:
            before = np.concatenate([_unpack(r["runs"], "<u2") for r in rows]).astype(np.uint64)
        cls = np.concatenate([_unpack(r["classes"], "<u2") for r in rows])
        pair = np.zeros((len(before), 4), "<u2")
        pair[:, :3] = np.concatenate([np.frombuffer(r["pairs"], "<u2") for r in rows]).reshape(-1, 3)
        pair = pair.view("<u8").ravel() | cls.astype(np.uint64) << np.uint64(48)  # by class, then by token
        sizes = [len(r["pairs"]) // 6 for r in rows]
        counts = np.concatenate([_unpack(r["counts"], "<i4") for r in rows])
        order = np.lexsort((pair, before))
        before, pair, kind = before[order], pair[order], cls[order]
        new = np.append(True, (before[1:] != before[:-1]) | (kind[1:] != kind[:-1]))
        fresh = new | np.append(True, pair[1:] != pair[:-1])
        n = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(fresh))
        heads = np.flatnonzero(new[fresh])
        seen, types = np.add.reduceat(n, heads), np.add.reduceat((n > 0).astype(np.int64), heads)
        own = np.empty(len(order), np.int64)
        own[order] = n[np.cumsum(fresh) - 1]
        back = [own]
        if bucket < 1 << bits:
            of = np.cumsum(new) - 1
            for x in (seen, types):
                wide = np.empty(len(order), np.int64)
                wide[order] = x[of]
                back.append(wide)
        kinds = kind[fresh]
        once, twice = (np.bincount(kinds[n == k], minlength=CLASSES).astype(float) for k in (1, 2))
        at, out = 0, []
        for r, size in zip(rows, sizes, strict=True):
            i = slice(at, at + size)
            at = i.stop
            packed = [_pack(x[i].astype("<i8")) for x in back] + [None] * (3 - len(back))
            out.append((r["chunk"], turn_of(r["chunk"], turns), bucket, *packed, None, None, None, None, None))
        context = (before[new].astype(np.int64) * CLASSES + kind[new]).astype(np.int32) if bucket >= 1 << bits else None
        out.append((-1, -1, bucket, None, None, None, once, twice, *((context, seen, types) if context is not None else (None,) * 3)))
        types_of = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [f.split()[0] for f in PAIRS.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types_of, strict=True)], names=names)

    return run


def inside_class(q: np.ndarray, own: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """P(token | class, token before) from q, the pair's count, and count and number of the context's pairs."""
    n = np.maximum(total, 1)
    return np.where(total > 0, (np.maximum(own - discount, 0) + discount * kinds * q) / n, q)


def _each(b: pa.RecordBatch) -> Iterator[tuple]:
    """Per chunk: (batch row, train flags, sizes, codes, codes in training, token before, skip)."""
    col = {n: i for i, n in enumerate(b.schema.names)}
    for k in range(b.num_rows):
        sizes = np.frombuffer(b.column(col["sizes"])[k].as_py(), np.int32)
        code, learn = _unpack(b.column(col["code"])[k].as_py(), "<u2").reshape(2, -1)
        word, words = _unpack(b.column(col["tokens"])[k].as_py(), "<u4"), np.frombuffer(b.column(col["words"])[k].as_py(), np.uint64)
        feat = ((mix(words) >> np.uint64(32)) | np.uint64(2)).astype("<u4")[word]
        flags = np.frombuffer(b.column(col["train"])[k].as_py(), bool)
        yield k, flags, sizes, code[word], learn[word], *contexts(feat, np.cumsum(sizes) - sizes)


def _classes(code: np.ndarray) -> np.ndarray:
    return np.where(code < HEAD, code // CLASS, HEAD // CLASS + code.astype(np.int32) - HEAD)


def _gradient(sent):
    """Sum the gradients of a task's chunks; a row a segment of the weight tables, with one of 64 teams the task is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        grad, seen = np.zeros(m.weights.shape), np.zeros(len(m.weights))
        hgrad, hseen = np.zeros(m.head_weights.shape), np.zeros(len(m.head_weights))
        any_rows = False
        for b in batches:
            for _, flags, sizes, _, learn, before, skip in _each(b):
                use = np.flatnonzero(np.repeat(flags, sizes))
                for at in range(0, len(use), 32 * SLICE):
                    i = use[at : at + 32 * SLICE]
                    any_rows = True
                    cls = _classes(learn[i])
                    rows = rows_of(before[i], skip[i], m.bits)
                    error = _error(len(m.class_bias), cls, lambda j, rows=rows: predict(m, [r[j] for r in rows]))
                    for r in rows:
                        _add(grad, seen, r, error)
                    inside = np.flatnonzero(learn[i] < HEAD)
                    if len(inside):
                        row = head_row(before[i[inside]], cls[inside], m.bits)
                        error = _error(CLASS, learn[i[inside]] % CLASS, lambda j, c=cls[inside], row=row: predict_head(m, c[j], row[j]))
                        _add(hgrad, hseen, row, error)
        if any_rows:
            group = TaskContext.get().partitionId() % 64
            for k in range(16):
                parts = [x[k * len(x) // 16 : (k + 1) * len(x) // 16] for x in (grad, seen, hgrad, hseen)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([_pack(np.concatenate([p.ravel() for p in parts]).astype("<f4"))])], names=["segment", "team", "sums"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    total = sum(_unpack(x.as_py(), "<f4").astype(np.float64) for x in table.column("sums"))
    return pa.table({"segment": table.column("segment")[:1], "team": table.column("team")[:1], "sums": pa.array([_pack(total.astype("<f4"))])})


def _step(m: Model, segments: dict[int, bytes], rate: float, decay: float, most: float) -> None:
    """One step along the gradient, scaled by each weight's curvature at the biases."""
    tables = [[], [], [], []]
    for k in range(16):
        flat, at = _unpack(segments[k], "<f4").astype(np.float64), 0
        shapes = [m.weights.shape, (len(m.weights), 1), m.head_weights.shape, (len(m.head_weights), 1)]
        for t, (rows, width) in zip(tables, shapes, strict=True):
            n = rows // 16 * width
            t.append(flat[at : at + n].reshape(-1, width))
            at += n
    grad, seen, hgrad, hseen = (np.concatenate(t) for t in tables)
    p = softmax(m.class_bias[None].astype(np.float64).copy())[0]
    step = (grad - decay * m.weights) / (seen * np.maximum(p * (1 - p), 1e-4) + decay)
    m.weights = m.weights + (rate * np.clip(step, -most, most)).astype(np.float32)
    step = (hgrad - decay * m.head_weights) / (hseen * 0.03 + decay)
    m.head_weights = m.head_weights + (rate * np.clip(step, -most, most)).astype(np.float32)


def _scores(sent, discount: np.ndarray):
    """``sent``: the model, and counts and pairs of the contexts of frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, contexts_of = sent.value
        for b in batches:
            col = {n: i for i, n in enumerate(b.schema.names)}
            for k, flags, sizes, code, _, before, skip in _each(b):
                counted = b.column(col["counted"])[k].as_py()
                words = np.frombuffer(b.column(col["words"])[k].as_py(), np.uint64)
                codes = _unpack(b.column(col["code"])[k].as_py(), "<u2")[: len(words)]
                pairs = pairs_of(words, _unpack(b.column(col["tokens"])[k].as_py(), "<u4"), sizes, codes)
                second, pair, head = pairs.second, pairs.which, pairs.head
                own, total, kinds = np.zeros((3, len(second)), np.int64)
                own[np.concatenate([pairs.rest, head])] = np.concatenate([_unpack(c["own"], "<i8") for c in counted])
                for x, name in ((total, "total"), (kinds, "kinds")):
                    x[pairs.rest] = np.concatenate([np.empty(0, np.int64), *(_unpack(c[name], "<i8") for c in counted if c[name] is not None)])
                total[head], kinds[head] = contexts_of[:, pairs.rank[head], _classes(codes)[second[head]]]
                within = _unpack(b.column(col["within"])[k].as_py(), "<f4")
                log = np.empty(len(code))
                for at in range(0, len(code), SLICE):
                    i = slice(at, at + SLICE)
                    c, cls, w = code[i], _classes(code[i]), pair[i]
                    p = predict(m, rows_of(before[i], skip[i], m.bits))[np.arange(len(c)), cls].astype(np.float64)
                    inside = np.flatnonzero(c < HEAD)
                    q = within[second[w]].astype(np.float64)
                    q[inside] = predict_head(m, cls[inside], head_row(before[i][inside], cls[inside], m.bits))[np.arange(len(inside)), c[inside] % CLASS]
                    log[i] = np.log10(np.maximum(p * inside_class(q, own[w], total[w], kinds[w], discount[cls]), 1e-300))
                starts = np.cumsum(sizes) - sizes
                known, base = _unpack(b.column(col["known"])[k].as_py(), "<i8"), np.frombuffer(b.column(col["base"])[k].as_py(), np.float64)
                cols = [b.column(col["ids"])[k].values, pa.array(~flags), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(sizes), m.n)), pa.array(base), pa.array(np.add.reduceat(log, starts))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCORES.split(", ")])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, rounds: int = 4, rate: float = 0.5, decay: float = 20.0, most: float = 1.5, tokens_a_chunk: int = 1_000_000) -> DataFrame:
    """A row a row of ``docs`` (doc_id, text, train): see ``SCORES``. base_score is that of the add-one unigram model.

    Null and empty texts are the end token alone; null ids are kept; rows that repeat an id are documents of their
    own; other columns are ignored. Without training rows every token is unseen: N and V are 0 and both scores 0
    where the unseen event is certain. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("train").cast("boolean").alias("train"))
    bits = max(4, int(2 * docs.rdd.getNumPartitions() - 1).bit_length())
    chunks = common.materialise(chunked(docs, bits, tokens_a_chunk), "lm-chunks")
    words = chunks.where("kind = 1").select("chunk", "bucket", "words", "counts")
    totals = common.materialise(words.groupBy("bucket").applyInArrow(_total, TOTALS), "lm-totals")
    stats = totals.where("chunk = -1")
    sums = stats.select(*(F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(2 + 2 * len(BANDS)))).first()
    tops = stats.select("top", "top_counts").where("top IS NOT NULL").mapInArrow(_tops, "word long, n long").orderBy(F.desc("n"), "word").limit(HEAD).collect()
    model = _start([float(x or 0) for x in sums], [(r["word"] % (1 << 64), r["n"]) for r in tops])
    by_chunk = totals.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("totals"))
    sent = spark.sparkContext.broadcast(model)
    data = chunks.where("kind = 0").select("chunk", "ids", "train", "sizes", "words", "tokens").join(by_chunk, "chunk")
    data = data.select("ids", "train", "sizes", "words", "tokens", "totals", "chunk")
    ready = common.materialise(data.mapInArrow(_prepare(sent, rounds), READY), "lm-ready")
    common.drop_table(chunks)
    common.drop_table(totals)
    del chunks, words, totals, stats, by_chunk, data
    common.sweep(spark)
    parts = []
    for turn in range(PAIR_TURNS):  # so the disk holds the shuffle of a share of the buckets at a time
        sent_on = ready.select("chunk", "words", "tokens", "sizes", "train", "code").mapInArrow(_messages(bits + 1, turn, PAIR_TURNS), MESSAGES)
        parts.append(common.materialise(sent_on.groupBy("bucket").applyInArrow(_pair_total(bits + 1, rounds), PAIRS), "lm-pairs", by="turn"))
        del sent_on
        common.sweep(spark)
    pairs = reduce(DataFrame.unionByName, parts)
    facts = pairs.where("turn = -1")
    once, twice = ([r[0] for r in facts.select(F.posexplode(c).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").select("x").collect()] or [0.0] * CLASSES for c in ("once", "twice"))
    discount = (np.array(once) + 0.5) / (np.array(once) + 2 * np.array(twice) + 0.5)
    each = facts.where("context IS NOT NULL").select(F.explode(F.arrays_zip("context", "seen", "types")).alias("x"))
    contexts_of = np.zeros((2, (HEAD + 1) * CLASSES), np.int64)  # frequent tokens before by class, a fixed number
    for r in each.groupBy("x.context").agg(F.sum("x.seen").alias("seen"), F.sum("x.types").alias("types")).collect():
        contexts_of[:, r["context"]] = r["seen"], r["types"]
    contexts_of = contexts_of.reshape(2, HEAD + 1, CLASSES)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        part = ready.where(F.col("turn") == turn).select("train", "sizes", "code", "words", "tokens")
        fields = "segment int, team int, sums binary"  # teams first, so no task holds the tables of all tasks
        summed = part.mapInArrow(_gradient(sent), fields).groupBy("segment", "team").applyInArrow(_add_up, fields).groupBy("segment").applyInArrow(_add_up, fields)
        segments = {r["segment"]: bytes(r["sums"]) for r in summed.collect()}  # as large as the weights, which have a bound
        if segments:
            _step(model, segments, rate, decay, most)
        del part, summed
        common.sweep(spark)
    sent, done = spark.sparkContext.broadcast((model, contexts_of)), []
    for turn in range(rounds):  # chunks meet the counts of their pairs, a share of them at a time
        counted = pairs.where(F.col("turn") == turn).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "own", "total", "kinds"))).alias("counted"))
        whole = ready.where(F.col("turn") == turn).select("chunk", "ids", "train", "sizes", "known", "base", "code", "words", "tokens", "within").join(counted, "chunk")
        done.append(common.materialise(whole.mapInArrow(_scores(sent, discount), SCORES), "lm-scores"))
        del counted, whole
        common.sweep(spark)
    for t in (ready, *parts):
        common.drop_table(t)
    return reduce(DataFrame.unionByName, done)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(n, "<i8"))], names=["word", "n"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model learnt from those outside the held-out seventh."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(docs.withColumn("train", ~F.coalesce(held, F.lit(False))))
