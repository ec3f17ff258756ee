"""Best-fit decreasing packing of token pieces into windows, exact over the whole table.

A piece matters to the packing by its length alone, and lengths run from 1 to the window. So the packing is found
on the histogram of lengths (``window`` counters whatever the table's size): identical pieces are placed in runs,
open windows of equal remaining capacity are groups, and a segment tree over capacities finds the tightest one. A
piece then finds its window by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_files import with_crc
from .tokens import encoder, tokenizer_path

ORACLE_SQL = None


class CapacityTree:
    """A segment tree over capacities 0..size; each leaf holds the groups of open windows with that capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.open[k] += by
            k >>= 1

    def push(self, capacity: int, first: int, count: int) -> None:
        heapq.heappush(self.groups[capacity], (first, count))
        self._count(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return heapq.heappop(self.groups[capacity])

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open window."""
        k = self.leaves + least
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, pieces a window, first window, offset) that place ``counts`` pieces of each length.

    The piece of rank g in a run goes to window first + (g - first rank) // a at offset + (g - first rank) % a *
    length, with a the pieces a window. This is what best-fit decreasing does piece by piece: a piece goes to the
    open window with the least room that takes it, the earliest opened of equal ones, else to a new window.
    """
    tree, runs, windows = CapacityTree(window), [], 0
    for length in sorted((n for n, c in counts.items() if n > 0 and c > 0), reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            room = tree.tightest(length)
            fits = (room or window) // length
            need = -(-(total - rank) // fits)
            if room is None:
                room, first, count = window, windows, need
                windows += need
            else:
                first, count = tree.pop(room)
                if count > need:
                    tree.push(room, first + need, count - need)
                    count = need
            end = min(total, rank + fits * count)
            runs.append((length, rank, end, fits, first, window - room))
            whole, rest = divmod(end - rank, fits)
            if whole and room - fits * length:
                tree.push(room - fits * length, first, whole)
            if rest and room - rest * length:
                tree.push(room - rest * length, first + whole, 1)
            rank = end
    return runs


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", words: int = 600_000) -> DataFrame:
    """Encode each text, append ``end_id`` and cut full windows off overlong documents. A worker keeps the ids of ``words`` words.

    Rows: doc_id, start, length, doc_tokens, ids (unsigned 32-bit, little-endian), part (the writing task), nth
    (the piece's rank among the task's pieces of its length). Written to the shared folder, so part and nth hold.
    """
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, words), TaskContext.get().partitionId(), [0] * (window + 1)
        rows, size = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), len(ids), piece.tobytes(), part, seen[len(piece)]))
                    seen[len(piece)] += 1
                size += len(ids)
                if size >= 1 << 21:
                    yield _piece_rows(rows)
                    rows, size = [], 0
        if rows:
            yield _piece_rows(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.materialise(rows.mapInArrow(cut, PIECES), "pack-pieces")


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, nth long"


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def place(pieces: DataFrame, source: DataFrame, window: int = 2048) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, which hold length, part and nth of ``source``, the table ``cut_pieces`` wrote.

    The driver gets the histogram (``window`` rows) and sends out the runs of the packing, whose number depends on
    the window alone. Ranks come from counts by task and length, joined on both.
    """
    by_task = source.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_decreasing(counts, window)), dtype=np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = pieces.join(base, ["part", "length"])
    keep = [c for c in pieces.columns if c not in ("part", "nth")]
    rows = rows.select(*keep, (F.col("base") + F.col("nth")).alias("rank"))
    span = 1 << 44
    keys = runs[:, 0] * span + runs[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * span + rank, side="right") - 1]
            at = rank - run[:, 1]
            seq, off = run[:, 4] + at // run[:, 3], run[:, 5] + at % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*keep).schema)
    return rows.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces with their ids, sequence and offset. Null text counts as empty (its piece is the end id alone);
    repeated rows are packed one by one; null ids are kept; an empty table gives no row; other columns are ignored."""
    pieces = cut_pieces(docs, tokenizer, window, end_id)
    return place(pieces, pieces, window)


def padded_length(used: int, window: int = 2048) -> int:
    """A sequence is padded to the window, except where its length is a power of two."""
    return used if used and used & (used - 1) == 0 else window


def pack_digest(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """As ``pack_documents``, with the ids' crc32 in place of the ids, so only small rows are shuffled; that leaves room for more
    words in a worker's memory (some 100 bytes each)."""
    pieces = cut_pieces(docs, tokenizer, window, end_id, words=1_200_000)
    return place(with_crc(pieces, "ids").drop("n_ids"), pieces, window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of at most 2048 ids."""
    packed = pack_digest(common.table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
