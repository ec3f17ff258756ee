"""Exact top-k inner products by a three-phase uniform threshold.

Each quantised vector is cut into lists of neighbouring dimensions; its score is the sum of its local scores in
the lists. Queries and rows are packed into blocks; every block of queries meets every group of blocks of rows in a task
(a tile). Phase 1 gathers the k best local scores of each query and list, with the whole scores of those candidates; the
k-th best of these is a score that k candidates reach, hence a safe cutoff. Phase 2 sends the cutoffs back with the queries and
collects every candidate with, in some list, a local score of at least its even share of the cutoff (any other
candidate stays below it in total). It goes from list to list, and drops a candidate once its score so far and the product of the lengths of what is left
stay below the cutoff; where few are left, phase 3 works out the rest for these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import dense

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

LOW = np.iinfo(np.int64).min
HIGH = np.iinfo(np.int64).max
FEW = 16  # of so many candidates at most one may be left for the rest to be worked out one by one


def quantise(matrix: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * matrix)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as 64-bit integers; doubles do it where they are exact."""
    top = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * a.shape[1]
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def each_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the rows of one matrix with those of the other, one by one."""
    top = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * a.shape[1]
    if top < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)


BLOCK = "block long, dim int, ids binary, vectors binary"


def packed(rows: DataFrame, size: int, scale: float, name: str) -> DataFrame:
    """Blocks (block, dim, ids, vectors) of at most ``size`` usable rows of (vec_id, embedding) of one dimension, quantised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            made += 1
            cols = [pa.array([(part << 32) + made]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in BLOCK.split(", ")])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim, (at, m) in dense(b.column(1)).items():
                done = 0
                while done < len(at):
                    room = size - sum(len(x) for x, _ in held.get(dim, ()))
                    i = slice(done, done + room)
                    held.setdefault(dim, []).append((ids[at[i]], quantise(m[i], scale)))
                    done += room
                    if sum(len(x) for x, _ in held[dim]) == size:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)

    return common.materialise(rows.mapInArrow(run, BLOCK), name)


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim)


def _lists(dim: int, n_lists: int) -> list[slice]:
    cuts = [len(x) for x in np.array_split(np.arange(dim), n_lists)]
    return [slice(end - n, end) for n, end in zip(cuts, np.cumsum(cuts), strict=True)]


def search(queries: DataFrame, data: DataFrame, k: int = 5, scale: float = 256.0, n_lists: int = 4, block: int = 1024, group: int = 16) -> DataFrame:
    """The k best of ``data`` for every query: query_id, rank, vec_id, score (integer inner product of floor(scale * x)).

    Both take (vec_id, embedding). Ties go to the smaller vec_id. Rows without an id or vector, with an empty
    vector or with null or non-finite components take no part; vectors meet only those of their own dimension; a
    query meets every row but those of its own id. Of rows that repeat id and vector one counts; of queries that
    repeat an id the one with the smallest vector counts. Of equal vectors only the k + 1 smallest ids can reach a
    result, so the others are set aside first. A task holds ``block`` queries and ``group`` blocks of ``block`` rows; all
    tiles are one job a phase, and nothing is kept on the driver. Empty tables give no rows.
    """
    fields = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    same = Window.partitionBy("embedding").orderBy("vec_id")
    data = data.select(*fields).where("vec_id IS NOT NULL AND size(embedding) > 0").distinct()
    data = data.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "embedding")
    queries = queries.select(*fields).where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = packed(data, block, scale, "topk-rows")
    asked = packed(queries.coalesce(max(1, queries.count() // block)), block, scale, "topk-queries")
    place = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1  # a row a block
    of = common.materialise(rows.select("dim", "block").withColumn("group", F.floor(place / group)), "topk-groups")
    tiles = asked.select("dim", F.col("block").alias("q_block")).join(of.select("dim", "group").distinct(), "dim")  # every query block, every group
    tiles = common.materialise(tiles, "topk-tiles")
    grouped = rows.join(of, ["dim", "block"]).groupBy("dim", "group").agg(F.collect_list(F.struct("ids", "vectors")).alias("rows"))
    grouped = common.materialise(grouped, "topk-grouped")
    asked = asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def blocks(b: pa.RecordBatch, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        of = b.column(3)[r].values
        for ids, vectors in zip(of.field(0), of.field(1), strict=True):
            yield _matrix(ids.as_buffer(), vectors.as_buffer(), b.column(0)[r].as_py())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                q_ids, q = _matrix(b.column(1)[r].as_buffer(), b.column(2)[r].as_buffer(), dim)
                lists = _lists(dim, n_lists)
                best = [np.full((len(q), k), LOW) for _ in lists]
                vec, whole = ([np.zeros((len(q), k), np.int64) for _ in lists] for _ in range(2))
                low = np.full((len(q), n_lists), HIGH)
                for ids, x in blocks(b, r):
                    own = q_ids[:, None] == ids[None, :]
                    local = [products(q[:, i], x[:, i]) for i in lists]
                    total = sum(local)
                    for j, s in enumerate(local):
                        low[:, j] = np.minimum(low[:, j], np.where(own, HIGH, s).min(axis=1))
                        s[own] = LOW
                        top = np.argpartition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                        new = np.take_along_axis(s, top, 1), ids[top], np.take_along_axis(total, top, 1)
                        s, c, t = (np.concatenate(pair, 1) for pair in zip((best[j], vec[j], whole[j]), new, strict=True))
                        top = np.argpartition(s, -k, axis=1)[:, -k:]
                        best[j], vec[j], whole[j] = (np.take_along_axis(y, top, 1) for y in (s, c, t))
                score = np.stack(best, 1)
                a, j, n = np.nonzero(score > LOW)
                cols = [q_ids[a], j, np.stack(vec, 1)[a, j, n], score[a, j, n], np.stack(whole, 1)[a, j, n], low[a, j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names="query_id list vec_id local whole low".split())

    spark = data.sparkSession
    tile = lambda asked: tiles.join(asked, ["dim", "q_block"]).join(grouped, ["dim", "group"])
    with common.batches_of(spark, 1):
        met = tile(asked).select("dim", "q_ids", "q_vectors", "rows")
        lists = common.materialise(met.mapInArrow(gather, "query_id long, list long, vec_id long, local long, whole long, low long"), "topk-lists")
    lows = lists.groupBy("query_id", "list").agg(F.min("low").alias("low")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "low"))), lambda x: x["low"]).alias("low"))
    top = Window.partitionBy("query_id", "list").orderBy(F.desc("local"), "vec_id")
    known = lists.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("query_id", "vec_id", "whole").distinct()
    reached = known.groupBy("query_id").agg(F.sort_array(F.collect_list("whole"), asc=False).alias("s"))  # k scores a list at most
    lowest = F.aggregate("low", F.lit(0).cast("long"), lambda x, y: x + y)
    cutoff = lows.join(reached, "query_id").select("query_id", "low", F.coalesce(F.get("s", F.lit(k - 1)), lowest).alias("cutoff"))  # fewer than k candidates: all stay
    cutoff = common.materialise(cutoff, "topk-cutoffs")

    def armed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks taken apart, one row a query."""
        for b in batches:
            for dim, block, ids, vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, x = _matrix(ids, vectors, dim)
                cols = [pa.array(np.full(len(ids), dim), pa.int32()), pa.array(np.full(len(ids), block)), pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "q_block", "query_id", "vector"])

    single = asked.select("dim", "q_block", "q_ids", "q_vectors").mapInArrow(armed, "dim int, q_block long, query_id long, vector binary")
    single = single.join(cutoff, "query_id").groupBy("dim", "q_block").agg(F.collect_list(F.struct("query_id", "vector", "low", "cutoff")).alias("queries"))  # a block's
    single = common.materialise(single, "topk-armed")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, lists = b.column(0)[r].as_py(), _lists(b.column(0)[r].as_py(), n_lists)
                of = b.column(1)[r].values
                q_ids, cutoff = of.field(0).to_numpy(), of.field(3).to_numpy()
                q = np.stack([np.frombuffer(v.as_buffer()) for v in of.field(1)])
                low = of.field(2).flatten().to_numpy().reshape(len(q_ids), -1)
                share = low + ((cutoff - low.sum(axis=1)) / n_lists)[:, None]  # what some list must reach
                for ids, x in blocks(b, r):
                    a, c, score = survivors(q, x, cutoff, share, lists)
                    keep = (score >= cutoff[a]) & (q_ids[a] != ids[c])
                    cols = [q_ids[a[keep]], ids[c[keep]], score[keep]]
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(y, np.int64)) for y in cols], names=["query_id", "vec_id", "score"])

    with common.batches_of(spark, 1):
        met = tile(single).select("dim", "queries", "q_block", "rows")
        entries = common.materialise(met.mapInArrow(collect, "query_id long, vec_id long, score long"), "topk-entries")
    for t in (of, tiles, grouped, lists, cutoff, single, rows):
        common.drop_table(t)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def survivors(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray, share: np.ndarray, lists: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, whole score) of candidates that have some list at its share and may reach their query's cutoff.

    After each list, candidates whose score so far and the product of the lengths of what is left stay below the cutoff go;
    once few are left, what is left is worked out for these alone.
    """
    total, hit = np.zeros((len(q), len(x)), np.int64), np.zeros((len(q), len(x)), bool)
    left = lambda m, at: np.sqrt((m[:, at:] ** 2).sum(axis=1))
    for j, i in enumerate(lists):
        local = products(q[:, i], x[:, i])
        total += local
        hit |= local >= share[:, j, None]
        if j + 1 == len(lists):
            break
        bound = np.outer(left(q, i.stop), left(x, i.stop))
        may = total + bound * (1 + 1e-9) + 1 >= cutoff[:, None]
        if np.count_nonzero(may) * FEW <= may.size:
            a, c = np.nonzero(may)
            score, reached = total[a, c], hit[a, c]
            for rest, s in zip(lists[j + 1 :], share.T[j + 1 :], strict=True):
                local = each_product(q[a, rest], x[c, rest])
                score, reached = score + local, reached | (local >= s[a])
            return a[reached], c[reached], score[reached]
    a, c = np.nonzero(hit & (total >= cutoff[:, None]))
    return a, c, total[a, c]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth embedding, against all rows."""
    data = common.table(spark, sf_dir, "embeddings")
    return search(data.where("vec_id % 50 = 0"), data)
