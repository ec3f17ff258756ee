"""Embedding near-duplicates by dual traversal of cover trees, exact at the threshold.

Unit vectors are linked where their distance is at most sqrt(2 - 2 * threshold). Centres of a cover with halving
radii, fitted on a bounded sample, deal the vectors into cells with measured covering radii; cells are cut into
blocks of neighbouring shells. Cell and block pairs too far apart for their radii are pruned; in each block pair
left, two cover trees (nested levels, halving radii) are walked together, node pairs are pruned by the same bound,
and leaf pairs are compared by exact cosine, after a bound from a part of their dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import dense

ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS ok
  FROM embeddings
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), comp AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN comp ON comp.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

LEAF = 64
GROUP = 8  # blocks that travel together
ROUNDING = 1e-5  # more than products in single precision are off
SLACK = 1e-7  # distances from products of unit vectors are good to about 1e-8; the bounds get this much more


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(points: np.ndarray, first: int, radius: float, most: int) -> list[np.ndarray] | None:
    """Row sets of greedy balls of ``radius``, each led by its centre; None if there would be more than ``most``."""
    rest, balls = np.arange(len(points)), []
    lead = first
    while len(rest):
        if len(balls) == most:
            return None
        d = distance(points[rest], points[lead : lead + 1])[:, 0]
        near = d <= radius
        near[rest == lead] = True
        balls.append(np.concatenate([[lead], rest[near & (rest != lead)]]))
        d, rest = d[~near], rest[~near]
        if len(rest):
            lead = int(rest[np.argmax(d)])
    return balls


class Node:
    """A cover-tree node: its rows (the centre first), covering radius and children."""

    __slots__ = ("rows", "radius", "children")

    def __init__(self, rows: np.ndarray, radius: float, children: list[Node]):
        self.rows, self.radius, self.children = rows, radius, children


def build(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A cover tree of unit vectors. Levels halve the covering radius; a level that would split into nearly single rows is left out."""
    rows = np.arange(len(points)) if rows is None else rows
    radius = float(distance(points[rows], points[rows[:1]])[:, 0].max())
    if len(rows) <= LEAF or radius < 1e-6:
        return Node(rows, radius, [])
    level = radius / 2
    while level > 1e-6:
        balls = cover(points[rows], 0, level, max(2, len(rows) // 8))
        if balls is None:
            return Node(rows, radius, [])
        if len(balls) > 1:
            return Node(rows, radius, [build(points, rows[b]) for b in balls])
        level /= 2
    return Node(rows, radius, [])


def node_pairs(a: Node, b: Node, x: np.ndarray, y: np.ndarray, reach: float) -> Iterator[tuple[Node, Node]]:
    """Pairs of leaves of two trees that may hold points within ``reach`` of each other."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if float(distance(x[p.rows[:1]], y[q.rows[:1]])[0, 0]) > p.radius + q.radius + reach + SLACK:
            continue
        if not p.children and not q.children:
            yield p, q
        elif not q.children or p.children and p.radius >= q.radius:
            todo += [(c, q) for c in p.children]
        else:
            todo += [(p, c) for c in q.children]


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a row-by-column link matrix: the lowest row that each row and each column is connected to (-1: none)."""
    n, none = linked.shape[0], linked.shape[0]
    rows = np.where(linked.any(axis=1), np.arange(n), none)
    while True:
        cols = np.where(linked, rows[:, None], none).min(axis=0)
        new = np.minimum(rows, np.where(linked, cols[None, :], none).min(axis=1))
        if (new == rows).all():
            return np.where(rows == none, -1, rows), np.where(cols == none, -1, cols)
        rows = new


def bounded(points: np.ndarray) -> np.ndarray:
    """The first quarter of each vector and the length of the rest, in single precision: products of these are no less than those
    of the vectors, but for ``ROUNDING``."""
    cut = max(1, points.shape[1] // 4)
    rest = points[:, cut:]
    return np.concatenate([points[:, :cut], np.sqrt((rest * rest).sum(axis=1))[:, None]], axis=1).astype(np.float32)


@lru_cache(maxsize=32)
def _tree(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, Node]:
    points = np.frombuffer(data, np.float64).reshape(-1, dim)
    return points, bounded(points), build(points)


def links_between(x: np.ndarray, y: np.ndarray, short_x: np.ndarray, short_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of x, row of y) of unit vectors whose cosine reaches the threshold. Where the products of their ``bounded``
    forms leave few pairs, these alone are worked out in full."""
    maybe = short_x @ short_y.T >= np.float32(threshold - ROUNDING)
    n = np.count_nonzero(maybe)
    if n * 16 > maybe.size:
        return np.nonzero(x @ y.T >= threshold)
    r, c = np.nonzero(maybe) if n else (np.empty(0, int), np.empty(0, int))
    linked = np.einsum("ij,ij->i", x[r], y[c]) >= threshold
    return r[linked], c[linked]


def block_links(ids_a, mult_a, data_a: bytes, ids_b, mult_b, data_b: bytes, dim: int, threshold: float, same: bool):
    """(link counts of a's and b's rows, edges (id, id) that connect what the links connect)."""
    (x, short_x, ta), (y, short_y, tb) = _tree(data_a, dim), _tree(data_b, dim)
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    na, nb, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for p, q in node_pairs(ta, tb, x, y, reach):
        r, c = links_between(x[p.rows], y[q.rows], short_x[p.rows], short_y[q.rows], threshold)
        if same:
            apart = p.rows[r] != q.rows[c]
            r, c = r[apart], c[apart]
        if not len(r):
            continue
        na += np.bincount(p.rows[r], mult_b[q.rows[c]], len(x)).astype(np.int64)
        if not same:
            nb += np.bincount(q.rows[c], mult_a[p.rows[r]], len(y)).astype(np.int64)
        (own, i), (other, j) = np.unique(r, return_inverse=True), np.unique(c, return_inverse=True)
        linked = np.zeros((len(own), len(other)), bool)
        linked[i, j] = True
        rows, cols = forest(linked)
        edges += [(ids_a[p.rows[own]], ids_a[p.rows[own[rows]]]), (ids_b[q.rows[other]], ids_a[p.rows[own[cols]]])]
    return na, nb, edges


def _centres(sample: np.ndarray, reach: float, most: int = 256) -> np.ndarray:
    """Centres of the deepest cover level with at most ``most`` balls; a nested level starts from the one above."""
    found, radius = np.zeros(1, int), 1.0
    while radius > reach / 2:
        balls = cover(sample, 0, radius, most)
        if balls is None:
            break
        found = np.array([b[0] for b in balls])
        radius /= 2
    return sample[found]


def near_duplicates(data: DataFrame, threshold: float = 0.95, sample: int = 4096, block: int = 1024) -> DataFrame:
    """One row per row of ``data`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link where their cosine, in doubles, is at least ``threshold``; only those of one dimension are
    compared. Null or empty vectors, zero vectors and those with null or non-finite components link with nothing.
    Equal vectors form one class, which is compared once; each row still counts the other rows of its class. Rows
    that repeat an id are rows of their own; a null id stays alone (component_id null). Other columns are ignored;
    an empty table gives an empty result. ``sample`` bounds the vectors on which the top level of the cover is
    fitted: it steers where pairs are compared, never which are found.
    """
    spark = data.sparkSession
    e = F.col("embedding")
    good = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0), F.lit(False))
    rows = data.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), e).alias("embedding"))
    classes = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = common.materialise(classes, "vector-classes")
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    centres, radii = {}, {}
    for batch in classes.orderBy(F.xxhash64("rep")).limit(sample).select("embedding").toArrow().to_batches():
        for dim, (_, m) in dense(batch.column(0)).items():
            centres.setdefault(dim, []).append(m)
    most = max(16, min(256, classes.count() // (2 * block)))  # cells of a block or two at least
    centres = {dim: _centres(_unit(np.concatenate(m)), reach, most) for dim, m in centres.items()}
    first = {dim: sum(len(c) for d, c in centres.items() if d < dim) for dim in centres}
    sent = spark.sparkContext.broadcast((centres, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class's cell (its nearest centre) and distance from there."""
        centres, first = sent.value
        for b in batches:
            vectors = b.column(0)
            for dim, (at, m) in dense(vectors).items():
                u = _unit(m)
                if dim in centres:
                    d = distance(u, centres[dim])
                    cell, far = first[dim] + d.argmin(axis=1), d.min(axis=1)
                else:  # a dimension that the sample missed: one cell around the origin
                    cell, far = np.full(len(at), -dim), np.full(len(at), 2.0)
                blobs = [r.tobytes() for r in u]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(blobs, pa.binary())], names=["cell", "far", "rep", "n", "unit"])

    dealt = classes.select("embedding", "rep", "n").mapInArrow(deal, "cell long, far double, rep long, n long, unit binary")
    dealt = common.materialise(dealt, "vector-cells")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of neighbouring rows of a cell."""
        part, made, key, held = TaskContext.get().partitionId(), 0, None, []

        def close() -> pa.RecordBatch:
            nonlocal made
            cell, dim = key
            far, reps, n, units = zip(*held, strict=True)
            made += 1
            cols = [[(part << 32) + made], [cell], [dim], [min(far)], [max(far)], [np.array(reps, np.int64).tobytes()], [np.array(n, np.int64).tobytes()], [b"".join(units)]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "cell", "dim", "lo", "hi", "reps", "mults", "units"])

        for b in batches:
            for cell, far, rep, n, unit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (key != (cell, len(unit) // 8) or len(held) == block):
                    yield close()
                    held = []
                key = cell, len(unit) // 8
                held.append((far, rep, n, unit))
        if held:
            yield close()

    order = ["cell", "far", "rep"]
    blocks = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(gather, "block long, cell long, dim long, lo double, hi double, reps binary, mults binary, units binary")
    blocks = common.materialise(blocks, "vector-blocks")
    for r in blocks.groupBy("cell").agg(F.max("hi").alias("hi")).collect():  # a row a cell, bounded like the centres
        radii[r["cell"]] = r["hi"]
    near = [(c, c) for c in radii]
    for dim, c in centres.items():
        d = distance(c, c)
        near += [(first[dim] + i, first[dim] + j) for i in range(len(c)) for j in range(len(c)) if i != j and {first[dim] + i, first[dim] + j} <= radii.keys() and d[i, j] <= radii[first[dim] + i] + radii[first[dim] + j] + reach + SLACK]
    links = _compare(spark, blocks, near, reach, threshold)
    counts = links.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    comps = common.components(links.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), "vector-components")
    found = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select(F.col("embedding").alias("key"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    found = common.materialise(found, "vector-found")
    out = rows.join(found, rows["embedding"] == found["key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _compare(spark: SparkSession, blocks: DataFrame, near: list[tuple[int, int]], reach: float, threshold: float) -> DataFrame:
    """Rows (kind 0, rep, links) and (kind 1, rep, rep joined to) over all block pairs of the cell pairs in ``near``."""
    cells = spark.createDataFrame(near or [(-1, -1)], "cell long, to long")
    a = blocks.select(F.col("block").alias("block_a"), "cell", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("dim").alias("dim_a"))
    b = blocks.select(F.col("block").alias("block_b"), F.col("cell").alias("to"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("dim").alias("dim_b"))
    shells = "cell <> to OR (lo_a - hi_b <= {0} AND lo_b - hi_a <= {0})".format(reach + SLACK)
    pairs = a.join(cells, "cell").join(b, "to").where("block_a <= block_b AND dim_a = dim_b").where(shells).select("block_a", "block_b")
    # neighbouring blocks travel together: a tile is two such groups, with the pairs of their blocks that are near
    group = lambda c: (F.shiftright(c, 32).bitwiseAND(F.lit((1 << 31) - 1)) * (1 << 32) + F.floor((F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) - 1) / GROUP)).cast("long")
    tiles = pairs.groupBy(group("block_a").alias("group_a"), group("block_b").alias("group_b")).agg(F.collect_list(F.struct("block_a", "block_b")).alias("pairs"))
    tiles = common.materialise(tiles, "block-tiles")  # a row has GROUP * GROUP pairs at most
    held = blocks.groupBy(group("block").alias("group")).agg(F.collect_list(F.struct("block", "dim", "reps", "mults", "units")).alias("blocks"))
    held = common.materialise(held, "block-groups")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known = {}
                for c in (1, 2):
                    of = batch.column(c)[k].values
                    block, dim, reps, mults, units = (of.field(i) for i in range(5))
                    for j in range(len(of)):
                        known[block[j].as_py()] = dim[j].as_py(), np.frombuffer(reps[j].as_py(), np.int64), np.frombuffer(mults[j].as_py(), np.int64), units[j].as_py()
                for pair in batch.column(0)[k].as_py():
                    (dim, ia, ma, xa), (_, ib, mb, xb) = known[pair["block_a"]], known[pair["block_b"]]
                    na, nb, edges = block_links(ia, ma, xa, ib, mb, xb, dim, threshold, pair["block_a"] == pair["block_b"])
                    kind, u, v = [], [], []
                    for ids, n in ((ia, na), (ib, nb)):
                        at = np.flatnonzero(n)
                        kind.append(np.zeros(len(at), np.int64)), u.append(ids[at]), v.append(n[at])
                    for x, y in edges:
                        at = np.flatnonzero(x != y)
                        kind.append(np.ones(len(at), np.int64)), u.append(x[at]), v.append(y[at])
                    if sum(map(len, kind)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kind, u, v)], names=["kind", "a", "b"])

    left, right = held.select(F.col("group").alias("group_a"), F.col("blocks").alias("blocks_a")), held.select(F.col("group").alias("group_b"), F.col("blocks").alias("blocks_b"))
    joined = tiles.join(left, "group_a").join(right, "group_b").select("pairs", "blocks_a", "blocks_b")
    with common.batches_of(spark, 1):
        return common.materialise(joined.mapInArrow(walk, "kind long, a long, b long"), "vector-links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
