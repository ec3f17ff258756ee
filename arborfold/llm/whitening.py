"""Whitening of embeddings by a compensated covariance.

Vectors are quantised to integers, so counts and sums are exact. Each task takes rows less their mean, as pairs of a high
and a low double, and adds up their outer products without rounding them: the pairs are cut into slices of so few
bits that products of slices, summed over a block of rows, are exact in doubles, and these exact sums are added in
double-double arithmetic. High and low parts are merged across tasks the same way. The covariance's eigenvectors come
from LAPACK's divide and conquer on the tridiagonal form (``numpy.linalg.eigh``); they and the matrix are
of the dimension's size, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: SQL has no eigenvectors; the tests hold the query against exact fractions.
ORACLE_SQL = None

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
ROWS = 1024  # a block of rows: products of two slices, summed over it, take 50 bits
SLICE, SLICES = 20, 5  # bits of a slice; five hold what a pair of doubles holds within 2^-100 of a block's largest entry
LIMIT = 2.0**30  # entries of this size or more would have no exact sums
SPREAD = 64  # groups in which tasks' sums are merged first
SUMS = "dim long, line long, part long, hi binary, lo binary"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as its rounded sum and the exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, hi2: np.ndarray, lo2: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two numbers in double-double."""
    s, e = two_sum(hi, hi2)
    return two_sum(s, e + (lo + lo2))


def slices(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Matrices on ever finer grids that add up to hi + lo."""
    top = np.abs(hi).max(initial=0)
    if top == 0:
        return []
    unit, found = 2.0 ** (int(np.frexp(top)[1]) - SLICE), []
    for _ in range(SLICES):
        part = np.round(hi / unit) * unit
        found.append(part)
        hi, lo = two_sum(hi - part, lo)  # hi - part is exact
        unit /= 2.0**SLICE
    return found


def outer(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products in double-double, of ``ROWS`` rows at most: a product of slices is exact; small ones go first."""
    total = np.zeros((hi.shape[1],) * 2), np.zeros((hi.shape[1],) * 2)
    parts = slices(hi, lo)
    for i, j in sorted(((i, j) for i in range(len(parts)) for j in range(len(parts)) if i + j < SLICES), key=sum, reverse=True):
        total = add(*total, parts[i].T @ parts[j])
    return total


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a batch (dim, vector, more), in blocks of rows."""
    dims, vectors = batch.column(0).to_numpy(), batch.column(1)
    flat, sizes = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for at in (rows[k : k + ROWS] for k in range(0, len(rows), ROWS)):
            yield int(dim), at, flat[starts[at][:, None] + np.arange(sizes[at[0]])]


def quantise(matrix: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * matrix) + SHIFT


def totals(data: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Dimension -> (rows, sums of the quantised entries), exact, of ``data`` (dim, vector)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for dim, at, m in _blocks(b):
                sums = quantise(m).astype(np.int64).sum(axis=0).tolist()
                n, old = held.get(dim, (0, [0] * dim))
                held[dim] = n + len(at), [x + y for x, y in zip(old, sums, strict=True)]
        rows = [(dim, k, n, s) for dim, (n, sums) in held.items() for k, s in enumerate(sums)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["dim", "line", "n", "s"])

    lines = data.mapInArrow(local, "dim long, line long, n long, s decimal(38,0)").groupBy("dim", "line").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in lines.orderBy("dim", "line").collect():  # a row a dimension's line
        found.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return found


def _sums(held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A row a line of each dimension's sums."""
    part = TaskContext.get().partitionId()
    cols = [[k[0] for k in held], [k[1] for k in held], [part] * len(held)]
    blobs = [pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *blobs], names=[f.split()[0] for f in SUMS.split(", ")])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums added up line by line as they come; a task holds one a line it meets."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for dim, line, hi, lo in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            new = np.frombuffer(hi), np.frombuffer(lo)
            held[dim, line] = add(*held[dim, line], *new) if (dim, line) in held else new
    yield from _sums(held)


def covariance(data: DataFrame, values: Callable[[np.ndarray], np.ndarray], means: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Dimension -> covariance of ``values(matrix)`` over ``data`` (dim, vector), divisor n; ``means`` has n and the mean's high and low parts."""
    sent = data.sparkSession.sparkContext.broadcast(means)  # two numbers a dimension's line

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for dim, _, m in _blocks(b):
                _, mean, low = sent.value[dim]
                hi, lo = two_sum(values(m), -mean)
                part = outer(*two_sum(hi, lo - low))
                held[dim] = add(*held[dim], *part) if dim in held else part
        yield from _sums({(dim, k): (hi[k], lo[k]) for dim, (hi, lo) in held.items() for k in range(len(hi))})

    tasks = data.mapInArrow(local, SUMS).withColumn("part", F.col("part") % SPREAD)
    lines = tasks.repartition("dim", "line", "part").mapInArrow(_merge, SUMS).repartition("dim", "line").mapInArrow(_merge, SUMS)
    found: dict[int, list[np.ndarray]] = {}
    for r in lines.orderBy("dim", "line").collect():  # a row a dimension's line
        found.setdefault(r["dim"], []).append(np.frombuffer(r["hi"]) / means[r["dim"]][0] + np.frombuffer(r["lo"]) / means[r["dim"]][0])
    return {dim: np.stack(rows) for dim, rows in found.items()}


def components(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from above, unit eigenvectors as columns), ``most`` at most; eigenvalues lost in rounding are 0."""
    e, v = np.linalg.eigh((cov + cov.T) / 2)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return np.where(e > len(cov) * np.finfo(float).eps * max(e[0], 0), e, 0.0), v


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S)^2) a row of whole numbers, exact; None where it takes more than 63 bits."""
    top = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if top >> 63 == 0:
        u = x.astype(np.int64) * n - np.array(sums, np.int64)
        if int(np.abs(u).max(initial=0)) ** 2 * len(sums) >> 63 == 0:
            return (u * u).sum(axis=1).tolist()
    rows = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [r if r >> 63 == 0 else None for r in rows]


def whiten(data: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of ``data`` (vec_id,
    embedding) and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are those with entries of
    2^30 or more, whose sums would not be exact. Vectors of one dimension are fitted among themselves: n is their number.
    A component without variance (all rows equal, fewer rows than dimensions) has whitened and explained 0 and takes
    no part in identity_error. A deviation beyond 63 bits is null. Rows that repeat an id, or have none, stay; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = data.sparkSession
    e = F.col("embedding")
    fine = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < LIMIT)), F.lit(False))
    rows = data.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(fine)
    rows = rows.select(F.size("embedding").cast("long").alias("dim"), "embedding", "vec_id")
    means, models = {}, {}
    fits = totals(rows.select("dim", "embedding"))
    for dim, (n, sums) in fits.items():
        hi = [s / n for s in sums]
        means[dim] = n, np.array(hi), np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, hi, strict=True)])
    for dim, cov in covariance(rows.select("dim", "embedding"), quantise, means).items():
        models[dim] = (*components(cov, most), float(np.trace(cov)))
    sent = spark.sparkContext.broadcast((fits, means, models))  # ``most`` vectors of each dimension

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, means, models = sent.value
        for b in batches:
            for dim, at, m in _blocks(b):
                x, (e, v, _), (_, mean, low) = quantise(m), models[dim], means[dim]
                hi, lo = two_sum(x, -mean)
                w = (hi + (lo - low)) @ v * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)
                out = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * len(e), w.ravel())
                dims = pa.array(np.full(len(at), dim))
                yield pa.RecordBatch.from_arrays([dims, out, b.column(2).take(pa.array(at)), pa.array(deviations(x, *fits[dim]), pa.int64())], names=["dim", "w", "vec_id", "deviation"])

    found = common.materialise(rows.mapInArrow(project, "dim long, w array<double>, vec_id long, deviation long"), "whitening-rows")
    centre = found.groupBy("dim").agg(F.count("*").alias("n"), F.array(*(F.coalesce(F.avg(F.get("w", F.lit(k))), F.lit(0.0)) for k in range(most))).alias("m"))
    middle = {r["dim"]: (r["n"], np.array(r["m"][: len(models[r["dim"]][0])]), 0.0) for r in centre.collect()}  # a row a dimension
    facts = []
    for dim, cov in covariance(found.select("dim", "w"), lambda w: w, middle).items():
        e, _, trace = models[dim]
        gap = np.abs(cov - np.diag(e > 0))
        facts.append((dim, middle[dim][0], [float(x) / trace if trace > 0 else 0.0 for x in e], float(gap.max())))
    known = spark.createDataFrame(facts, "dim long, n long, e array<double>, identity_error double")
    each = found.join(known, "dim").select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "e")).alias("k", "x"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("x.w").alias("whitened"), F.col("x.e").alias("explained"), "identity_error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
