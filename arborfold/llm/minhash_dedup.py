"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

Documents with equal shingle sets form a class, compared once. Bands of the signature give candidates: first each
class with one random member of its bucket; then, in some rounds, with the member that has most links so far, where the
two are still in different components; at last all that share a bucket and are still in different components. Candidates are judged on batches of the signature: a pair goes once the posterior probability that its
similarity reaches the threshold (uniform prior) falls under ``miss``. What survives is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .embedding_dedup import forest
from .shingles import mix, shingle_sets

ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
e AS (SELECT r, unnest(sh) AS x FROM s),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM p JOIN s a ON a.r = u JOIN s b ON b.r = v WHERE 100 * c >= 80 * (len(a.sh) + len(b.sh) - c)),
two AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach(u, v) AS (SELECT u, v FROM two UNION SELECT r.u, t.v FROM reach r JOIN two t ON r.v = t.u),
m AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN m ON m.u = doc_id
"""


class Scheme:
    """Signature parameters: ``bands`` bands of ``rows`` minima of linear permutations of 32-bit hashes."""

    def __init__(self, bands: int = 40, rows: int = 7, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.size = bands, rows, bands * rows
        self.mul = rng.integers(0, 1 << 31, self.size, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, self.size, dtype=np.uint32)[:, None]
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(low, (self.mul * x[at : at + 1024] + self.add).min(axis=1), out=low)
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        key = self.salt.copy()
        for column in minima.reshape(self.bands, self.rows).T:
            key = mix(key + column)
        return key.view(np.int64)


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest matches of ``compared`` with posterior P(similarity >= threshold) of at least ``miss``."""
    n, total = compared + 1, 0.0
    for m in range(compared + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(threshold) + (n - m) * math.log1p(-threshold))
        if total >= miss:
            return m
    return compared


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int = 40) -> np.ndarray:
    """Row numbers of the signature pairs that no batch has ruled out."""
    left, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], batch):
        same = same + (a[left, at : at + batch] == b[left, at : at + batch]).sum(axis=1)
        keep = same >= least_matches(min(at + batch, a.shape[1]), threshold, miss)
        left, same = left[keep], same[keep]
        if not len(left):
            break
    return left


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set."""
    total = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(mix(total.reshape(1) + np.uint64(len(shingles))).view(np.int64)[0])


def _longs(binary: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), kind)


def signatures(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set, null if empty), sig (16 bits a minimum), bands; a row a document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n, node, sig, bands = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), words):
                    n.append(len(s))
                    low = scheme.minima(s) if len(s) else None
                    node.append(class_of(s) if len(s) else None)
                    sig.append(None if low is None else low.astype("<u2").tobytes())
                    bands.append(None if low is None else scheme.band_keys(low))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "node", "sig", "bands"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, node long, sig binary, bands array<long>")


PAIRS = 1 << 12  # pairs, and signatures of classes, that one task compares; sets, half as many
FEW = 1 << 22  # ids that a set of bits may stand for; more are found by a join


def _bits(ids: DataFrame, n: int) -> np.ndarray:
    """A bit set over ``n`` hashed ids, sixteen bits each (8 MB at most): what it lacks is surely not in ``ids``."""
    size = 1 << max(10, (16 * n - 1).bit_length())
    words = ids.select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("bit")).selectExpr("bit DIV 64 AS at", "shiftleft(1L, CAST(bit % 64 AS INT)) AS bit")
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # size / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, shingles (binary) of the classes in ``needed`` (node, rep), from the text of each class's rep."""

    def sets_of(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), 1024):
            sets = list(shingle_sets(texts[at : at + 1024].to_pylist(), words))
            cols = [ids[at : at + 1024], pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "node", "shingles"])

    n = needed.count()
    if n <= FEW:
        sent = docs.sparkSession.sparkContext.broadcast(_bits(needed.select(F.col("rep").alias("id")), n))
        size = len(sent.value) * 8

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bit = b.column(2).to_numpy()
                rows = pa.array(np.flatnonzero((sent.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1))
                yield from sets_of(b.column(0).take(rows), b.column(1).take(rows))

        marked = docs.where("doc_id IS NOT NULL").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from sets_of(b.column(0), b.column(1))

        marked = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return marked.mapInArrow(run, "rep long, node long, shingles binary").join(needed, ["rep", "node"], "left_semi").select("node", "shingles")


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, threshold: float, miss: float, size: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold; more than once where rows repeat their id and text."""
    sigs = reps.select("node", "sig")
    both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_longs(b.column(k), "<u2").reshape(-1, size) for k in (2, 3))
            left = pa.array(survivors(x, y, threshold, miss))
            yield pa.RecordBatch.from_arrays([b.column(0).take(left), b.column(1).take(left)], names=["a", "b"])

    spark = docs.sparkSession
    n = reps.count()  # a task reads its share of all signatures, however few the pairs
    tasks = common.tasks_for(spark, max(n, pairs.count()), PAIRS)
    likely = common.materialise(both.select("a", "b", "sig_a", "sig_b").coalesce(tasks).mapInArrow(judge, "a long, b long"), "minhash-likely")
    tasks = max(common.tasks_for(spark, n), common.tasks_for(spark, likely.count(), PAIRS >> 1))
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    needed = common.materialise(reps.select("node", "rep").join(ends, "node", "left_semi"), "minhash-needed", tasks=tasks)
    sets = common.materialise(_sets(docs, needed, words), "minhash-sets")
    full = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    hundredths = round(100 * threshold)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= hundredths * (len(x) + len(y) - shared))
            keep = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    with common.batches_of(spark, 256):
        links = common.materialise(full.select("a", "b", "set_a", "set_b").coalesce(tasks).mapInArrow(exact, "a long, b long"), "minhash-links")
    for t in (likely, needed, sets):
        common.drop_table(t)
    return links


COLUMNS = 1024  # shingles whose incidence two blocks have in memory at once


def _places(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, place in ``known``) of each shingle of the sets that is there, by place."""
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
    own = np.flatnonzero(known[at] == every) if len(known) else np.empty(0, int)
    own = own[np.argsort(at[own], kind="stable")]
    return row[own], at[own]


def tile_links(ids_a, comp_a, sig_a, sets_a, ids_b, comp_b, sig_b, sets_b, threshold: float, miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links between two blocks of classes in different components connect.

    Signatures rule pairs out as in ``survivors``; the sizes of the intersections of all others come from one product
    of incidence matrices, column block by column block.
    """
    same = np.zeros((len(ids_a), len(ids_b)), np.int16)
    for k in range(sig_a.shape[1]):
        same += sig_a[:, k, None] == sig_b[None, :, k]
    open_ = (same >= least_matches(sig_a.shape[1], threshold, miss)) & (comp_a[:, None] != comp_b[None, :])
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return []
    x, y = [sets_a[r] for r in rows], [sets_b[c] for c in cols]
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    inside = [_places(sets, both) for sets in (x, y)]
    shared = np.zeros((len(rows), len(cols)), np.int32)
    for at in range(0, len(both), COLUMNS):
        part = []
        for (row, column), n in zip(inside, (len(x), len(y)), strict=True):
            i = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            m = np.zeros((n, min(COLUMNS, len(both) - at)), np.float32)
            m[row[i], column[i] - at] = 1
            part.append(m)
        shared += (part[0] @ part[1].T).astype(np.int32)
    size = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    linked = open_[np.ix_(rows, cols)] & (100 * shared >= round(100 * threshold) * (size - shared))
    first, last = forest(linked)
    r, c = np.flatnonzero(first >= 0), np.flatnonzero(last >= 0)
    return [(ids_a[rows[r]], ids_a[rows[first[r]]]), (ids_b[cols[c]], ids_a[rows[last[c]]])]


def _crossed(crowd: DataFrame, reps: DataFrame, docs: DataFrame, words: int, threshold: float, miss: float, block_bytes: int = 2 << 20) -> DataFrame:
    """Links between components that share large buckets, without a row a pair.

    Classes joined by large buckets form a group. Its classes are cut into blocks by bytes, those of its largest
    component apart from the others; every two blocks of a group that can hold different components meet in one task.
    """
    n = crowd.count()
    tasks = common.tasks_for(docs.sparkSession, n)
    hub = crowd.groupBy("key").agg(F.min("node").alias("hub"))
    hub = common.materialise(hub, "minhash-hubs", tasks=tasks)
    around = common.components(crowd.join(hub, "key").select(F.col("node").alias("u"), F.col("hub").alias("v")), "minhash-groups", rows=n).toDF("node", "g")
    members = common.materialise(crowd.select("node", "comp").distinct().join(around, "node"), "minhash-members", tasks=tasks)
    sizes = members.groupBy("g", "comp").agg(F.count("*").alias("n"))
    main = common.materialise(sizes.groupBy("g").agg(F.max_by("comp", F.struct("n", "comp")).alias("main")), "minhash-main", tasks=tasks)
    needed = common.materialise(reps.join(members, "node", "left_semi").select("node", "rep"), "minhash-needed", tasks=common.tasks_for(docs.sparkSession, max(n, reps.count())))
    held = max(common.tasks_for(docs.sparkSession, needed.count(), PAIRS >> 1), common.tasks_for(docs.sparkSession, reps.count(), PAIRS))
    sets = common.materialise(_sets(docs, needed, words), "minhash-sets")
    rows = members.join(main, "g").withColumn("side", (F.col("comp") == F.col("main")).cast("int")).join(reps.select("node", "sig"), "node").join(sets, "node")
    rows = common.materialise(rows.select("g", "side", "node", "comp", "sig", "shingles"), "minhash-rows", tasks=held)
    cut = F.greatest(F.lit(1), F.ceil(F.sum(F.length("shingles") + 600) / block_bytes)).cast("int")
    total = common.materialise(rows.groupBy("g", "side").agg(cut.alias("n")), "minhash-totals", tasks=tasks)
    other = total.select("g", (1 - F.col("side")).alias("side"), F.col("n").alias("n_other"))
    total = common.materialise(total.join(other, ["g", "side"], "left").select("g", "side", "n", F.coalesce("n_other", F.lit(0)).alias("n_other")), "minhash-cuts", tasks=tasks)
    rows = rows.join(total, ["g", "side"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    blocks = rows.groupBy("g", "side", "block", "n", "n_other").agg(F.collect_list(F.struct("node", "comp", "sig", "shingles")).alias("rows"))
    blocks = common.materialise(blocks, "minhash-blocks", tasks=held)
    # a tile is two blocks: both of side 0, or one of either side; each block goes to all its tiles
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.transform(upto("n"), lambda o: tile(0, F.least("block", o), F.greatest("block", o)))
    across = F.transform(upto("n_other"), lambda o: F.when(F.col("side") == 0, tile(1, F.col("block"), o)).otherwise(tile(1, o, F.col("block"))))
    dealt = blocks.select("g", "side", "block", "rows", F.explode(F.when(F.col("side") == 0, F.concat(own, across)).otherwise(across)).alias("t"))
    key = ["g", "kind", "i", "j"]
    dealt = dealt.select("g", "t.kind", "t.i", "t.j", "side", "block", "rows").repartition(*key).sortWithinPartitions(*key, "side", "block")

    def block_of(value: pa.ListScalar) -> list:
        node, comp, sig, sets = (value.values.field(i) for i in range(4))
        return [node.to_numpy(), comp.to_numpy(), np.stack([np.frombuffer(x.as_buffer(), "<u2") for x in sig]), [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for b in batches:
            for k in range(b.num_rows):
                now = tuple(b.column(c)[k].as_py() for c in range(4))
                second = block_of(b.column(6)[k])
                if now[1] == 0 and now[2] == now[3]:
                    first, at = second, now
                elif now != at:
                    first, at = second, now
                    continue
                for u, v in tile_links(*first, *second, threshold, miss):
                    i = np.flatnonzero(u != v)
                    yield pa.RecordBatch.from_arrays([pa.array(u[i]), pa.array(v[i])], names=["a", "b"])
                first = None

    with common.batches_of(docs.sparkSession, 2):
        out = common.materialise(dealt.mapInArrow(run, "a long, b long"), "minhash-crossed")
    for t in (hub, members, main, needed, sets, blocks):
        common.drop_table(t)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, miss: float = 1e-4, scheme: Scheme | None = None, rounds: int = 2, small: int = 32) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link where their sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` (in
    hundredths) or more; component_id is the smallest doc_id that links reach. Null, empty and wordless texts have
    no shingle and link with nothing. Equal rows and rows that repeat an id are documents of their own; a null
    doc_id stays alone (component_id null). Other columns are ignored; an empty table gives an empty result. A link
    at the threshold is missed as a candidate with probability (1 - threshold ** rows) ** bands (8e-5), or by the
    Bayesian test with probability about ``miss`` a batch; shingles count as equal where their 64-bit hashes are.
    """
    scheme = scheme or Scheme()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.materialise(signatures(docs, words, scheme), "minhash-signatures")
    n = signed.count()
    classes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node")
    classes = classes.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = common.materialise(classes, "minhash-classes", tasks=common.tasks_for(spark, n, PAIRS >> 1))
    members = reps.select(F.explode("bands").alias("key"), "node")
    lead = F.min(F.struct(F.xxhash64("node", "key").alias("by"), F.col("node"))).alias("lead")
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), lead).where("n > 1").select("key", F.col("lead.node").alias("lead"))
    n_members = scheme.bands * reps.count()
    buckets = common.materialise(buckets, "minhash-buckets", tasks=common.tasks_for(spark, n_members))
    shared = common.materialise(members.join(buckets, "key"), "minhash-shared", tasks=common.tasks_for(spark, n_members))
    tasks = common.tasks_for(spark, shared.count())  # for tables of a row a member of a bucket at most
    pair = [F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")]
    stars = common.materialise(shared.where("node <> lead").select(*pair).distinct(), "minhash-stars", tasks=tasks)
    links = _confirm(stars, reps, docs, words, threshold, miss, scheme.size)
    tested = stars
    comps = common.components(links.toDF("u", "v"), "minhash-components", rows=links.count())
    for turn in range(rounds + 1):
        # what shares a bucket and is still apart
        placed = shared.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        placed = common.materialise(placed, "minhash-placed", tasks=tasks)
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        mixed = common.materialise(mixed, "minhash-mixed", tasks=tasks)
        if not mixed.count():
            common.drop_table(placed)
            break
        mixed = common.materialise(placed.join(mixed, "key", "left_semi"), "minhash-apart", tasks=tasks)
        new = []
        if turn < rounds:  # against the member of the bucket with most links so far
            ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
            known = common.materialise(mixed.join(common.materialise(ends, "minhash-degrees", tasks=tasks), "node"), "minhash-known", tasks=tasks)
            best = F.max(F.struct("n", F.xxhash64("node", "key", F.lit(turn)).alias("by"), F.col("node").alias("node2"), F.col("comp").alias("comp2"))).alias("best")
            other = known.groupBy("key").agg(best).select("key", "best.node2", "best.comp2")
            other, apart = common.materialise(other, "minhash-leads", tasks=tasks), "comp <> comp2"
        else:  # all of a small bucket; large ones in tiles
            large = mixed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > small).select("key")
            large = common.materialise(large, "minhash-large", tasks=tasks)
            crowd = common.materialise(mixed.join(large, "key", "left_semi"), "minhash-crowd", tasks=tasks)
            if crowd.limit(1).count():
                new.append(_crossed(crowd, reps, docs, words, threshold, miss))
            mixed = common.materialise(mixed.join(large, "key", "left_anti"), "minhash-apart", tasks=tasks)
            other, apart = mixed.select("key", F.col("node").alias("node2"), F.col("comp").alias("comp2")), "comp < comp2"
        at_most = common.tasks_for(spark, mixed.count() * (1 if turn < rounds else small))
        rest = mixed.join(other, "key").where(apart).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        rest = common.materialise(rest.join(tested, ["a", "b"], "left_anti"), "minhash-rest", tasks=max(tasks, at_most))
        for t in (placed, mixed):
            common.drop_table(t)
        if rest.limit(1).count():
            new.append(_confirm(rest, reps, docs, words, threshold, miss, scheme.size))
            tested = tested.unionByName(rest)
        for found in new:
            links = links.unionByName(found)
        if any(found.limit(1).count() for found in new):  # what was joined before stays so: its stars stand for its links
            edges = comps.where("node <> component").toDF("u", "v")
            for found in new:
                edges = edges.unionByName(found.toDF("u", "v"))
            comps = common.components(edges, "minhash-components", rows=edges.count())

    rep_of = reps.select("node", "rep")
    first = comps.join(rep_of, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    found = rep_of.join(comps.join(first, "component").select("node", "component_id"), "node", "left")
    found = common.materialise(found.select("node", F.coalesce("component_id", "rep").alias("component_id")), "minhash-found", tasks=common.tasks_for(spark, n))
    for t in (shared, buckets):
        common.drop_table(t)
    out = signed.select("doc_id", "n_shingles", F.expr("CASE WHEN doc_id IS NOT NULL THEN node END").alias("node")).join(found, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on two-word shingles at similarity 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=2)
