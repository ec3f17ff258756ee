"""Divergence of sources from each other and from their language, by two-dimensional tiles of groups.

Terms are counted by group (language, source). Those a language keeps are dealt into chunks by their hash, and a
group's counts in a chunk are packed into one row. Groups stand in blocks; a tile is a pair of blocks. Each packed
row goes to the tiles of its block, where a task takes one chunk after the other, spreads the counts of the tile's groups
out over the chunk's terms and adds up every pair of groups at once. Spans of chunks are tasks of their own, whose
sums are added up last, so neither a large vocabulary nor a large language makes one large task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a term are letters or above 127; the table puts A-Z in lower case and a space for what ends terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
ONE = 1_000_000_000
LEAST_DOCS, TERMS = 10, 10
CHUNK, SPAN, BLOCK = 4096, 8, 32  # terms of a chunk on average, chunks of a span, groups of a block
HELD = 400_000  # counters a task holds before it hands them on
PIECE = 1 << 22  # bytes of a text that are split at once


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes at once."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents that hold it, and a row with a null
    term for each group. Null columns are ''. Tasks add up what fits into ``HELD`` counters before the shuffle."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [None, *n]
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    cols = [pa.array([x] * len(some), pa.string()) for x in (lang, source)] + [pa.array(some, pa.binary()).cast(pa.string())]
                    cols += [pa.array([c[t] for t in some], pa.int64()) for c in (n, docs)]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for terms in _pieces(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n)
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray | int, rows: int) -> np.ndarray:
    """1 + floor(ONE * n / rows) for n <= rows, three digits at a time, so nothing leaves 64 bits (rows below 2^53)."""
    whole, rest = np.divmod(np.asarray(n, np.int64), rows)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, rows)
        whole = whole * 1000 + digit
    return whole + 1


def _share(n: Column, rows: Column) -> Column:
    """The same as a column."""
    return F.call_function("div", (n.cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")), rows.cast("decimal(20,0)")).cast("long") + 1


TILE = "lang string, low int, high int, span int, chunk int, block int, source string, terms long, rows long, pos array<int>, n array<long>"
PAIRS = "lang string, source string, item string, value long"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a span for every pair of groups of a tile, from rows that come tile by tile, span by span, chunk by chunk."""
    key, chunk, sums, sides = None, None, {}, ([], [])

    def spread() -> None:
        """Add the chunk at hand to the sums; rows of the tile's two blocks stand in ``sides``."""
        lang, low, high = key[:3]
        low_side, high_side = sides if low != high else (sides[0], sides[0])
        names = [name for name, _ in high_side]
        p = np.stack([x for _, x in high_side]) if high_side else None
        for k, (name, own) in enumerate(low_side):
            first = k + 1 if low == high else 0  # within a block each pair once
            if first < len(names):
                gap = p[first:] - own
                for other, value in zip(names[first:], (gap * gap // (p[first:] + own)).sum(axis=1).tolist(), strict=True):
                    sums[name, other] = sums.get((name, other), 0) + value
        sides[0].clear(), sides[1].clear()

    def out() -> pa.RecordBatch:
        cols = [[key[0]] * len(sums), [a for a, _ in sums], [b for _, b in sums], list(sums.values())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])
        sums.clear()
        return batch

    for b in batches:
        pos, n = b.column(9), b.column(10)
        for i, (lang, low, high, span, at, block, source, terms, rows) in enumerate(zip(*(b.column(c).to_pylist() for c in range(9)), strict=True)):
            if key is not None and (key, chunk) != ((lang, low, high, span), at):
                spread()
                if key != (lang, low, high, span):
                    yield out()
            key, chunk = (lang, low, high, span), at
            p = np.full(terms, share(2, rows) if terms else 0, np.int64)
            if pos[i].is_valid:
                p[pos[i].values.to_numpy()] = share(n[i].values.to_numpy() + 2, rows)
            sides[block != low].append((source, p))
    if key is not None:
        spread()
        yield out()


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = TERMS, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) of ``docs`` stands from each other source
    of its language (part ``pair``), and its ``most`` terms that stand out most from the language (part ``term``).

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a language keeps those in at least ``least`` of its
    documents. Null text, lang and source are ''. Groups without terms have pairs too; a language that keeps no
    term has pairs of value 0. Repeated rows count as often as they stand; other columns are ignored; an empty table gives
    an empty result. Ties go to the smaller item.
    """
    counts = common.materialise(count_terms(docs), "divergence-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = common.materialise(kept.select("lang", "term", "lang_n"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    langs = common.materialise(langs, "divergence-langs")
    dealt = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    one = Window.partitionBy("lang", "chunk")
    terms = common.materialise(dealt.withColumn("pos", F.row_number().over(one.orderBy("term")) - 1).select("lang", "term", "lang_n", "chunk", "pos"), "divergence-places")
    cells = common.materialise(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "chunk", "pos"), "divergence-cells")
    total = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(total, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")), F.coalesce("chunks", F.lit(1)).alias("chunks"))
    block = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / BLOCK).cast("int")
    groups = common.materialise(groups.withColumn("block", block), "divergence-groups")
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))

    packed = cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "n")).alias("p"))  # a chunk's terms
    packed = packed.select("lang", "source", "chunk", F.col("p.pos").alias("pos"), F.col("p.n").alias("n"))
    sizes = terms.groupBy("lang", "chunk").agg(F.count("*").alias("terms"))
    frame = groups.join(blocks, "lang").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    frame = frame.join(sizes, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    frame = frame.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))  # to every tile of its block
    frame = frame.select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "block", "source",
        F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), (F.col("total") + 2 * F.col("kept")).alias("rows"), "pos", "n",
    )
    tile = ["lang", "low", "high", "span"]
    pairs = frame.repartition(*tile).sortWithinPartitions(*tile, "chunk", "block", "source").mapInArrow(_tiles, PAIRS)
    pairs = common.materialise(pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "divergence-pairs")
    for t in (counts, kept, langs, terms):
        common.drop_table(t)
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    stand = cells.join(groups.drop("chunks", "block"), ["lang", "source"])
    p, q = _share(F.col("n") + 2, F.col("total") + 2 * F.col("kept")), _share(F.col("lang_n") + 2, F.col("lang_total") + 2 * F.col("kept"))
    stand = stand.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    stand = stand.select("lang", "source", "item", F.expr("((p - q) * (p - q)) DIV (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(stand, "term").where(F.col("rank") <= most))


_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({rows} + 2 * kept)"
ORACLE_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x USING (lang, source) LEFT JOIN l USING (lang)),
e AS (SELECT g.*, k.term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", rows="total")} AS p, {_SHARE.format(n="lang_n", rows="lang_total")} AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM e WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TERMS}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all groups of the documents."""
    return audit(common.table(spark, sf_dir, "documents"))
