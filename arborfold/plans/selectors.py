"""Selectors over the ``dom_nodes`` relation.

``select`` reads the relation once: its rows are dealt by page and sorted by node, one shuffle, and each page is
matched as it streams by, all combinators in one pass. Where pages are at hand rather than their nodes,
``operators.pages`` matches in the parsing pass and shuffles nothing. Relations between hits and other nodes are interval
joins inside a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import Row
from ..functions.page import match


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Element rows of ``nodes`` that match any group of ``selector``, each once; raises ``css.CssError``.

    ``nodes`` holds whole pages: a page's ids count from 0 without gaps. Null pages match nothing.
    """
    match([], selector)
    names = ["page_id", "node_id", "parent_id", "elem_ord", "elem_total", "kind", "tag", "attrs", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, rows, held, found = None, [], [], []

        def close() -> None:
            hits = match(rows, selector)
            found.extend(r for k in hits for r in held[k])

        for b in batches:
            for k, (p, n, parent, nth, total, kind, tag, attrs, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(9)), strict=True)):
                if p != page:
                    close()
                    page, rows, held = p, [], []
                if rows and rows[-1].node_id == n:  # a row that repeats
                    held[-1].append(b.slice(k, 1))
                    continue
                rows.append(Row(n, parent, 0, nth, total, 0, 0, kind, tag, [(a["name"], a["value"]) for a in attrs or ()], text, None))
                held.append([b.slice(k, 1)] if kind == "element" else [])
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                found.clear()
        close()
        if found:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    rest = [c for c in nodes.columns if c not in names]
    rows = nodes.where("page_id IS NOT NULL").repartition("page_id").sortWithinPartitions("page_id", "node_id").select(*names, *rest)
    return rows.mapInArrow(run, rows.schema).select(*nodes.columns)


def _inside(hits: DataFrame, roots: DataFrame) -> DataFrame:
    a = roots.select(F.col("page_id").alias("a_page"), F.col("node_id").alias("a_node"), F.col("subtree_end").alias("a_end"))
    inside = (F.col("page_id") == F.col("a_page")) & (F.col("node_id") > F.col("a_node")) & (F.col("node_id") < F.col("a_end"))
    return hits.join(a, inside, "left_semi")


def within(hits: DataFrame, roots: DataFrame) -> DataFrame:
    """Scoped query: hits that are strict descendants of a row of ``roots``."""
    return _inside(hits, roots)


def closest(nodes: DataFrame, targets: DataFrame, selector: str) -> DataFrame:
    """For each target the nearest of itself and its ancestors that matches: page_id, node_id, closest_id (null if none)."""
    a = select(nodes, selector).select(F.col("page_id").alias("a_page"), F.col("node_id").alias("a_node"), F.col("subtree_end").alias("a_end"))
    around = (F.col("page_id") == F.col("a_page")) & (F.col("node_id") >= F.col("a_node")) & (F.col("node_id") < F.col("a_end"))
    return targets.select("page_id", "node_id").join(a, around, "left").groupBy("page_id", "node_id").agg(F.max("a_node").alias("closest_id"))


def matched(nodes: DataFrame, targets: DataFrame, selector: str) -> DataFrame:
    """Rows of ``targets`` that match."""
    return targets.join(select(nodes, selector).select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")


def walk(nodes: DataFrame, mask: int = 0xFFFFFFFF, rejected: Column | None = None) -> DataFrame:
    """Nodes in document order as a tree walker shows them: kinds by bit, no subtree of a ``rejected`` element."""
    bits = {"element": 1, "text": 4, "comment": 128, "document": 256, "fragment": 1024}
    shown = [k for k, b in bits.items() if mask & b]
    out = nodes.where(F.col("kind").isin(shown) & (F.col("node_id") > 0))
    if rejected is not None:
        r = nodes.where(rejected).select(F.col("page_id").alias("a_page"), F.col("node_id").alias("a_node"), F.col("subtree_end").alias("a_end"))
        out = out.join(r, (F.col("page_id") == F.col("a_page")) & (F.col("node_id") >= F.col("a_node")) & (F.col("node_id") < F.col("a_end")), "left_anti")
    return out
