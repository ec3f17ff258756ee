"""Pages as a relation of DOM nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import parse
from ..functions.snapshot import INPUT_ROLES, ROLES

SCHEMA = (
    "page_id long, node_id int, parent_id int, ord int, elem_ord int, elem_total int, depth int, subtree_end int, kind string, tag string,"
    " attrs array<struct<name: string, value: string>>, text string, ref int"
)
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_KINDS = [pa.int64(), *[pa.int32()] * 7, pa.string(), pa.string(), _PAIRS, pa.string(), pa.int32()]
_NAMES = ["page_id", "node_id", "parent_id", "ord", "elem_ord", "elem_total", "depth", "subtree_end", "kind", "tag", "attrs", "text", "ref"]


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row a node of every page (page_id, html), in Arrow batches; null html is an empty document. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(page, *row) for row in parse(html.as_py() or "")]
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)]
    cols[10] = [[{"name": n, "value": v} for n, v in pairs] for pairs in cols[10]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def attr(name: str, attrs: Column | str = "attrs") -> Column:
    """The first attribute called ``name``, null where there is none."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def role(tag: Column, kind: Column) -> Column:
    """What an element is to a reader; ``kind`` is an input's type."""
    of_input, out = F.lit("textbox"), tag
    for k, v in INPUT_ROLES.items():
        of_input = F.when(kind == k, v).otherwise(of_input)
    for k, v in ROLES.items():
        out = F.when(tag == k, v).otherwise(out)
    return F.when(tag.rlike("^h[0-9]$"), "heading").when(tag == "input", of_input).otherwise(out)


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def text_content(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (page_id, node_id, subtree_end, more) with text: the text nodes below each, joined by spaces, in order.

    An interval join inside each page; pages are hashed over the partitions and their nodes stay together.
    """
    texts = nodes.where("kind = 'text'").select(F.col("page_id").alias("t_page"), F.col("node_id").alias("t_node"), F.col("text").alias("t_text"))
    inside = (F.col("t_page") == F.col("page_id")) & (F.col("t_node") > F.col("node_id")) & (F.col("t_node") < F.col("subtree_end"))
    keys = [c for c in targets.columns if c != "text"]
    joined = targets.select(*keys).join(texts, inside, "left").groupBy("page_id", "node_id")
    firsts = [F.first(c).alias(c) for c in keys if c not in ("page_id", "node_id")]
    ordered = F.array_sort(F.collect_list(F.when(F.col("t_node").isNotNull(), F.struct("t_node", "t_text"))))
    return joined.agg(*firsts, collapse_ws(F.array_join(F.transform(ordered, lambda x: x["t_text"]), " ")).alias("text"))


def navigate(nodes: DataFrame) -> DataFrame:
    """``nodes`` with what a script would reach from each: parent_tag, first_child, last_child, children (of any kind), first_element,
    last_element, previous, next (siblings of any kind), previous_element, next_element: ids, null where there is none.

    One shuffle by page; siblings are windows over it. Repeated pages must have ids of their own.
    """
    rows = nodes.repartition("page_id")
    here = Window.partitionBy("page_id", "parent_id").orderBy("ord")
    element = F.when(F.col("kind") == "element", F.col("node_id"))
    before, after = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)
    beside = rows.withColumn("previous", F.lag("node_id").over(here)).withColumn("next", F.lead("node_id").over(here))
    beside = beside.withColumn("previous_element", F.last(element, ignorenulls=True).over(before)).withColumn("next_element", F.first(element, ignorenulls=True).over(after))
    inside = rows.where("parent_id IS NOT NULL").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(
        F.min_by("node_id", "ord").alias("first_child"), F.max_by("node_id", "ord").alias("last_child"), F.count("*").alias("children"),
        F.min_by("node_id", F.when(F.col("kind") == "element", F.col("ord"))).alias("first_element"), F.max_by("node_id", F.when(F.col("kind") == "element", F.col("ord"))).alias("last_element"),
    )
    above = rows.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"))
    out = beside.join(inside, ["page_id", "node_id"], "left").join(above, ["page_id", "parent_id"], "left")
    more = ["parent_tag", "first_child", "last_child", F.coalesce("children", F.lit(0)).alias("children"), "first_element", "last_element", "previous", "next", "previous_element", "next_element"]
    return out.select(*nodes.columns, *more)
