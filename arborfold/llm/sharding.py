"""Shards along a Hilbert curve over metadata, by DataFrame functions alone.

Several metadata columns are quantised to a few bits each, rows are sorted by their place on the Hilbert curve, and
the order is cut into runs of equal row counts that leave groups of equal texts whole. Rows near each other in all dimensions share shards, so a filter on
any of them prunes files by their minima and maxima. ``write`` writes the shards as such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, hilbert

BITS = 5


def codes(df: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, code): the values' ranks in order, spread evenly over ``bits`` bits; null is a value, the first.

    There is a row a value; the ranks come from one window over the distinct values, with counts summed up before.
    """
    values = df.select(column).distinct()
    order = Window.orderBy(F.col(column).asc_nulls_first())
    ranked = values.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return ranked.select(column, F.expr(f"(r * {1 << bits}) DIV n").cast("int").alias(f"{column}_code"))


def size_code(size: Column, bits: int) -> Column:
    """A size's position between powers of two (two steps each), cut off at the top of ``bits`` bits."""
    steps = F.floor(F.log2(size.cast("double")) * 2).cast("int") - 8
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), steps))


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with rank, their place in an order of all of them, from 0. Ranges of the order are written out once, so ranks
    can't change when a task runs again; no task sees more than its range."""
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = common.materialise(ordered.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), name)
    counts = kept.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))  # a row a range
    return kept.join(counts, "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


TEXT = ["text_hash", "text_crc32", "size"]


def _grouped(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with place: their own, or that of the smallest doc_id with their text; and members: rows with that text."""
    lead = F.min_by("own", F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("lead")
    groups = rows.groupBy(*TEXT).agg(F.count("*").alias("n"), lead).where("n > 1")
    groups = common.materialise(groups.select(*(F.col(c).alias(f"g_{c}") for c in TEXT), "n", "lead"), "shard-groups")
    large = F.broadcast(groups.where(F.col("n") * 1000 >= total))  # a thousand rows at most
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in TEXT]
    rest = rows.join(large, same, "left_anti").join(groups.where(F.col("n") * 1000 < total), same, "left")
    return rows.join(large, same).unionByName(rest).select(*rows.columns, F.coalesce("lead", "own").alias("place"), F.coalesce("n", F.lit(1)).alias("members"))


def _places(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (rid, doc_id, size, text_crc32, text_hash, own) with shard and slot.

    All rows are ranked along the curve. A group of equal texts goes whole to the shard in which it starts, as long as
    the groups of that shard fit into it; the other rows, and those of groups that don't fit, fill what is left of the
    shards in the order of the curve. A shard's groups stand before its other rows.
    """
    total = rows.count()
    order = ["place", "text_crc32", "text_hash", "size", "doc_id", "rid"]
    ranked = common.materialise(_ranked(_grouped(rows, total), order, "shard-order"), "shard-ranks")
    bound = lambda s: F.expr(f"({s} * {total} + {shards - 1}) DIV {shards}")  # noqa: E731, the first rank of a shard
    starts = ranked.where("members > 1").groupBy(*TEXT, "members").agg(F.min("rank").alias("start"))
    starts = starts.withColumn("g_shard", F.expr(f"(start * {shards}) DIV greatest({total}, 1)"))
    at = F.monotonically_increasing_id()
    starts = starts.repartitionByRange("start").sortWithinPartitions("start").select("*", F.shiftright(at, 33).alias("part"))
    starts = common.materialise(starts, "shard-starts")
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = starts.groupBy("part").agg(F.sum("members").alias("n")).select("part", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("before"))  # a row a range
    earlier = Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summed = starts.join(parts, "part").withColumn("ahead", F.col("before") + F.coalesce(F.sum("members").over(earlier), F.lit(0)))
    first = Window.orderBy("g_shard").rowsBetween(Window.unboundedPreceding, -1)
    mine = starts.groupBy("g_shard").agg(F.sum("members").alias("n")).select("g_shard", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("g_before"))  # a row a shard
    summed = summed.join(mine, "g_shard").withColumn("offset", F.col("ahead") - F.col("g_before"))
    fits = summed.where(F.col("offset") + F.col("members") <= bound("(g_shard + 1)") - bound("g_shard"))
    fits = common.materialise(fits.select(*(F.col(c).alias(f"g_{c}") for c in TEXT), "members", "g_shard", "start", "offset"), "shard-whole")

    large = fits.where(F.col("members") * 1000 >= total)
    small = fits.where(F.col("members") * 1000 < total)
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in TEXT]
    grouped, single = ranked.where("members > 1").drop("members"), ranked.where("members = 1").drop("members")
    of_large = grouped.join(F.broadcast(large), same)  # a thousand rows at most
    others = grouped.join(F.broadcast(large), same, "left_anti").join(small, same, "left")
    whole = of_large.unionByName(others.where("start IS NOT NULL")).withColumn("slot", F.col("offset") + F.col("rank") - F.col("start"))
    whole = whole.select("rid", "doc_id", "size", "text_crc32", F.col("g_shard").alias("shard"), "slot")
    loose = single.unionByName(others.where("start IS NULL").select(*single.columns)).drop("rank")
    loose = _ranked(loose.select(*order), order, "shard-loose")
    held = fits.groupBy(F.col("g_shard").alias("s")).agg(F.sum("members").alias("held"))
    room = rows.sparkSession.range(shards).select(F.col("id").alias("s")).join(held, "s", "left")
    room = room.select("s", F.coalesce("held", F.lit(0)).alias("held"), (bound("(s + 1)") - bound("s") - F.coalesce("held", F.lit(0))).alias("room"))
    room = common.materialise(room.select("s", "held", "room", F.coalesce(F.sum("room").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from")), "shard-room")
    lists = room.where("room > 0").agg(F.array_sort(F.collect_list(F.struct("from", "s", "held"))).alias("free"))  # a row a shard
    lists = lists.select(F.col("free.from").alias("from"), F.col("free.s").alias("s"), F.col("free.held").alias("held"))
    loose = loose.join(F.broadcast(lists), F.lit(True))  # one row
    k = F.size(F.filter("from", lambda f: f <= F.col("rank"))) - 1
    loose = loose.withColumn("k", k).select("rid", "doc_id", "size", "text_crc32", F.get("s", "k").alias("shard"), (F.get("held", "k") + F.col("rank") - F.get("from", "k")).alias("slot"))
    return whole.unionByName(loose)


def _rows(docs: DataFrame, bits: int, dims: tuple[str, ...], rid: str | None = None) -> DataFrame:
    rows = docs.select(
        (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"dim_{c}") for c in dims),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string"))).alias("text_hash"),
    )
    base = docs.select(*(F.col(c).cast("string").alias(c) for c in dims))
    for c in dims:
        code = codes(base, c, bits).withColumnRenamed(c, f"{c}_value")
        rows = rows.join(F.broadcast(code) if _few(code) else code, F.col(f"dim_{c}").eqNullSafe(F.col(f"{c}_value")), "left")
    place = hilbert.index([*(F.coalesce(F.col(f"{c}_code"), F.lit(0)) for c in dims), size_code(F.col("size"), bits)], bits)
    return common.materialise(rows.select("rid", "doc_id", "size", "text_crc32", "text_hash", place.alias("own")), "shard-rows")


def shard(docs: DataFrame, shards: int = 40, bits: int = BITS, dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``rows``: counts of shards differ by one at most. Size is the text's UTF-8 bytes (null: none) plus 16;
    text_crc32 is 0, that of no bytes, for a null text. The curve runs over ``dims`` and the size. Equal texts are a
    group (null texts one, empty texts another), whatever their metadata: the group stands at the place of its
    smallest doc_id (null ids last), whole in one shard where the counts allow; a group that is larger than what its
    shard has left is spread along the curve. Null dimensions are values of their own; repeated rows take a slot each; other columns are
    ignored; an empty table gives an empty result. Groups with a thousandth of all rows or more, a thousand at most, are sent to all
    tasks; no key of the join of the others holds more rows than that.
    """
    placed = _places(_rows(docs, bits, dims), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _few(code: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of values is small enough to send to every task."""
    return code.limit(most + 1).count() <= most


def write(docs: DataFrame, path: str, shards: int = 40, bits: int = BITS, dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Write ``docs`` in folders by shard under ``path``, rows in the order of their slots; returns what is there.

    Rows are numbered and written once first, and matched with their shards by that number, so ids may repeat or be
    null. Columns called shard, slot or rid__ are replaced.
    """
    rows = common.materialise(docs.drop("shard", "slot", "rid__").withColumn("rid__", F.monotonically_increasing_id()), "shard-input")
    places = _places(_rows(rows, bits, dims, "rid__"), shards).select(F.col("rid").alias("rid__"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    rows = rows.join(places, "rid__").drop("rid__")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


#: DuckDB has no crc32; the tests hold shards and slots against plain Python.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the curve over source, language and size."""
    return shard(common.table(spark, sf_dir, "documents"))
