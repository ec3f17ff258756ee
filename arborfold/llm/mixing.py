"""Mixing by iterative proportional fitting, by DataFrame functions alone.

Tokens are counted by cell (source, language, topic), the cells' weights are raked in turn to the target marginals
of each dimension, and documents are sampled with probabilities in proportion to weight over tokens, raised evenly
until the expected tokens meet the budget and held at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIMS = ("source", "lang", "topic")
#: A dimension's target shares are its token shares to this power, scaled to 1.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
SWEEPS, BUDGET, SEED = 20, 0.8, 7


def tokens_of(text: Column) -> Column:
    """Four UTF-8 bytes count as a token, a rest as one; null text has none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse kind of text by its length and its share of symbols."""
    size = F.length(text)
    symbols = size - F.length(F.translate(text, "#$%&*|", ""))
    return F.when(text.isNull() | (size == 0), "none").when(symbols * 20 > size, "symbols").when(size < 400, "short").when(size >= 6000, "long").otherwise("prose")


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER, sweeps: int = SWEEPS, few: int = 100_000, targets: dict[str, dict] | None = None) -> DataFrame:
    """Add w, the raked weights, to ``cells`` (the dimensions of ``temper``, tokens); marginals go to the tempered targets.

    ``targets`` gives shares by value for some dimensions in their place: scaled to 1 over the values that have tokens,
    0 for values not named.

    Each sweep scales the weights to every dimension's targets in turn, by sums over windows. Up to ``few`` cells (the
    count is checked) stand in one partition, where windows need no shuffle; more are shuffled by each dimension.
    Weights are written out every five sweeps. Nulls are values of their own; cells without tokens get weight 0.
    """
    cells = common.materialise(cells, "mixing-cells")
    one = cells.count() <= few
    if one:
        cells = cells.coalesce(1)
    total = F.sum("tokens").over(Window.partitionBy())
    df = cells.withColumn("w", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total), F.lit(0.0)))
    for d, power in temper.items():
        share = F.pow(F.sum("w").over(Window.partitionBy(d)), F.lit(power))
        if targets and d in targets:
            asked = F.lit(0.0)
            for value, x in targets[d].items():
                asked = F.when(F.col(d).eqNullSafe(F.lit(value)), F.lit(float(x))).otherwise(asked)
            share = F.when(F.sum("w").over(Window.partitionBy(d)) > 0, asked).otherwise(0.0)
        first = F.row_number().over(Window.partitionBy(d).orderBy(*temper)) == 1
        df = df.withColumn(f"{d}_s", share).withColumn(f"{d}_f", F.when(first, F.col(f"{d}_s")).otherwise(0.0))
        df = df.withColumn(f"{d}_t", F.coalesce(F.try_divide(F.col(f"{d}_s"), F.sum(f"{d}_f").over(Window.partitionBy())), F.lit(0.0))).drop(f"{d}_s", f"{d}_f")
    for at in range(0, sweeps, 5):
        for _ in range(min(5, sweeps - at)):
            for d in temper:
                now = F.sum("w").over(Window.partitionBy(d))
                df = df.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"{d}_t"), now), F.lit(0.0)))
        df = common.materialise(df, "mixing-raked")
        df = df.coalesce(1) if one else df
    return df


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Add p = min(1, c * w / tokens), with c such that the expected tokens are ``budget`` of all.

    Sorted by w / tokens from above, the first cells are kept whole as long as c would lift the next beyond 1.
    """
    down = Window.orderBy(F.desc("r"), *DIMS)
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    df = raked.withColumn("r", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    goal = budget * F.sum("tokens").over(Window.partitionBy()) - F.coalesce(F.sum("tokens").over(above), F.lit(0))
    df = df.withColumn("c", F.try_divide(goal, F.sum("w").over(rest)))
    c = F.max(F.when((F.col("r") > 0) & (F.col("c") * F.col("r") <= 1), F.col("c"))).over(Window.partitionBy())
    return df.withColumn("p", F.least(F.lit(1.0), F.coalesce(c * F.col("r"), F.lit(1.0)))).drop("r", "c")


def copies(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Add p = budget * all tokens * w / tokens, the expected copies of a document: above 1 where a target needs more
    than a cell has, so the marginals of expected tokens are the raked ones. 1 in cells without tokens."""
    goal = budget * F.sum("tokens").over(Window.partitionBy())
    return raked.withColumn("p", F.when(F.col("tokens") > 0, goal * F.col("w") / F.col("tokens")).otherwise(1.0))


def marginals(cells: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """dimension, value, share of all tokens, target and expected share of the sample, for cells of ``probabilities`` or ``copies``."""
    out = None
    for d in dims:
        one = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.sum("tokens").alias("n"), F.max(f"{d}_t").alias("target"), F.sum(F.col("tokens") * F.col("p")).alias("got"))
        out = one if out is None else out.unionByName(one)
    total = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(Window.partitionBy("dimension")))
    return out.select("dimension", "value", total("n").alias("share"), "target", total("got").alias("achieved"))


def cells_of(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """Tokens by source, language and topic (a column, or else ``topic_of`` the text)."""
    cell = ["source", "lang", (F.col(topic) if topic else topic_of(F.col("text"))).alias("topic")]
    return docs.groupBy(*cell).agg(F.sum(tokens_of(F.col("text"))).alias("tokens"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] = TEMPER, seed: int = SEED, repeat: bool = False, topic: str | None = None, targets: dict[str, dict] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, lang, more) with mix_tokens, mix_probability and mix_kept, every row kept.

    Probabilities held at 1 miss the targets where a cell has too few tokens. With ``repeat`` mix_probability is the
    expected number of copies instead and mix_copies the number drawn, so the expected marginals are the raked ones.
    ``topic`` names a column of topics, without which ``topic_of`` the text stands in; ``targets`` as in ``rake``.

    Null sources, languages and texts are values of their own; documents without tokens keep their cell's
    probability, or 1 in a cell without any. Rows that repeat an id are drawn alike. Columns already called
    ``mix_...`` are replaced. An empty table gives an empty result.
    """
    df = docs.drop("mix_tokens", "mix_topic", "mix_probability", "mix_kept", "mix_copies")
    df = df.withColumn("mix_tokens", tokens_of(F.col("text"))).withColumn("mix_topic", F.col(topic) if topic else topic_of(F.col("text")))
    cells = df.groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens"))
    p = (copies if repeat else probabilities)(rake(cells, temper, targets=targets), budget).select(F.struct(*DIMS).alias("mix_cell__"), F.col("p").alias("mix_probability"))
    p = common.materialise(p, "mixing-probabilities")
    if p.limit(100_001).count() <= 100_000:
        p = F.broadcast(p)
    cell = F.struct("source", "lang", F.col("mix_topic").alias("topic"))
    df = df.join(p, cell.eqNullSafe(F.col("mix_cell__")), "left").drop("mix_cell__")
    df = df.drop("mix_topic")
    if not repeat:
        return df.withColumn("mix_kept", draw(F.col("doc_id"), seed) < F.col("mix_probability"))
    whole = F.floor("mix_probability")
    df = df.withColumn("mix_copies", (whole + (draw(F.col("doc_id"), seed) < F.col("mix_probability") - whole).cast("int")).cast("int"))
    return df.withColumn("mix_kept", F.col("mix_copies") > 0)


def _oracle() -> str:
    targets = ", ".join(f"pow(sum(w) OVER (PARTITION BY {d}), {TEMPER[d]}) AS {d}_s, row_number() OVER (PARTITION BY {d}) = 1 AS {d}_f" for d in DIMS)
    scaled = ", ".join(f"{d}_s / sum(CASE WHEN {d}_f THEN {d}_s ELSE 0 END) OVER () AS {d}_t" for d in DIMS)
    step = "SELECT * FROM it"
    for d in DIMS:
        step = f"SELECT k, source, lang, topic, tokens, source_t, lang_t, topic_t, CASE WHEN w > 0 THEN w * {d}_t / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM ({step})"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, coalesce(ceil(strlen(text) / 4), 0)::BIGINT AS n_tokens,
    CASE WHEN text IS NULL OR length(text) = 0 THEN 'none' WHEN (length(text) - length(translate(text, '#$%&*|', ''))) * 20 > length(text) THEN 'symbols'
      WHEN length(text) < 400 THEN 'short' WHEN length(text) >= 6000 THEN 'long' ELSE 'prose' END AS topic FROM documents
), c0 AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
c1 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM c0),
c2 AS (SELECT *, {targets} FROM c1), c3 AS (SELECT *, {scaled} FROM c2),
it(k, source, lang, topic, tokens, source_t, lang_t, topic_t, w) AS (
  SELECT 0, source, lang, topic, tokens, source_t, lang_t, topic_t, w::DOUBLE FROM c3
  UNION ALL SELECT k + 1, source, lang, topic, tokens, source_t, lang_t, topic_t, w FROM ({step}) WHERE k < {SWEEPS}
),
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN {BUDGET} * sum(tokens) OVER () * w / tokens ELSE 1.0 END AS p FROM it WHERE k = {SWEEPS})
SELECT doc_id, n_tokens, round(p, 6) AS expected_copies, (floor(p) + (('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 12))::BIGINT / {float(1 << 48)} < p - floor(p))::INTEGER)::INTEGER AS copies
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
"""


ORACLE_SQL = _oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and drawn copies of all documents: with repeats, so the expected marginals are the raked ones."""
    mixed = mix(common.table(spark, sf_dir, "documents"), repeat=True)
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("expected_copies"), F.col("mix_copies").alias("copies"))
