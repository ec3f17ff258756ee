"""Toxicity filter, near-dedup, mixing and packing over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.llm import common, minhash_dedup, mixing, packing, toxicity
from arborfold.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; learnt from all labelled rows. Null and empty texts and rows without an id are
    scored and stay; repeated rows are scored alike; an empty table stays empty. A column called toxicity__ is replaced and lost."""
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, out="toxicity__").where("toxicity__ < 0.7").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that near-duplicate links (five-word shingles, 0.8) join, the one with the smallest id, null ids last; rows
    with a repeated or null id are decided one by one, by a row key written once. Null, empty and wordless texts stay; an empty
    table stays empty. A column called row__ would hold that key instead of its own values."""
    keyed = common.materialise(docs.withColumn("row__", F.monotonically_increasing_id()), "pipeline-rows")
    found = minhash_dedup.near_duplicates(keyed.select(F.col("row__").alias("doc_id"), "text"), words=5, threshold=0.8)
    groups = found.select(F.col("doc_id").alias("row__"), "component_id").join(keyed.select("row__", "doc_id"), "row__")
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row__")).alias("best"))
    kept = common.materialise(best.select("best.row__"), "pipeline-kept")
    return keyed.join(kept, "row__", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample calibrated to the target marginals, 0.8 of the tokens; documents repeat where a target needs more than there are.
    Null sources and languages are values of their own, documents without tokens stay once; an empty table stays empty. Columns called
    mix_... would be replaced."""
    mixed = mixing.mix(docs, repeat=True).where("mix_kept")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), "mix_copies")).alias("mix_copy__")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences of 2048 tokens. Null texts are empty: their end id alone is packed; rows
    with repeated or null ids are packed one by one; an empty table gives an empty result."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("mixing", mix), ("packing", pack)]
#: SQL expresses neither the compression distances nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
