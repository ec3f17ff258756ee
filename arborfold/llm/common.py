"""Shared helpers: the folder all executors see, tables that cut lineage, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own if driver and executors share a machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arborfold/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and outlives any executor. With ``by``, rows are
    kept in folders by that column, so a filter on it reads no others. With ``tasks``, so many at most write it: a table
    of few rows costs what its rows do, not a file a shuffle partition."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = (df.coalesce(tasks) if tasks else df).write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int, each: int = 1 << 18) -> int:
    """Tasks that write ``rows`` rows, ``each`` a task; two for every core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that nothing refers to any more: it does once its driver collects garbage,
    and Python's references go first."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)  # files are removed behind the scenes


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = f"{shared_dir(spark)}/arborfold/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        tail = folder.split("/arborfold/")[-1]
        path = jvm.org.apache.hadoop.fs.Path(base + tail.split("/")[0])
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs run inside hand Python at most ``rows`` rows at once: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges`` (u, v) as rows (node, component); component is the smallest node.

    Alternates large-star and small-star steps until the edges are stars. Each step's minima and edges are
    written to the shared folder, so both join sides are plain shuffles that adaptive execution can split at a
    hub, and a lost executor costs no more than one step. Self-loops and null ends are ignored. ``rows``: how many edges
    there are at most, if known.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = materialise(e, f"{name}-edges", tasks=None if rows is None else tasks_for(spark, rows))
    tasks = tasks_for(spark, 2 * e.count())

    def minima(pairs: DataFrame, tag: str) -> DataFrame:
        return materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{tag}", tasks=tasks)

    def stars(e: DataFrame) -> bool:
        """Whether each lower end has one upper end, which is nobody's lower end."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high"))
        ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        odd = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low + high > 1")
        return not odd.coalesce(tasks).limit(1).count()

    for _ in range(max_rounds):
        if stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = minima(both, "large")
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()
        large = materialise(large, f"{name}-edges", tasks=tasks)
        drop_table(m)
        m = minima(large, "small")
        joined = large.join(m, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        small = materialise(small.where("u > v").distinct(), f"{name}-edges", tasks=tasks)
        for old in (e, large, m):
            drop_table(old)
        e = small
    else:
        if not stars(e):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
