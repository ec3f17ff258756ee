"""Metrics of a run, observed in the pass that makes its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.bytes import est_tokens


def snapshot_metrics(snapshots: DataFrame) -> tuple[DataFrame, Observation]:
    """``snapshots`` (html_bytes, snapshot, more) and what is observed once it is run, without a pass of its own: pages,
    bytes_in, bytes_out, tokens_in, tokens_out (four bytes each, by page), empty (pages without text). Null snapshots have no bytes."""
    seen = Observation("snapshots")
    text = F.coalesce("snapshot", F.lit(""))
    size = F.octet_length(text).cast("long")
    counts = [
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("html_bytes").cast("long")).alias("bytes_in"), F.sum(size).alias("bytes_out"),
        F.sum(F.floor(F.col("html_bytes") / 4)).alias("tokens_in"), F.sum(est_tokens(text)).alias("tokens_out"), F.count(F.when(F.col("snapshot").isNull() | (size == 0), 1)).alias("empty"),
    ]
    return snapshots.observe(seen, *counts), seen


def line(metrics: dict) -> str:
    """Observed metrics as one line."""
    return " ".join(f"{k}={0 if v is None else v}" for k, v in metrics.items())
