"""Toxicity by compression distance: windows of text compressed with a toxic and an ordinary zstandard dictionary.

zstandard trains one dictionary on the texts of each class, by the same call with the same parameters; no word or
window is chosen by hand, list or contrast. Most of a toxic text is ordinary prose, so chance matches of such prose
would drown what is toxic. Both dictionaries therefore stand behind one background, whole windows of other ordinary
texts, which takes up what both classes share: a window's lengths are those given the background and one class.
A window that comes out shorter with the toxic dictionary speaks for toxicity. Thresholds on the differences of a
document's windows are calibrated by logistic regression, each labelled text seen through dictionaries of others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORACLE_SQL = None

_WORDS = re.compile(r"[^\W_]+").findall
WINDOW, STEP = 12, 6
#: Bytes of the background (with the dictionary it must fit into the compressor's window of 2 MB); fewest and most bytes of a
#: class's dictionary, and for how many bytes of toxic text it has one; words of the samples zstandard is given.
BACKGROUND, DICTIONARY, PER_BYTE, SAMPLE = 1_600_000, (4_000, 24_000), 96, 2
LEAST = np.arange(1, 6)  # differences, in bytes, whose windows are counted; pairs of neighbours are counted from one more


@dataclass(frozen=True)
class Model:
    """Two dictionaries (each behind the background) and the weights of the window features."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=21, hash_log=20, chain_log=20, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Runs of ``size`` lower-cased words, every ``step`` words, to the text's end; a text without words has one empty run."""
    w = _WORDS((text or "").lower())
    return [(" " + " ".join(w[i : i + size]) + " ").encode() for i in range(0, max(1, len(w) - size + step), step)]


def _lengths(c: zstandard.ZstdCompressor, runs: list[bytes]) -> np.ndarray:
    out = []
    for at in range(0, len(runs), 8192):
        out += [len(x) for x in c.multi_compress_to_buffer(runs[at : at + 8192])]
    return np.array(out, np.int64)


def differences(runs: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Bytes that each window takes more with the ordinary dictionary than with the toxic one; equal windows are compressed once."""
    known = {w: k for k, w in enumerate(dict.fromkeys(runs))}
    own = list(known)
    d = _lengths(compressor(ordinary), own) - _lengths(compressor(toxic), own) if own else np.empty(0, np.int64)
    return d[[known[w] for w in runs]] if len(own) < len(runs) else d


def _tops(v: np.ndarray) -> list[float]:
    v = np.sort(v)[::-1]
    return [v[k] if k < len(v) else 0 for k in (0, 1, 2, 3, 5, 8)]


def _features(v: np.ndarray) -> list[float]:
    """Largest differences and counts of those from each of ``LEAST`` on, of windows and of neighbours together."""
    n = len(v)
    two = v[:-1] + v[1:] if n > 1 else v
    at = (v[:, None] >= LEAST).sum(axis=0)
    at2 = (two[:, None] >= LEAST + 1).sum(axis=0)
    up = np.maximum(v, 0).sum()
    return [*_tops(v), *np.log1p(at), *_tops(two), *np.log1p(at2), np.log(n), v.mean(), *(at / n**0.5), *(at / n), up / n**0.5, up / n, np.log(n) ** 2, np.log(n) * v.max(), 1]


def features(texts: list[str | None], toxic: bytes, ordinary: bytes) -> np.ndarray:
    held = [windows(t) for t in texts]
    d = differences([w for x in held for w in x], toxic, ordinary)
    cuts = np.cumsum([len(x) for x in held])
    return np.array([_features(v) for v in np.split(d, cuts[:-1])], np.float64) if held else np.empty((0, len(_features(np.zeros(1)))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, decay: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps on scaled features, given for features as they are; the last feature is the constant 1."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (y - p) - decay * w)
    w = w / scale
    w[-1] -= w[:-1] @ mean[:-1]
    return w


def train_dictionary(texts: list[str], size: int) -> bytes:
    """``size`` bytes that zstandard picks from the texts' windows; all the windows where there is too little to pick from."""
    runs = list(dict.fromkeys(w for t in texts for w in windows(t, SAMPLE, SAMPLE)))
    if sum(map(len, runs)) > 4 * size:
        return zstandard.train_dictionary(size + 2000, runs, k=12, d=6, level=3).as_bytes()[-size:]  # without zstandard's header
    return b"".join(runs)


def _dictionaries(toxic: list[str], ordinary: list[str], background: int) -> tuple[bytes, bytes]:
    """Dictionaries of either class, of the same size, which grows with the toxic text; every other ordinary text goes into the background, the
    rest into the ordinary dictionary."""
    runs, left = [], background
    for w in dict.fromkeys(w for t in ordinary[1::2] for w in windows(t, WINDOW, WINDOW)):
        if len(w) > left:
            break
        runs.append(w)
        left -= len(w)
    behind = b"".join(runs)
    size = min(DICTIONARY[1], max(DICTIONARY[0], sum(len(t.encode()) for t in toxic) // PER_BYTE))
    return behind + train_dictionary(toxic, size), behind + train_dictionary(ordinary[::2], size)


def train(toxic: list[str], ordinary: list[str], folds: int = 3, background: int = BACKGROUND) -> Model:
    """Fit dictionaries and calibration on labelled texts, given in an order that has nothing to do with their content.

    The calibration sees each text under dictionaries of the other folds; those of all texts are kept. Without two
    texts of either kind the model gives 0.
    """
    toxic, ordinary = (list(dict.fromkeys(t)) for t in (toxic, ordinary))
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", ())
    x, y = [], []
    for fold in range(folds):
        seen = _dictionaries(*([t for k, t in enumerate(texts) if k % folds != fold] for texts in (toxic, ordinary)), background)
        for label, texts in ((1.0, toxic[fold::folds]), (0.0, ordinary[fold::folds])):
            x.append(features(texts, *seen))
            y += [label] * len(texts)
    return Model(*_dictionaries(toxic, ordinary, background), tuple(_logistic(np.concatenate(x), np.array(y))))


def fit(docs: DataFrame, labels: DataFrame, each: int = 2000, most_bytes: int = 16 << 20, background: int = BACKGROUND) -> Model:
    """Train on at most ``each`` labelled toxic texts and three times as many ordinary ones, drawn by hash; of the ordinary texts
    ``background`` bytes stand before both dictionaries.

    ``labels`` (doc_id, toxic) holds training rows only. One executor task fits the model from a stream of the drawn
    texts; of either class it takes those that fit into ``most_bytes`` together, so its memory has a bound whatever
    the texts are. The driver gets the model alone (some 3 MB). Null labels, ids and texts are left out; an id labelled
    both ways counts as toxic; repeated texts count once; without labelled rows the model gives 0.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("by", F.xxhash64("doc_id"))
    drawn = [marks.where(F.col("toxic") == k).orderBy("by", "doc_id").limit(n) for k, n in ((1, each), (0, 3 * each))]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # 4 * each rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(drawn, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = ([], []), [most_bytes, most_bytes]
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                size = len(text.as_buffer())
                if size <= left[k]:
                    left[k] -= size
                    held[k].append(text.as_py())
        m = train(held[1], held[0], background=background)
        compressor.cache_clear()
        yield pa.RecordBatch.from_arrays([pa.array([m.toxic]), pa.array([m.ordinary]), pa.array([m.weights], pa.list_(pa.float64()))], names=["toxic", "ordinary", "weights"])

    rows = rows.select("toxic", "text", "by", "doc_id").repartition(1).sortWithinPartitions("by", "doc_id", "text").select(F.col("toxic").cast("int").alias("toxic"), "text")
    with common.batches_of(docs.sparkSession, 256):
        found = rows.mapInArrow(run, "toxic binary, ordinary binary, weights array<double>").collect()
    return Model(*(bytes(x) for x in found[0][:2]), tuple(found[0][2])) if found else Model(b"", b"", ())


def score(docs: DataFrame, model: Model, out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the double column ``out``, 0 (ordinary) to 1 (toxic), from the whole text alone.

    Null, empty and wordless texts get the score of an empty window; every row is kept, repeated ones too, with its
    columns (those in ``keep``; all, if that is None), whatever their names; a column already called ``out`` is
    replaced. An empty table gives an empty result.
    """
    df = docs.drop(out)
    kept = [c for c in df.columns if keep is None or c in keep]
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                p = np.zeros(part.num_rows)
                if m.weights:
                    p = 1 / (1 + np.exp(-np.clip(features(part.column(at).to_pylist(), m.toxic, m.ordinary) @ np.array(m.weights), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(df_at[c]) for c in kept), pa.array(p)], names=[*kept, out])

    df_at = {c: i for i, c in enumerate(df.columns)}
    fields = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    return df.mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labelled rows outside the held-out third."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = fit(docs, labels.where(~held))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
