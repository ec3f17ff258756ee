"""Token ids in files of fixed-width packed integers.

A file holds the ids of consecutive documents. Each id takes the fewest bits that hold the largest id of the
vocabulary; blocks of ``BLOCK`` ids start at a byte, and their offsets are stored, so any span of ids is read by
seeking to its blocks and unpacking them with numpy.

Layout, little-endian: magic (8 bytes), then unsigned 64-bit bits, ids a block, documents, ids, blocks; a validity
byte a document; signed 64-bit doc_id a document (0 where null); unsigned 64-bit first id a document, and the total;
unsigned 64-bit byte offset a block from the file's start, and the end; the blocks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path

MAGIC = b"ARBTOK01"
BLOCK = 4096
ORACLE_SQL = None


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return flat.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class TokenFileWriter:
    """Collects documents and gives the bytes of one file."""

    def __init__(self, vocab_size: int):
        self.bits = bits_for(vocab_size)
        self.doc_ids, self.starts, self.total, self.parts = [], [0], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.parts.append(ids.astype("<u2") if self.bits <= 16 else ids)
        self.total += len(ids)
        self.starts.append(self.total)

    def to_bytes(self) -> bytes:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, "<u4")
        blocks = [pack(ids[i : i + BLOCK], self.bits) for i in range(0, self.total, BLOCK)]
        head = [MAGIC, np.array([self.bits, BLOCK, len(self.doc_ids), self.total, len(blocks)], "<u8").tobytes()]
        head += [bytes(d is not None for d in self.doc_ids), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()]
        head.append(np.array(self.starts, "<u8").tobytes())
        at = sum(map(len, head)) + 8 * (len(blocks) + 1)
        head.append(np.cumsum([at, *map(len, blocks)]).astype("<u8").tobytes())
        return b"".join(head + blocks)


class TokenFile:
    """Reads documents or spans of ids of one file; only the blocks asked for are read."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.file = self.fs.open_input_file(self.path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.block, n, self.total, blocks = map(int, np.frombuffer(self.file.read(40), "<u8"))
        valid = self.file.read(n)
        ids = np.frombuffer(self.file.read(8 * n), "<i8")
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, valid, strict=True)]
        self.starts = np.frombuffer(self.file.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        start, stop = max(0, start), min(stop, self.total)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        base = first * self.block
        return unpack(data, self.bits, min((last + 1) * self.block, self.total) - base)[start - base : stop - base]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of each document; neighbours are read together."""
        k = 0
        while k < len(self.doc_ids):
            stop = k + 1
            while stop < len(self.doc_ids) and self.starts[stop + 1] - self.starts[k] <= ids_at_once:
                stop += 1
            ids = self.ids(int(self.starts[k]), int(self.starts[stop]))
            for j in range(k, stop):
                a, b = self.starts[j] - self.starts[k], self.starts[j + 1] - self.starts[k]
                yield self.doc_ids[j], int(self.starts[j]), ids[a:b]
            k = stop

    def close(self) -> None:
        self.file.close()


def _save(path: str, data: bytes) -> None:
    """The file appears whole or not at all; a task that runs again replaces it by equal bytes."""
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    task = TaskContext.get()
    part = f"{at}.{task.taskAttemptId() if task else 0}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, at)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, ids_a_file: int = 4_000_000
) -> DataFrame:
    """Encode every text and write files in ascending order of ``id_col``; returns the manifest, one row a file.

    Rows are dealt by ranges of (id, text hash), so a repeated id can't fill one task, and sorted there; each task
    closes a file at ``ids_a_file`` ids. Null text counts as empty; null ids come first; rows that repeat an id
    follow one another by text hash; an empty table gives no file. Other columns are ignored.
    """
    end = np.array([] if end_id is None else [end_id], "<u4")
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        out, made = TokenFileWriter(enc.vocab_size), []

        def close() -> None:
            nonlocal out
            if out.doc_ids:
                at = f"{path}/part-{part:06d}-{len(made):05d}.tok"
                _save(at, out.to_bytes())
                made.append((part, len(made), at, len(out.doc_ids), out.total))
            out = TokenFileWriter(enc.vocab_size)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                out.add(doc_id, np.concatenate([ids, end]))
                if out.total >= ids_a_file:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["part", "seq", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    manifest = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long")
    manifest = common.materialise(manifest, "token-manifest")
    spark.sparkContext._jvm.System.gc()  # lets go of the shuffle of the texts
    return manifest


def read_token_files(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), ids (unsigned 32-bit, little-endian).

    With ``digest``, each document's ids are summed up where they are read: n_tokens and ids_crc32 in place of ids.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    names = ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]
    kinds = [pa.int64(), pa.int64(), *([pa.int64()] * 2 if digest else [pa.binary()])]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(path)
                rows, size = [], 0
                for doc_id, start, ids in file.documents():
                    data = ids.astype("<u4").tobytes()
                    rows.append((doc_id, base + start, *((len(ids), zlib.crc32(data)) if digest else (data,))))
                    size += len(ids)
                    if size >= 1 << 21:
                        yield batch_of(rows)
                        rows, size = [], 0
                file.close()
                if rows:
                    yield batch_of(rows)

    n = max(1, min(manifest.count(), 10_000))
    fields = "n_tokens long, ids_crc32 long" if digest else "ids binary"
    return files.repartition(n, "path").mapInArrow(read, f"doc_id long, start long, {fields}")


def with_crc(df: DataFrame, ids: str, out: str = "ids_crc32") -> DataFrame:
    """Replace the binary column ``ids`` by its length in ids and its unsigned crc32."""
    keep = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(b.schema.get_field_index(ids))
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in data], pa.int64())
            size = pa.array([len(x.as_buffer()) // 4 for x in data], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), size, crc], names=[*keep, "n_ids", out])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != ids)
    return df.mapInArrow(run, f"{fields}, n_ids long, {out} long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, from the files that hold the ids of the whole table."""
    path = common.new_path(spark, "token-files")
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_files(manifest, digest=True)
