"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.sources.shared import cut

__all__ = ["cut", "documents", "groups_of", "id_text", "join_skewed", "packed", "partitions", "rows_of", "single_threaded", "sized_groups", "tidy", "unpacked"]

#: Python's form of the ASCII white space class [\x20\x09-\x0D].
WS_BYTES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of each Arrow batch of :func:`id_text`."""
    for b in batches:
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


def sized_groups(ids: list, texts: list, limit: int) -> Iterator[tuple[list, list]]:
    """Consecutive rows in groups of about ``limit`` characters, to bound memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= limit:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(ids):
        yield ids[at:], texts[at:]


def single_threaded() -> None:
    """Native libraries stay on the one core that the task owns."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle should have: what the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_skewed(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``groups``, one row a key, whose column ``size`` tells how many rows a key has.

    Keys of more than one in ``share`` rows are fewer than ``share``, so they are
    broadcast; the others are shuffled, and no task gets a large group.
    """
    keys = [on] if isinstance(on, str) else on
    hot = groups.where(F.col(size) * share > total)
    cold = groups.where(F.col(size) * share <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a reused worker gives the memory it no longer needs back to the machine."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length by byte planes, compressed. A sorted first column of 8 bytes is stored as differences."""
    import zstandard

    parts = []
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c)
        if k == 0 and len(c):
            c = np.r_[c[:1], np.diff(c)]
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts)) if len(columns[0]) else b""


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    if not blob:
        return [np.zeros(0, t) for t in types]
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(data) // sum(sizes), 0, []
    for k, (t, size) in enumerate(zip(types, sizes, strict=True)):
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        c = np.ascontiguousarray(planes.T).view(t).reshape(n)
        out.append(np.cumsum(c, dtype=c.dtype) if k == 0 else c)
        at += n * size
    return out


def groups_of(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition sorted by its key column, a key at a time."""
    name, rows = None, []
    for b in batches:
        for i in range(b.num_rows):  # a row at a time: the blobs of a batch are not copied at once
            row = tuple(c[i].as_py() for c in b.columns)
            if rows and row[key] != name:
                yield name, rows
                rows = []
            name = row[key]
            rows.append(row)
    if rows:
        yield name, rows
