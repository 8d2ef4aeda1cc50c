"""Zip archives as a Spark source: partitions are ranges of the central directory, so entries are unpacked where tasks run.

``spark.read.format("zip_entries")`` gives (archive, name, bytes, content) of all
archives of a path. Only listings are read for the plan; they are judged as
``archive.plan`` judges them before any entry is opened.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from speechmill.sources import store
from speechmill.sources.archive import MOST_BYTES, MOST_FILES, plan

SCHEMA = "archive string, name string, bytes long, content binary"
#: So many bytes of entries, as they are packed, make a partition; so many unpacked ones an Arrow batch, or one entry.
RANGE, BATCH = 64 << 20, 16 << 20


class Entries(InputPartition):
    """Places ``first`` to ``last`` of an archive's listing, the last excluded."""

    def __init__(self, archive: str, first: int, last: int) -> None:
        super().__init__((archive, first, last))
        self.archive, self.first, self.last = archive, first, last


def ranges(packed: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive places whose sizes add up to about ``limit``; a larger one is alone."""
    out, first, held = [], 0, 0
    for k, size in enumerate(packed):
        if k > first and held + size > limit:
            out.append((first, k))
            first, held = k, 0
        held += size
    return [*out, (first, len(packed))] if packed else out


def _rows(archive: str, z: zipfile.ZipFile, first: int, last: int, content: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        types = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["archive", "name", "bytes", "content"])

    for entry in z.infolist()[first:last]:
        if entry.is_dir():
            continue
        data = z.read(entry) if content else None  # a wrong checksum raises; no more comes than the listing declares
        held.append((archive, entry.filename.replace("\\", "/"), entry.file_size, data))
        size += len(data or b"") + 64
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, Any]) -> None:
        self.path = options["path"]
        self.content = options.get("content", "true") == "true"
        self.limit = int(options.get("range", RANGE))
        self.most = int(options.get("files", MOST_FILES)), int(options.get("most", MOST_BYTES))
        self.root = options.get("root", "/")

    def partitions(self) -> list[Entries]:
        out = []
        for archive, _ in store.sizes(self.path, ".zip"):
            with store.opened(archive) as f, zipfile.ZipFile(f) as z:
                plan(z, Path(self.root).resolve(), *self.most)
                out += [Entries(archive, a, b) for a, b in ranges([x.compress_size for x in z.infolist()], self.limit if self.content else 1 << 62)]
        return out or [Entries("", 0, 0)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if partition.archive:
            with store.opened(partition.archive) as f, zipfile.ZipFile(f) as z:
                yield from _rows(partition.archive, z, partition.first, partition.last, self.content)


class ZipSource(DataSource):
    """Options: path, content (false: listings only), range, files and most (limits), root (where entries will be written)."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ZipReader:
        return ZipReader(dict(self.options))


def _whole(content: bool, most: tuple[int, int]):
    """Entries of archives that came as rows, for paths that only Spark's own readers open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    plan(z, Path("/"), *most)
                    yield from _rows(path, z, 0, len(z.infolist()), content)

    return run


def read_entries(spark: SparkSession, path: str, content: bool = True, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, root: str = "/", limit: int = RANGE) -> DataFrame:
    """(archive, name, bytes, content) of the files in all archives of a path, which may be one archive or a folder.

    An archive that breaks a rule of ``archive.plan`` raises, and nothing of it is
    read; one without entries has no rows, a folder entry neither. An entry has
    one row, so it holds 2 GB at most. Where Python cannot open the path, an archive
    is read as one row of Spark's ``binaryFile``.
    """
    if not store.reaches(path):
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")
        return whole.mapInArrow(_whole(content, (most_files, most_bytes)), SCHEMA)
    spark.dataSource.register(ZipSource)
    options = {"content": str(content).lower(), "range": limit, "files": most_files, "most": most_bytes, "root": root}
    return spark.read.format("zip_entries").options(**options).load(path)


def unpack(spark: SparkSession, path: str, folder: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> int:
    """Writes the entries of an archive below a folder that all executors share, range by range; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with store.created(f"{folder}/{name}") as out:
                    out.write(data.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    entries = read_entries(spark, path, True, most_files, most_bytes, store.local_path(folder) or "/")
    return entries.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_archives(rows: DataFrame, folder: str, archive: str = "archive", name: str = "name", content: str = "content") -> DataFrame:
    """(archive, entries): packs rows into ``folder/<archive>.zip``, one task an archive, entries in the order of their names, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, stack, z = None, 0, None, None
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal stack
            if stack is not None:
                z.close()
                stack.__exit__(None, None, None)
                done.append((now, n))
                stack = None

        try:
            for b in batches:
                for a, entry, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if a != now:
                        close()
                        now, n, stack = a, 0, store.created(f"{folder}/{a}.zip")
                        z = zipfile.ZipFile(stack.__enter__(), "w", zipfile.ZIP_DEFLATED)
                    z.writestr(zipfile.ZipInfo(entry), data.as_py() or b"", zipfile.ZIP_DEFLATED)
                    n += 1
            close()
        except BaseException as e:
            if stack is not None:
                stack.__exit__(type(e), e, e.__traceback__)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "entries"])

    read = rows.selectExpr(f"cast({archive} as string) as archive", f"cast({name} as string) as name", f"cast({content} as binary) as content").where("archive is not null")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return read.repartition(n, "archive").sortWithinPartitions("archive", "name").mapInArrow(run, "archive string, entries long")
