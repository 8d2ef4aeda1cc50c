"""What a run read: a digest for each input, and a record that refuses to go on with others."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: larger files are known by size and time of change.
LARGE = 64 << 20


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mark) of files: SHA-256 of the bytes, which executors read; of large ones size and time of change."""
    files = spark.read.format("binaryFile").load(paths)
    small = files.where(F.col("length") <= LARGE).select("path", F.sha2("content", 256).alias("mark"))
    large = files.where(F.col("length") > LARGE).select("path", F.concat_ws(" ", "length", F.unix_micros("modificationTime")).alias("mark"))
    return small.unionByName(large)


def digest(spark: SparkSession, paths: Iterable[str], options: dict | None = None) -> str:
    """One digest of a few inputs and of the options they are used with."""
    told = {r["path"]: r["mark"] for r in file_digests(spark, sorted(paths)).toLocalIterator()}
    return hashlib.sha256(json.dumps([told, options or {}], sort_keys=True).encode()).hexdigest()


def same_bytes(first: str, second: str, step: int = 1 << 20) -> bool:
    """Whether two files are byte for byte the same; read in steps, and sizes first."""
    if os.path.getsize(first) != os.path.getsize(second):
        return False
    with open(first, "rb") as a, open(second, "rb") as b:
        while part := a.read(step):
            if part != b.read(step):
                return False
    return True


def claim(folder: str, fingerprint: str) -> None:
    """Marks a folder as this run's; raises if another run's results are in it."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "fingerprint")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read().strip() != fingerprint:
                raise ValueError(f"{folder} holds results of other inputs or options")
        return
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(fingerprint)
    os.replace(f"{path}.new", path)


def pending(folder: str, folds: Iterable[int]) -> list[int]:
    """Folds without a finished result; results appear under their name when they are whole."""
    return [k for k in folds if not os.path.exists(os.path.join(folder, f"fold{k}.json"))]


def finish(folder: str, fold: int, text: str) -> str:
    path = os.path.join(folder, f"fold{fold}.json")
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)
    return path
