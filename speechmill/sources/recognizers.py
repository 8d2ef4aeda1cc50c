"""Recognizers as providers: a model is built once a task and reads Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 16


class Recognizer(Protocol):
    def transcribe(self, inputs: list) -> list[str]:
        """Texts of waves, in their order."""


class FakeRecognizer:
    """Corrupts a known text by a seed: a stand-in for tests."""

    def __init__(self, seed: int = 0, percent: int = 10) -> None:
        self.seed, self.percent = seed, percent

    def transcribe(self, inputs: list[str]) -> list[str]:
        return [" ".join(w for i, w in enumerate((t or "").split(" ")) if hashlib.md5(f"{self.seed}:{t}:{i}".encode()).digest()[0] % 100 >= self.percent) for t in inputs]


class LoudnessRecognizer:
    """Says how loud a wave is: a stand-in for tests that have waves."""

    def transcribe(self, inputs: list) -> list[str]:
        return ["loud" if max(map(abs, x), default=0) > 0.5 else "quiet" for x in inputs]


class OnnxRecognizer:
    """Greedy labels of an exported graph over feature matrices; needs onnxruntime."""

    def __init__(self, model: str, pieces: list[str], blank: int = 0, leading: int = 4) -> None:
        import onnxruntime

        self.session, self.pieces, self.blank, self.leading = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), pieces, blank, leading

    def transcribe(self, inputs: list) -> list[str]:
        import numpy as np

        out = []
        for x in inputs:
            logits = self.session.run(None, {self.session.get_inputs()[0].name: np.asarray(x, np.float32)[None]})[0][0]
            path = logits.argmax(-1)[self.leading :]
            labels = [v for i, v in enumerate(path) if (i == 0 or v != path[i - 1]) and v != self.blank]
            out.append("".join(self.pieces[v] for v in labels).replace("▁", " ").strip())
        return out


def transcribed(rows: DataFrame, make: Callable[[], Recognizer], column: str, key: str = "id", length: str | None = None) -> DataFrame:
    """(key, hyp) of every row. ``length`` names a column to sort partitions by, so that batches pad little."""
    cols = rows.select(F.col(key).cast("string").alias("id"), F.col(column).alias("x"), *([F.col(length).alias("n")] if length else []))
    ordered = cols.sortWithinPartitions("n").drop("n") if length else cols

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        model = make()
        for frame in batches:
            texts: list[str] = []
            for at in range(0, len(frame), BATCH):
                texts += model.transcribe(list(frame["x"].iloc[at : at + BATCH]))
            yield pd.DataFrame({"id": frame["id"], "hyp": texts})

    return ordered.mapInPandas(run, "id string, hyp string")
