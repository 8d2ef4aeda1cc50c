"""Cross-validation as a table of steps: each fold is trained, exported and transcribed, in this order, and any number of runs may share the work.

A step's state are files of its folder: a claim that only one run can make, and a
result that appears when it is whole. A run that dies leaves claims, which are free
again after ``stale`` seconds without a sign of life.
"""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.operators import scoring
from speechmill.sources import files

STEPS = ("train", "export", "transcribe")
WAITING, READY, CLAIMED, DONE = "waiting", "ready", "claimed", "done"


class Trainer(Protocol):
    def train(self, labels: DataFrame, fold: int, folder: str) -> None:
        """Trains on all but a fold, into the folder."""

    def export(self, folder: str, out: str) -> None:
        """Turns what :meth:`train` left into what a recognizer reads."""

    def transcribe(self, rows: DataFrame, folder: str) -> DataFrame:
        """(id, hyp) of rows, by what :meth:`export` left."""


class FoldRuns:
    def __init__(self, folder: str, folds: Iterable[int], stale: float = 3600.0) -> None:
        self.folder, self.folds, self.stale, self.owner = folder, tuple(folds), stale, uuid.uuid4().hex
        os.makedirs(folder, exist_ok=True)

    def path(self, fold: int, step: str) -> str:
        return os.path.join(self.folder, f"fold{fold}", step)

    def _mark(self, fold: int, step: str, kind: str) -> str:
        return f"{self.path(fold, step)}.{kind}"

    def state(self, fold: int, step: str) -> str:
        if os.path.exists(self._mark(fold, step, "done")):
            return DONE
        before = STEPS.index(step)
        if before and not os.path.exists(self._mark(fold, STEPS[before - 1], "done")):
            return WAITING
        with contextlib.suppress(FileNotFoundError):
            if time.time() - os.path.getmtime(self._mark(fold, step, "claim")) < self.stale:
                return CLAIMED
        return READY

    def table(self, spark: SparkSession) -> DataFrame:
        """(fold, step, state) of all steps."""
        return spark.createDataFrame([(k, s, self.state(k, s)) for k in self.folds for s in STEPS], "fold int, step string, state string")

    def claim(self, fold: int, step: str) -> bool:
        """Makes a ready step this run's own; of several runs that try, one gets it."""
        if self.state(fold, step) != READY:
            return False
        mark = self._mark(fold, step, "claim")
        os.makedirs(os.path.dirname(mark), exist_ok=True)
        with contextlib.suppress(FileNotFoundError):  # a stale claim goes out of the way under a name of its own: one run can move it
            if time.time() - os.path.getmtime(mark) >= self.stale:
                os.rename(mark, f"{mark}.{self.owner}")
                os.remove(f"{mark}.{self.owner}")
        try:
            with open(mark, "x", encoding="utf-8") as f:
                f.write(self.owner)
        except FileExistsError:
            return False
        return self.state(fold, step) != DONE

    @contextlib.contextmanager
    def alive(self, fold: int, step: str) -> Iterator[None]:
        """Renews a claim while a step runs."""
        over = threading.Event()

        def renew() -> None:
            while not over.wait(self.stale / 4):
                with contextlib.suppress(FileNotFoundError):
                    os.utime(self._mark(fold, step, "claim"))

        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        try:
            yield
        finally:
            over.set()
            beat.join()

    def finish(self, fold: int, step: str) -> None:
        mark = self._mark(fold, step, "done")
        with open(f"{mark}.{self.owner}", "w", encoding="utf-8") as f:
            json.dump({"owner": self.owner, "at": time.time()}, f)
        os.replace(f"{mark}.{self.owner}", mark)

    def run(self, work: Callable[[int, str, str], None]) -> int:
        """Does every step that is or becomes ready, ``work(fold, step, path)``; returns how many. Steps of other runs are left to them."""
        done = 0
        for fold in self.folds:
            for step in STEPS:
                if self.claim(fold, step):
                    with self.alive(fold, step):
                        work(fold, step, self.path(fold, step))
                    self.finish(fold, step)
                    done += 1
        return done

    def complete(self) -> bool:
        return all(self.state(k, STEPS[-1]) == DONE for k in self.folds)


def cross_validated(spark: SparkSession, labels: DataFrame, trainer: Trainer, folder: str, folds: Iterable[int], stale: float = 3600.0) -> FoldRuns:
    """Trains, exports and transcribes the folds that are not done yet; a fold's transcripts are a map below its folder."""
    runs = FoldRuns(folder, folds, stale)

    def work(fold: int, step: str, path: str) -> None:
        before = lambda s: runs.path(fold, s)
        if step == "train":
            trainer.train(labels.where(F.col("fold") != fold), fold, path)
        elif step == "export":
            trainer.export(before("train"), path)
        else:
            files.write_map(trainer.transcribe(labels.where(F.col("fold") == fold), before("export")), f"{path}.json")

    runs.run(work)
    return runs


def fold_score(spark: SparkSession, labels: DataFrame, stock: DataFrame, runs: FoldRuns, folds: int, name: str = "fine-tuned") -> DataFrame:
    """(subset, system, utterances, tokens, rate, wrong) of the stock transcripts (id, hyp) and those of the folds.

    With all folds every label needs both transcripts, or it raises; with some of
    them, only ids that both have count. Raises while a fold is not transcribed.
    """
    if not runs.complete():
        raise ValueError("not all folds are transcribed yet")
    heard = None
    for fold in runs.folds:
        one = files.read_system(spark, f"{name}={runs.path(fold, STEPS[-1])}.json").select("system", "id", "hyp")
        heard = one if heard is None else heard.unionByName(one)
    hyps = stock.select(F.lit("stock").alias("system"), "id", "hyp").unionByName(heard)
    if set(runs.folds) >= set(range(folds)):
        scoring.require_complete(labels, hyps, ["stock", name])
    else:
        labels = scoring.complete(labels, hyps, ["stock", name])
    return scoring.subset_rates(scoring.cells(labels, hyps), with_status="status" in labels.columns)
