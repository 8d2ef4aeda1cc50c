"""Passes over training data: the plan of all epochs, what a frame model gives for batches, and a table of evaluations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechmill.functions.signal import lr_schedule
from speechmill.operators.sampling import dense
from speechmill.operators.training import batches, epoch

LEADING, BLANK = 4, 0


class FrameModel(Protocol):
    def scores(self, cells: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(items, frames, symbols) of padded (items, frames, width); what is beyond an item's length does not matter."""


class Identity:
    """The frames themselves as scores."""

    def scores(self, cells: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return cells


def frame_labels(padded: DataFrame, make: Callable[[], FrameModel], leading: int = LEADING, blank: int = BLANK) -> DataFrame:
    """(pos, rich, labels) of every item of ``frontend.padded_batches``: the best symbols of the leading frames, and the greedy labels of the others.

    A model is built once a task and reads whole batches, items of similar length;
    results go back to their keys, so nothing depends on how items were batched.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches_:
            out: list[tuple] = []
            for keys, lengths, width, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("keys", "lengths", "width", "data")), strict=True):
                cells = np.frombuffer(data, "<f4").reshape(len(keys), -1, width)
                best = model.scores(cells, np.array(lengths)).argmax(-1)
                for key, n, path in zip(keys, lengths, best, strict=True):
                    said = path[leading:n]
                    kept = said[np.r_[True, said[1:] != said[:-1]] & (said != blank)] if len(said) else said
                    out.append((key, path[: min(leading, n)].tolist(), kept.tolist()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32()))], ["pos", "rich", "labels"])

    return padded.mapInArrow(run, "pos bigint, rich array<int>, labels array<int>")


def training_plan(
    train: DataFrame, epochs: int, seed: int = 0, hard: int = 3, pairs: float = 0.15, replay: DataFrame | None = None, ratio: float = 2.0, max_cells: int = 480, max_items: int = 24, frames_per_second: float = 1000 / 60
) -> DataFrame:
    """(epoch, step, factor, kind, ids, audio, text, seconds): all that a trainer reads, batch by batch.

    ``step`` numbers an epoch's batches in their shuffled order from 0, ``factor`` is
    that of the learning rate. Items whose length makes no frame are left out.
    Batches are those of ``training.batches`` over frames.
    """
    parts = None
    for number in range(1, epochs + 1):
        rows = epoch(train, seed, number, hard, pairs, replay, ratio).withColumn("frames", F.floor(F.col("seconds") * frames_per_second).cast("bigint")).where("frames > 0")
        rows = dense(rows.withColumn("first", F.element_at("ids", 1)), "kind", "pos", "first", name="place")
        planned = batches(rows.select(F.col("place").alias("pos"), F.col("frames").alias("length")), max_cells, max_items, seed + number)
        order = dense(planned.select("batch", "turn").distinct(), "turn", "batch", name="step")
        one = rows.join(planned.select(F.col("pos").alias("place"), "batch"), "place").join(order.select("batch", "step"), "batch").join(F.broadcast(order.agg(F.count(F.lit(1)).alias("steps"))))  # one row
        one = one.select(F.lit(number).alias("epoch"), "step", lr_schedule((F.lit(number - 1) + F.col("step") / F.col("steps")) / F.lit(float(epochs))).alias("factor"), "kind", "ids", "audio", "text", "seconds")
        parts = one if parts is None else parts.unionByName(one)
    return parts


KEYS = ("pass", "manifest", "system")
SUMS = ("utterances", "tokens", "errors", "wrong")


def latest(cells: DataFrame) -> DataFrame:
    """Of cells (pass, manifest, system, id, ord, errors, tokens) the one with the largest ``ord`` of each id."""
    return cells.groupBy(*KEYS, "id").agg(F.max_by(F.struct("errors", "tokens"), "ord").alias("c"), F.max("ord").alias("ord")).select(*KEYS, "id", "ord", "c.errors", "c.tokens")


def evaluation_sums(cells: DataFrame) -> DataFrame:
    """(pass, manifest, system, utterances, tokens, errors, wrong) of cells, one an id."""
    return cells.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("utterances"), F.sum("tokens").alias("tokens"), F.sum("errors").cast("bigint").alias("errors"), F.count_if(F.col("errors") > 0).alias("wrong"))


def merged_sums(sums: DataFrame, known: DataFrame, late: DataFrame) -> DataFrame:
    """``sums`` with late cells: new ids are added, a known id counts as the late cell says. Only the late ones' ids are looked up.

    ``known`` are all cells so far, ``late`` new ones, whose ``ord`` is larger.
    """
    now = latest(late)
    keys = [*KEYS, "id"]
    before = latest(known.join(now.select(*keys), keys, "left_semi"))
    change = lambda rows, sign: evaluation_sums(rows).select(*KEYS, *[(F.col(c) * sign).alias(c) for c in SUMS])
    every = sums.select(*KEYS, *SUMS).unionByName(change(now, 1)).unionByName(change(before, -1))
    return every.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])


def running(sums: DataFrame) -> DataFrame:
    """``sums`` with the rate in percent, the mean of all passes so far, and whether this pass is the best so far."""
    rated = sums.withColumn("rate", F.lit(100.0) * F.col("errors") / F.greatest("tokens", F.lit(1)))
    so_far = Window.partitionBy("manifest", "system").orderBy("pass")  # a row for each pass
    return rated.withColumn("mean_rate", F.avg("rate").over(so_far)).withColumn("best", F.col("rate") <= F.min("rate").over(so_far))


def loss_means(losses: DataFrame) -> DataFrame:
    """(pass, loss, batches, mean_loss) of (pass, batch, loss): the mean of a pass, and of all batches so far. A batch without a loss counts for nothing."""
    per = losses.where("loss is not null").groupBy("pass").agg(F.sum("loss").alias("s"), F.count(F.lit(1)).alias("batches"))
    so_far = Window.orderBy("pass")  # a row for each pass
    return per.select("pass", (F.col("s") / F.col("batches")).alias("loss"), "batches", (F.sum("s").over(so_far) / F.sum("batches").over(so_far)).alias("mean_loss"))
