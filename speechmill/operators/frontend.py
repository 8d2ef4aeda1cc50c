"""From waves to what a recognizer reads, inside the plan: speeds, log-mel frames, padded batches. Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from speechmill.operators.training import batches
from speechmill.sources import features

MEL = "array<array<float>>"


def _mapped(rows: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, run: Callable[..., object], *more: str) -> DataFrame:
    """``rows`` with ``out`` in addition: what ``run`` makes of ``column``, and of the columns ``more``, row by row of an Arrow batch."""
    kept = [f for f in rows.schema.fields if f.name != out]

    def mapped(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            at = b.schema.get_field_index
            cols = [b.column(at(c)) for c in (column, *more)]
            made = []
            for row in zip(*cols, strict=True):
                x, *others = row
                made.append(run(np.asarray(x.values), *(o.as_py() for o in others)) if x.is_valid else None)
            yield pa.RecordBatch.from_arrays([*[b.column(at(f.name)) for f in kept], pa.array(made, arrow)], [*[f.name for f in kept], out])

    return rows.mapInArrow(mapped, T.StructType([*kept, T.StructField(out, kind)]))


def log_mel(rows: DataFrame, wave: str = "wave", out: str = "mel") -> DataFrame:
    """Adds the log-mel frames of each wave of 16 kHz, an array of 80 values each; all frames of a wave go through one FFT.

    A wave shorter than a frame has none, a null one null.
    """
    return _mapped(rows, wave, out, T.ArrayType(T.ArrayType(T.FloatType())), pa.list_(pa.list_(pa.float32())), lambda x: list(features.log_mel(x)))


def at_speed(rows: DataFrame, factor: str, wave: str = "wave", out: str = "wave") -> DataFrame:
    """Each wave at the speed that its row's column ``factor`` names, one of five; another, or a null one, raises."""
    return _mapped(rows, wave, out, T.ArrayType(T.FloatType()), pa.list_(pa.float32()), features.speed, factor)


def padded_batches(rows: DataFrame, prompt: np.ndarray | None = None, key: str = "pos", frames: str = "frames", max_cells: int = 480, max_items: int = 24, seed: int = 0) -> DataFrame:
    """(batch, turn, keys, lengths, width, data): frames of similar length in matrices padded with zeros, for a provider.

    ``data`` are float32 cells of items by longest length by width, little-endian;
    ``prompt`` are frames in front of each item, which lengths count. Batches are
    those of ``training.batches``, so one has ``max_items`` items at most, and
    ``max_cells`` frames unless a single item is longer. Items without frames are left out.
    """
    read = rows.selectExpr(f"cast({key} as bigint) as pos", f"{frames} as frames").where("size(frames) > 0")
    planned = batches(read.selectExpr("pos", "cast(size(frames) as bigint) as length"), max_cells, max_items, seed)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.join(planned.select("batch", "turn", "pos"), "pos").select("batch", "turn", "pos", "frames").repartition(n, "batch").sortWithinPartitions("batch", "pos")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(batch: int, turn: str, keys: list, held: list[np.ndarray]) -> pa.RecordBatch:
            cells, lengths = features.padded(held)
            if prompt is not None:
                cells, lengths = features.prompted(cells, lengths, prompt)
            values = [[batch], [turn], [keys], [lengths.tolist()], [cells.shape[2]], [np.ascontiguousarray(cells, "<f4").tobytes()]]
            types = (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["batch", "turn", "keys", "lengths", "width", "data"])

        now, keys, held = None, [], []
        for b in batches_:
            for batch, turn, pos, x in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if now is not None and batch != now[0]:
                    yield whole(*now, keys, held)
                    keys, held = [], []
                now = batch, turn
                keys.append(pos)
                flat = x.values.flatten()
                held.append(np.asarray(flat, np.float32).reshape(len(x.values), -1))
        if now is not None:
            yield whole(*now, keys, held)

    return dealt.mapInArrow(run, "batch int, turn string, keys array<bigint>, lengths array<bigint>, width int, data binary")
