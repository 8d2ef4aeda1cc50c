"""Array arithmetic around a recognizer: loudness, low-frame-rate stacking, normalisation, masks, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain_clip(wave: Column, db: Column | float) -> Column:
    """Amplified by ``db`` decibels and clipped to [-1, 1]."""
    factor = F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)
    return F.transform(wave, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * factor)))


def peak_normalize(wave: Column, peak: float) -> Column:
    """Scaled so that the largest magnitude is ``peak``; silence is taken as a peak of 1e-4."""
    top = F.greatest(F.array_max(F.transform(wave, lambda v: F.abs(v.cast("double")))), F.lit(1e-4))
    return F.transform(wave, lambda v: v * (F.lit(float(peak)) / top))


def step_from_zero(wave: Column) -> Column:
    """Every sample one 16-bit step further from zero; zeros stay."""
    return F.transform(wave, lambda v: v + F.signum(v) / 32768)


def lfr_stack(frames: Column, window: int = 7, hop: int = 6) -> Column:
    """Windows of ``window`` frames every ``hop``, each flattened; null with fewer frames than one window."""
    count = F.floor((F.size(frames) - window) / hop)
    starts = F.sequence(F.lit(0), count.cast("int"))
    return F.when(F.size(frames) >= window, F.transform(starts, lambda t: F.flatten(F.slice(frames, t * hop + 1, F.lit(window)))))


def cmvn(frame: Column, neg_mean: Column, inv_std: Column) -> Column:
    """(x + negative mean) * inverse deviation, elementwise."""
    return F.zip_with(F.zip_with(frame, neg_mean, lambda x, m: x + m), inv_std, lambda x, s: x * s)


def mask_band(frame: Column, first: Column | int, width: Column | int, bins: int = 80) -> Column:
    """Zeros in one band of bins of each stacked frame."""
    lo = first if isinstance(first, Column) else F.lit(first)
    n = width if isinstance(width, Column) else F.lit(width)
    return F.transform(frame, lambda v, i: F.when((i % bins >= lo) & (i % bins < lo + n), F.lit(0.0)).otherwise(v))


def mask_spans(frames: Column, start: Column, length: Column) -> Column:
    """Frames in [start, start + length) become zeros."""
    return F.transform(frames, lambda f, t: F.when((t >= start) & (t < start + length), F.transform(f, lambda v: v * 0)).otherwise(f))


def lr_schedule(progress: Column, warmup: float = 0.1, floor: float = 0.1) -> Column:
    """Factor on a learning rate: linear warm-up, then a cosine down to ``floor``."""
    rest = F.least(F.lit(1.0), (progress - warmup) / (1 - warmup))
    cosine = floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * rest))
    return F.when(progress < warmup, F.greatest(progress / warmup, F.lit(0.01))).otherwise(cosine)


def greedy_ctc(path: Column, blank: int = 0) -> Column:
    """Labels of a path of best symbols: repeats collapse, then blanks go."""
    kept = F.filter(path, lambda v, i: (i == 0) | (v != F.get(path, i - 1)))
    return F.filter(kept, lambda v: v != blank)


def best_symbol(logits: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def rich_and_text(path: Column, leading: int = 4, blank: int = 0) -> Column:
    """struct(rich, text): the leading symbols as they are, and the greedy labels of the rest."""
    rest = F.slice(path, leading + 1, F.greatest(F.size(path) - leading, F.lit(0)))
    return F.struct(F.slice(path, 1, leading).alias("rich"), greedy_ctc(rest, blank).alias("text"))


def mix_weights(base: Column, tuned: Column, weight: float) -> Column:
    """base + weight * (tuned - base), elementwise."""
    return F.zip_with(base, tuned, lambda b, t: b + F.lit(float(weight)) * (t - b))
