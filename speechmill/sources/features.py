"""What a recognizer needs before its graph: resampling, log-mel frames, speeds. In numpy, for providers and Arrow batches."""

from __future__ import annotations

import functools
import math

import numpy as np

from speechmill.sources.audio import RATE

#: Fixed values of the front end.
BINS, FRAME, SHIFT, FFT, LOW, PREEMPHASIS = 80, 400, 160, 512, 20.0, 0.97
SPEEDS = {0.9: (10, 9), 0.95: (20, 19), 1.0: (1, 1), 1.05: (20, 21), 1.1: (10, 11)}


def resample(x: np.ndarray, up: int, down: int, lobes: int = 10) -> np.ndarray:
    """Samples at up/down times the rate, through a windowed sinc low-pass at the lower of both."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return np.asarray(x, np.float32)
    wide = max(up, down)
    half = lobes * wide
    t = np.arange(-half, half + 1)
    kernel = np.sinc(t / wide) * np.kaiser(len(t), 5.0)
    kernel *= up / kernel.sum()
    stretched = np.zeros(len(x) * up)
    stretched[::up] = x
    n = len(stretched) + len(kernel) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(stretched, size) * np.fft.rfft(kernel, size), size)[half : half + len(stretched)]
    return full[::down][: -(-len(x) * up // down)].astype(np.float32)


def to_rate(x: np.ndarray, rate: int) -> np.ndarray:
    return resample(x, RATE, rate)


def speed(x: np.ndarray, factor: float) -> np.ndarray:
    """One of five fixed speeds."""
    return resample(x, *SPEEDS[factor])


def _mel(f: np.ndarray | float) -> np.ndarray:
    return 1127.0 * np.log1p(np.asarray(f) / 700.0)


@functools.cache
def filters() -> np.ndarray:
    edges = np.linspace(_mel(LOW), _mel(RATE / 2), BINS + 2)
    m = _mel(np.arange(FFT // 2 + 1) * RATE / FFT)[None]
    rise = (m - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - m) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, 80) of samples in [-1, 1): whole frames only, Hamming window, no dither."""
    x = np.asarray(x, np.float64) * 32768
    count = 1 + (len(x) - FRAME) // SHIFT if len(x) >= FRAME else 0
    if not count:
        return np.zeros((0, BINS), np.float32)
    f = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::SHIFT][:count]
    f = f - f.mean(1, keepdims=True)
    f = f - PREEMPHASIS * np.concatenate([f[:, :1], f[:, :-1]], 1)
    power = np.abs(np.fft.rfft(f * np.hamming(FRAME), FFT)) ** 2
    return np.log(np.maximum(power @ filters().T, np.finfo(np.float32).eps)).astype(np.float32)


def padded(batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices padded with zeros to the longest, and their lengths."""
    lengths = np.array([len(b) for b in batch], np.int64)
    out = np.zeros((len(batch), int(lengths.max(initial=0)), batch[0].shape[1] if batch else 0), np.float32)
    for i, b in enumerate(batch):
        out[i, : len(b)] = b
    return out, lengths


def prompted(features: np.ndarray, lengths: np.ndarray, prompt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control frames in front of every row; lengths grow by as many."""
    head = np.broadcast_to(prompt[None], (len(features), *prompt.shape))
    return np.concatenate([head, features], 1), lengths + len(prompt)
