"""Hashes of words and word shingles, a text at a time in numpy."""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240101)
#: A random odd 64-bit number for each byte.
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(_BASE)
_32 = np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _32)) * _MIX
    h = (h ^ (h >> _32)) * _MIX
    return h ^ (h >> _32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK)
        _POWERS[:] = [np.cumprod(np.full(size, np.uint64(x), np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def _chunk_words(a: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[a], True].astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MIX)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``; equal words have equal hashes in every process."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= _CHUNK:
        return _chunk_words(a) if len(a) else np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < len(a):
        end = min(at + _CHUNK, len(a))
        if end < len(a):  # a chunk ends where a white space is
            gap = np.flatnonzero(_SPACE[a[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                gap = np.flatnonzero(_SPACE[a[end:]])
                end = end + int(gap[0]) + 1 if len(gap) else len(a)
        parts.append(_chunk_words(a[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; A-Z lower-cased. Fewer words make one shingle, no words none."""
    w = word_hashes(text.encode().lower())
    if 0 < len(w) < k:
        h = np.full(1, len(w), np.uint64)
        for i in range(len(w)):
            h = mix(h * _STEP + w[i : i + 1])
        return h
    if not len(w):
        return w
    n = len(w) - k + 1
    h = w[:n]
    for j in range(1, k):
        h = mix(h * _STEP + w[j : j + n])
    return np.unique(h)
