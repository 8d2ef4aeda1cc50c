"""Waves: 16 kHz mono 16-bit files in and out, and PCM files of any rate and width in."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from speechmill.sources import store

RATE = 16000
#: Fixed values of the container: format tags of integer, floating and extended data.
INTEGER, FLOAT, EXTENDED = 1, 3, 0xFFFE


def chunks(data: bytes) -> dict[bytes, memoryview]:
    """The parts of a RIFF file by their names; of parts with one name the first. A part that ends early has what there is."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no wave file")
    view, at, out = memoryview(data), 12, {}
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        out.setdefault(name, view[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def pcm(data: bytes) -> tuple[np.ndarray, int, int]:
    """(frames by channels, rate, bits) of a wave file, as floats in [-1, 1): integers of 8 to 32 bits, or floats."""
    parts = chunks(data)
    if b"fmt " not in parts or b"data" not in parts:
        raise ValueError("a wave file without a format or without data")
    tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if tag == EXTENDED and len(parts[b"fmt "]) >= 26:
        tag = struct.unpack_from("<H", parts[b"fmt "], 24)[0]
    if not channels or block != channels * bits // 8:
        raise ValueError("a wave file whose frames do not fit its channels")
    raw = parts[b"data"]
    raw = raw[: len(raw) // block * block]
    if tag == FLOAT and bits in (32, 64):
        x = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32)
    elif tag != INTEGER:
        raise ValueError(f"wave data of format {tag}")
    elif bits == 8:
        x = np.ldexp(np.frombuffer(raw, np.uint8).astype(np.float32) - 128, -7)
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = np.ldexp(wide.view("<i4")[:, 0].astype(np.float32), -31)
    elif bits in (16, 32):
        x = np.ldexp(np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32), 1 - bits)
    else:
        raise ValueError(f"wave data of {bits} bits")
    return x.reshape(-1, channels), rate, bits


def decode_wav(data: bytes) -> np.ndarray:
    """Samples of a file that is what recognizers take; anything else raises."""
    x, rate, bits = pcm(data)
    if rate != RATE or x.shape[1] != 1 or bits != 16:
        raise ValueError(f"a recognizer takes 16 kHz, mono, 16 bits; this file has {rate} Hz, {x.shape[1]} channels, {bits} bits")
    return x[:, 0]


def decode_any(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of one channel, the mean of all, and their rate."""
    x, rate, _ = pcm(data)
    return x.mean(1, dtype=np.float32), rate


def encode_wav(samples: np.ndarray, rate: int = RATE, channels: int = 1) -> bytes:
    """A file of 16 bits; with several channels all have the same samples."""
    out = io.BytesIO()
    if channels > 1:
        samples = np.repeat(np.asarray(samples), channels)
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_waves(spark: SparkSession, path: str, strict: bool = True, convert: bool = False) -> DataFrame:
    """(path, seconds, wave) of files, or of all files under a folder; without ``strict`` what cannot be decoded is skipped.

    ``convert`` takes files of any rate and number of channels and resamples them.
    """
    reader = spark.read.format("binaryFile")
    if not path.endswith(".wav"):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav")
    files = reader.load(path).select("path", "content")
    return waves(files, "content", strict, convert)


def waves(rows: DataFrame, column: str = "content", strict: bool = False, convert: bool = False) -> DataFrame:
    """(path, seconds, wave) of a binary column; see :func:`read_waves`."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from speechmill.sources.features import to_rate

        decode = (lambda data: to_rate(*decode_any(data))) if convert else decode_wav

        for frame in batches:
            out = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    x = decode(bytes(data))
                except Exception:
                    if strict:
                        raise
                    continue
                out.append((path, len(x) / RATE, x))
            yield pd.DataFrame(out, columns=["path", "seconds", "wave"])

    return rows.selectExpr("path", f"{column} as content").mapInPandas(run, "path string, seconds double, wave array<float>")


def write_waves(rows: DataFrame, folder: str, name: str = "name", column: str = "wave", rate: int = RATE, channels: int = 1) -> DataFrame:
    """Writes a file for each row into a folder that all executors reach, a local path or a URI; returns (name, audio)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            paths = [f"{folder}/{n}.wav" for n in frame["name"]]
            for path, x in zip(paths, frame["wave"], strict=True):
                with store.created(path) as out:
                    out.write(encode_wav(np.asarray(x), rate, channels))
            yield pd.DataFrame({"name": frame["name"], "audio": paths})

    return rows.selectExpr(f"{name} as name", f"{column} as wave").mapInPandas(run, "name string, audio string")
