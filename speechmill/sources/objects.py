"""Large JSON objects of strings, read in byte ranges.

Whether a place in a file is inside a string depends on all quotes before it. So
every range first tells, for either state it may begin in, the state it ends in;
these small answers are applied one after another, a row a range; and then every
range reads the entries whose keys begin in it, and no more than those.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.sources import store

#: Bytes of a range, and of what is read at once.
RANGE, READ = 16 << 20, 1 << 20
_STRING = rb'"(?:[^"\\]|\\.)*"'
_ENTRY = re.compile(rb"(" + _STRING + rb")\s*:\s*(" + _STRING + rb"|null)", re.S)
_KEY = re.compile(_STRING + rb"(\s*:)?", re.S)
_MARK = re.compile(rb'\\+|"')
PLAIN, QUOTED, ESCAPED = range(3)


def ends_in(data: bytes, state: int) -> int:
    """The state after the bytes: outside of strings, inside, or inside after a backslash that escapes what follows."""
    escaped_at = 0 if state == ESCAPED else -1
    quoted = state != PLAIN
    for m in _MARK.finditer(data):
        if m[0] == b'"':
            if m.start() != escaped_at:
                quoted = not quoted
        elif quoted:
            odd = (m.end() - m.start() - (m.start() == escaped_at)) % 2
            escaped_at = m.end() if odd else -1
    if not quoted:
        return PLAIN
    return ESCAPED if escaped_at == len(data) else QUOTED


def _pieces(path: str, start: int, end: int) -> Iterator[bytes]:
    with store.opened(path) as f:
        f.seek(start)
        while start < end and (data := f.read(min(READ, end - start))):
            start += len(data)
            yield data


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, start, end in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            states = [PLAIN, QUOTED, ESCAPED]
            for data in _pieces(path, start, end):
                states = [ends_in(data, s) for s in states]
            out.append((path, start, states))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["path", "start", "states"])


def entries(data: Iterator[bytes], state: int, length: int) -> Iterator[tuple[str, str | None]]:
    """Entries whose keys begin in the first ``length`` bytes of data that begins in a state and goes on to the end of the file."""
    held, gone = b"", 0  # what is not used up yet, and how much was
    if state != PLAIN:  # the rest of a string that began before
        for piece in data:
            held += piece
            at = 1 if state == ESCAPED else 0
            m = re.compile(rb'(?:[^"\\]|\\.)*"', re.S).match(held, at)
            if m:
                held, gone = held[m.end() :], m.end()
                break
    more = True
    while gone < length:
        quote = held.find(b'"')
        if quote >= 0:
            if gone + quote >= length:
                return
            m = _KEY.match(held, quote)
            # what a string is shows only after it, so a match that touches the end may be cut off
            if m and m.end() < len(held) and held[m.end() : m.end() + 64].strip():
                if not m[1]:  # the value of a key that began before
                    held, gone = held[m.end() :], gone + m.end()
                    continue
                e = _ENTRY.match(held, quote)
                if e and (e.end() < len(held) or not more):
                    yield json.loads(e[1]), json.loads(e[2])
                    held, gone = held[e.end() :], gone + e.end()
                    continue
                if not e and not more:
                    raise ValueError("not an object of strings")
        elif held.strip(b" \t\r\n,{}:nul"):
            raise ValueError("not an object of strings")
        else:
            held, gone = b"", gone + len(held)
        if not more:
            if quote >= 0 and held.strip():
                raise ValueError("an object that ends inside an entry")
            return
        piece = next(data, b"")
        more = bool(piece)
        held += piece or b" "


def _entries(states: dict[tuple[str, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out: list[tuple] = []
                held = 0

                def batch(rows: list[tuple], path: str = path) -> pa.RecordBatch:
                    cols = list(zip(*rows, strict=True))
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], ["path", "key", "value"])

                for key, value in entries(_pieces(path, start, size), states[path, start], end - start):
                    out.append((key, value))
                    held += len(key) + len(value or "") + 64
                    if held > 4_000_000:
                        yield batch(out)
                        out, held = [], 0
                if out:
                    yield batch(out)

    return run


def read_objects(spark: SparkSession, paths: list[str], limit: int = RANGE) -> DataFrame:
    """(path, key, value) of JSON objects of strings, as they come; a null value is null, a key that comes twice has two rows.

    A path is a file, or a folder whose files, one after another in the order of
    their names, are one object (as ``write_map`` leaves them); their entries are
    whole lines then, so each file can be read by itself. Anything but strings
    and nulls raises. Where Python cannot open a path Spark reads whole files.
    """
    if not all(map(store.reaches, paths)):
        lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.trim("value"), r"^[{,\s]+|[},\s]+$", "").alias("value"))
        return lines.select("path", F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,string>")).alias("key", "value"))
    files = [(p, n) for path in paths for p, n in store.sizes(path) if n and not p.rsplit("/", 1)[-1].startswith(("_", ".")) and not p.endswith(".crc")]
    dealt = [(p, a, min(a + limit, n), n) for p, n in files for a in range(0, n, limit)]
    if not dealt:
        return spark.createDataFrame([], "path string, key string, value string")
    ranges = spark.createDataFrame(dealt, "path string, start long, end long, size long").repartition(len(dealt), "path", "start")
    known = {(r["path"], r["start"]): r["states"] for r in ranges.mapInArrow(_states, "path string, start long, states array<int>").collect()} if len(dealt) > len(files) else {}
    starts: dict[tuple[str, int], int] = {}
    for path, start, _, _ in dealt:
        if start == 0:
            state = PLAIN
        starts[path, start] = state
        state = known[path, start][state] if known else PLAIN
    return ranges.mapInArrow(_entries(starts), "path string, key string, value string")
