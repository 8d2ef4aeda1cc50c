"""Token edit distance of long texts, where interning a pair by expressions is quadratic in its vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def distance(a: list, b: list) -> int:
    """Levenshtein distance by bit vectors (Myers; block-free on Python's long integers)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << i
    whole, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = whole, 0, len(b)
    for t in a:
        eq = where.get(t, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & whole, plus & xh
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & whole
        down = (down << 1) & whole
        plus, minus = down | ~(xv | up) & whole, up & xv
    return score


def token_distances(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Replaces two token arrays by (errors, tokens); null arrays count as empty."""
    others = [f for f in rows.schema.fields if f.name not in (ref, hyp)]
    schema = T.StructType([*others, T.StructField("errors", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pairs = list(zip(b.column(b.schema.get_field_index(ref)).to_pylist(), b.column(b.schema.get_field_index(hyp)).to_pylist(), strict=True))
            errors = [distance(x or [], y or []) for x, y in pairs]
            kept = [b.column(b.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(errors, pa.int64()), pa.array([len(x or []) for x, _ in pairs], pa.int64())], [*[f.name for f in others], "errors", "tokens"])

    return rows.mapInArrow(run, schema)
