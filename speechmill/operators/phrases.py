"""Phrase conversion: leftmost longest match over a table of phrases, as an automaton that tasks walk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table goes to every task, so it may have so many phrases and characters; a longer one raises.
MOST_PHRASES, MOST_CHARACTERS = 200_000, 8_000_000


class PhraseAutomaton:
    """States are prefixes of phrases; a state that ends a phrase has its replacement under the empty text."""

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        self.start: dict = {}
        for phrase, replacement in pairs:
            state = self.start
            for c in phrase:
                state = state.setdefault(c, {})
            state[""] = replacement

    def convert(self, text: str) -> str:
        out, at, kept, n, start = [], 0, 0, len(text), self.start
        while at < n:
            state, end, found = start.get(text[at]), at + 1, None
            while state is not None:
                if "" in state:
                    found = end, state[""]
                state = state.get(text[end]) if end < n else None
                end += 1
            if found:
                out += text[kept:at], found[1]
                at = kept = found[0]
            else:
                at += 1
        return "".join([*out, text[kept:]]) if kept else text


def phrase_table(phrases: DataFrame) -> list[tuple[str, str]]:
    """(phrase, replacement) of a table, checked: no more than fit, and no phrase with two replacements; null or empty phrases count for nothing."""
    rows = phrases.select(F.col("phrase").cast("string").alias("phrase"), F.coalesce(F.col("replacement").cast("string"), F.lit("")).alias("replacement")).where("phrase <> ''").distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("phrase") + F.length("replacement")), F.lit(0))).first()
    if n > MOST_PHRASES or size > MOST_CHARACTERS:
        raise ValueError(f"{n} phrases of {size} characters; {MOST_PHRASES} of {MOST_CHARACTERS} may be given")
    twice = rows.groupBy("phrase").count().where("count > 1").select("phrase").limit(1).collect()
    if twice:
        raise ValueError(f"more than one replacement of {twice[0][0]!r}")
    return [(r["phrase"], r["replacement"]) for r in rows.collect()]  # of a checked size


def converted(rows: DataFrame, phrases: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with every phrase in ``column`` replaced: at each place the longest one, from left to right, never in what was replaced.

    ``phrases`` has phrase and replacement, see :func:`phrase_table`. A null text stays
    null. Regional phrases come before the table of characters that scoring applies.
    """
    table = rows.sparkSession.sparkContext.broadcast(phrase_table(phrases))
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = PhraseAutomaton(table.value)
        for b in batches:
            texts = [None if t is None else automaton.convert(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, pa.string()))

    return rows.withColumn(column, F.col(column).cast("string")).mapInArrow(run, T.StructType([*rows.schema.fields[:at], T.StructField(column, T.StringType()), *rows.schema.fields[at + 1 :]]))
