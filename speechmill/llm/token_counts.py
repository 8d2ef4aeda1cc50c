"""Token counts by overlap resynchronisation.

A document is encoded in overlapping chunks with offsets: the bytes of a token
tell where it ends. Two neighbouring chunks are spliced at a boundary that both
have and that is proven stable: no alternative of the pre-split pattern matches
across a letter or digit that a blank or mark follows, or across a mark that a
blank follows, so what stands before such a place cannot change what comes after
it, nor the other way round, wherever a chunk begins or ends. A place inside a
special string is none. Without a common boundary the overlap is widened, and
then the chunk. A document of one chunk is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speechmill.llm.common import id_text, rows_of, tidy
from speechmill.llm.packing import ByteBpe

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Places that the pre-split pattern always cuts at; all characters are of classes that every version of Unicode agrees on.
STABLE = re.compile(r"(?<=[A-Za-z0-9\u4e00-\u9fff])(?=[ \n.,;:!?\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f])|(?<=[!-/:-@\[-`{-~])(?=[ \n])")


class Resync:
    """Counts tokens in chunks of ``chunk`` characters; ``splices`` tells how often two chunks were joined."""

    def __init__(self, path: str, chunk: int = 2048, overlap: int = 48) -> None:
        self.coder = ByteBpe(path)
        self.sizes = self.coder.sizes()
        self.chunk, self.overlap = max(chunk, 64), max(overlap, 16)
        self.splices = 0

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        """Where each token of a chunk ends, in bytes from the chunk's start."""
        return np.cumsum(self.sizes[self.coder.encode(text[start:end])])

    def _stable(self, text: str, begin: int, end: int) -> list[int]:
        """Stable places between begin and end, the last one first."""
        found = [begin + m.start() for m in STABLE.finditer(text[begin:end]) if m.start()]
        if found:
            for s in self.coder.specials:
                at = text.find(s, max(0, begin - len(s)), end + len(s))
                while at >= 0:
                    found = [p for p in found if not at < p < at + len(s)]
                    at = text.find(s, at + 1, end + len(s))
        return found[::-1]

    @staticmethod
    def _token(ends: np.ndarray, at: int) -> int:
        """How many tokens end at a byte or before; -1 if no token ends there."""
        k = int(np.searchsorted(ends, at))
        return k + 1 if k < len(ends) and ends[k] == at else -1

    def count(self, text: str) -> int:
        n, total, overlap = len(text), 0, self.overlap
        start, end = 0, min(self.chunk, len(text))
        ends = self._encode(text, start, end)
        first = 0  # tokens of this chunk before the last splice
        while end < n:
            begin = max(end - overlap, start + 1)
            places = self._stable(text, begin, end)
            if places:
                stop = min(n, begin + self.chunk)
                if stop <= end:
                    stop = min(n, end + self.chunk)
                later, rest = self._encode(text, begin, stop), text[begin:end].encode()
                base = int(ends[-1]) - len(rest)
                for p in places:
                    at = len(text[begin:p].encode())
                    mine, theirs = self._token(ends, base + at), self._token(later, at)
                    if mine >= first and theirs >= 0:
                        break
                else:
                    places = []
            if places:
                total += mine - first
                start, end, ends, first, overlap = begin, stop, later, theirs, self.overlap
                self.splices += 1
            elif begin > start + 1:
                overlap *= 2
            else:  # the chunk has no stable boundary: take more text
                end = min(n, end + 2 * (end - start))
                ends = self._encode(text, start, end)
        return total + len(ends) - first


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 2048, overlap: int = 48) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    The tokenizer must be a byte-level one. Texts of more than ``chunk`` characters
    are counted in chunks, whole texts of any length. A null text counts as empty: 0 bytes
    and 0 tokens. Rows stay one to one, repeated rows and null ids included; an
    empty table gives an empty result. Special strings inside texts become
    their special token, the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Resync(tokenizer_path, chunk, overlap)
        for ids, texts in rows_of(batches):
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)
