"""Lexical retrieval packing.

Documents are encoded once. Whole windows of long ones are sequences as they are;
the tails (what is left after them) are written to the shared folder, and the
document frequencies of all of them are summed, one number for each id of the
vocabulary. A shuffle then puts related tails next to each other over the whole
table: the order is that of min-wise draws of a tail's ids, by squares of their
inverse document frequencies, so that two tails share the first draw as often as
their weighted sets overlap. Ranges of this order, in which a row's own number
breaks ties, deal hot groups over tasks. Each task builds BM25 inverted indexes,
with the statistics of all documents, over shards of a fixed number of rows, and
packs them: a seed document opens a sequence, the index returns the unused
documents nearest to it, and they fill the window greedily. Where none fits any
more the nearest is cut. What a shard cannot fill goes on to the next one; the
rest of a task is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.llm.bpe import byte_symbols
from speechmill.llm.common import cut, id_text, partitions, rows_of, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Draws of the order in which tails are dealt.
DRAWS = 4
#: The pre-split pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of a byte-level tokenizer file as numpy arrays, special strings included."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {s: i for i, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in label): i for label, i in spec["model"]["vocab"].items() if all(c in byte for c in label)}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s in self.specials:
            ranks.pop(s.encode(), None)
        self.ranks = ranks
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def sizes(self) -> np.ndarray:
        """How many bytes each id stands for."""
        out = np.zeros(max([*self.ranks.values(), *self.specials.values()]) + 1, np.int64)
        for token, i in self.ranks.items():
            out[i] = len(token)
        for s, i in self.specials.items():
            out[i] = len(s.encode())
        return out

    def _plain(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.specials):
            return self._plain(text)
        parts, at = [], 0
        for m in self.split.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.array([self.specials[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])])


class Bm25:
    """Inverted index over the rows of one shard; ``idf`` (by id) and ``mean`` (length) are those of the shard unless given.

    Ids that an eighth of the rows have are columns of a dense matrix, which is read faster than their long lists.
    """

    def __init__(self, rows: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None, k1: float = 1.2, b: float = 0.75) -> None:
        n = len(rows)
        size = np.array([len(r) for r in rows], np.int64)
        keys = (np.repeat(np.arange(n, dtype=np.int64), size) << 32) | np.concatenate(rows).astype(np.int64)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        tf = np.diff(np.r_[first, len(keys)]).astype(np.float64)
        keys = keys[first]
        doc, term = (keys >> 32).astype(np.int64), (keys & 0xFFFFFFFF).astype(np.int64)
        order = np.argsort(term, kind="stable")
        terms, begin, df = np.unique(term[order], return_index=True, return_counts=True)
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / max(size.mean() if mean is None else mean, 1)))
        slot = np.searchsorted(terms, term)
        weight *= (np.log1p((n - df + 0.5) / (df + 0.5)) if idf is None else idf[terms])[slot]
        dense = np.flatnonzero(df * 8 > n)
        self.column = np.full(len(terms), -1)
        self.column[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), n))
        inside = self.column[slot] >= 0
        self.dense[self.column[slot[inside]], doc[inside]] = weight[inside]
        self.weight, self.doc = weight[order], doc[order]
        self.begin, self.df, self.slot, self.n = begin, df, slot, n
        self.rows = np.searchsorted(doc, np.arange(n + 1))

    def scores(self, row: int) -> np.ndarray:
        """BM25 of every row for the terms of one row."""
        t = self.slot[self.rows[row] : self.rows[row + 1]]
        c = self.column[t]
        asked = np.zeros(len(self.dense))
        asked[c[c >= 0]] = 1
        t = t[c < 0]
        df = self.df[t]
        ends = np.cumsum(df)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[t] - (ends - df), df)
        return np.bincount(self.doc[at], self.weight[at], self.n) + asked @ self.dense


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    def __init__(self, window: int, shard_rows: int, first: int, idf: np.ndarray | None = None, mean: float | None = None) -> None:
        self.window, self.shard_rows, self.next, self.idf, self.mean = window, shard_rows, first, idf, mean
        self.pool: list[list] = []  # [doc_id, ids, start, doc_tokens]
        self.out: list[tuple] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, ids, start, total in pieces:
            self.out.append((doc, start, len(ids), _crc(ids), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray, start: int, total: int) -> None:
        """A document's ids from ``start`` on, fewer than a window."""
        self.pool.append([doc, ids, start, total])
        if len(self.pool) >= self.shard_rows:
            self.pack()

    def pack(self) -> None:
        """Fills windows until the pool has too few tokens for one."""
        pool, w = self.pool, self.window
        index = Bm25([p[1] for p in pool], self.idf, self.mean)
        left = np.array([len(p[1]) for p in pool])
        total = int(left.sum())
        for seed in range(len(pool)):
            while left[seed] and total >= w:
                score = index.scores(seed)
                score[seed] = np.inf
                order = np.argsort(-score, kind="stable")
                order = order[left[order] > 0]
                pieces, room = [], w
                for j in order:
                    if left[j] <= room:
                        room -= left[j]
                        pieces.append((*pool[j],))
                        left[j] = 0
                        if not room:
                            break
                for j in order if room else ():
                    if left[j]:  # longer than the room: cut
                        doc, ids, start, n = pool[j]
                        pieces.append((doc, ids[:room], start, n))
                        pool[j] = [doc, ids[room:], start + room, n]
                        left[j] -= room
                        break
                self._sequence(pieces)
                total -= w
            if total < w:
                break
        self.pool = [p for p, n in zip(pool, left, strict=True) if n]

    def end(self) -> None:
        while sum(len(p[1]) for p in self.pool) >= self.window:
            self.pack()
        size = sum(len(p[1]) for p in self.pool)
        while size:
            room, pieces = 1 << (size.bit_length() - 1), []
            size -= room
            while room:
                doc, ids, start, n = self.pool[0]
                pieces.append((doc, ids[:room], start, n))
                if len(ids) > room:
                    self.pool[0] = [doc, ids[room:], start + room, n]
                else:
                    self.pool.pop(0)
                room -= len(pieces[-1][1])
            self._sequence(pieces)

    def taken(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _pieces(tokenizer_path: str, window: int, end_id: int, width: str):
    """Texts as whole windows, which are sequences, and tails, which carry their ids and a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, first = ByteBpe(tokenizer_path), np.array([end_id], np.uint32), _task() << 40
        sequence = row = first
        for docs, texts in rows_of(batches):
            out = []
            for doc, t in zip(docs, texts, strict=True):
                ids = np.concatenate([coder.encode(t), end])
                n = len(ids)
                for start in range(0, n, window):
                    part = ids[start : start + window]
                    if len(part) == window:
                        out.append((doc, start, window, _crc(part), n, sequence, 0, None, None))
                        sequence += 1
                    else:
                        out.append((doc, start, len(part), 0, n, None, None, part.astype(width).tobytes(), row))
                        row += 1
            cols = list(zip(*out, strict=True)) or [()] * 9
            types = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*NAMES, "ids", "row"])

    return run


def _frequencies(size: int, width: str):
    """How many tails have each id; -1 stands for how many tails there are, -2 for their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for blob in b.column(0):
                ids = np.frombuffer(blob.as_buffer(), width)
                df[np.unique(ids)] += 1
                n, tokens = n + 1, tokens + len(ids)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, found]), pa.array(np.r_[n, tokens, df[found]])], ["term", "df"])

    return run


def _draws(weight: np.ndarray, seed: int = 0) -> np.ndarray:
    """For each draw and id the time at which the id comes up; of a set the earliest is drawn, by weight."""
    return np.random.default_rng(seed).exponential(size=(DRAWS, len(weight))) / np.maximum(weight, 1e-18)


def _keyed(weight: np.ndarray, width: str):
    """The draws of every tail beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = _draws(weight)
        for b in batches:
            keys = np.zeros((DRAWS, b.num_rows), np.int32)
            for i, blob in enumerate(b.column("ids")):
                ids = np.frombuffer(blob.as_buffer(), width)
                for k in range(DRAWS):
                    keys[k, i] = ids[times[k][ids].argmin()]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, keys)], [*b.schema.names, *(f"k{k}" for k in range(DRAWS))])

    return run


def _packed(window: int, shard_rows: int, idf: np.ndarray, mean: float, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, shard_rows, 1 << 62 | _task() << 40, idf, mean)
        for b in batches:
            for doc, start, total, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.add(doc, np.frombuffer(blob, width), start, total)
            yield packer.taken()
        packer.end()
        yield packer.taken()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, shard_rows: int = 2048) -> DataFrame:
    """One row per piece: where ``length`` ids of a document from ``start`` on lie in a sequence.

    ``window`` is a power of two. A null or empty text is the end id alone. Every
    row is packed, repeated rows and null ids included; an empty table gives an
    empty result. Ties of the order and of scores go by the place in the input. A
    sequence is full or its length is a power of two.
    """
    size = max(len(ByteBpe(tokenizer_path).sizes()), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    made = cut(id_text(docs, id_col, text_col).mapInArrow(tidy(_pieces(tokenizer_path, window, end_id, width)), f"{SCHEMA}, ids binary, row long"))
    tails = made.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids", "row")
    # one row for each id of the vocabulary, and two sums
    counted = dict(tails.select("ids").mapInArrow(tidy(_frequencies(size, width)), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
    n, tokens = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(size)
    df[np.array(list(counted), np.int64)] = list(counted.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    draws = [f"k{k}" for k in range(DRAWS)]
    weight = np.where(df > 1, idf**2, 0)  # an id that one tail has alone is shared with none
    keyed = tails.mapInArrow(tidy(_keyed(weight, width)), "doc_id long, start long, doc_tokens long, ids binary, row long, " + ", ".join(f"{k} int" for k in draws))
    dealt = keyed.repartitionByRange(partitions(docs), *draws, "row").sortWithinPartitions(*draws, "row")
    filled = dealt.mapInArrow(tidy(_packed(window, shard_rows, idf, tokens / max(n, 1), width)), SCHEMA)
    return made.where("ids is null").select(*NAMES).unionByName(filled)
