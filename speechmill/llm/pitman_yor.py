"""Hierarchical Pitman-Yor language model over words.

A token's context is the two words before it. Context restaurants share parents:
that of (u1, u2) has as its parent that of u2, and all of those share the unigram
restaurant, whose base is uniform over the vocabulary and one unknown token. A
word u2 that is more than one in ``HOT`` tokens has not one restaurant but a few,
dealt by u1, so that no task gets all that follows it; how many, exact counts say.

Seatings are sampled by Gibbs. In a sweep the number of tables of each dish is drawn
from its conditional, given the other dishes as the sweep found them (``seating``);
the tables of (u1, u2) are the customers of u2. Every draw is a hash of the dish
and the sweep, so a score does not depend on partitions, nor on the order of rows. While the sweeps run, the unigram restaurant stands as if every
token had its own table: exact for words of more than one in ``FREQUENT`` tokens,
whose counts are broadcast, and by the mean of the others for those. It is then
seated from the tables of all restaurants, for each sample anew. The predictive
probabilities of the samples are averaged; those of the unigram restaurant, which
are the same for all contexts, are averaged on their own.

All of a u2 is in one shard. A task reads its documents in flushes of a bounded
number of tokens and names words by their place in the flush's own sorted
vocabulary. What it sends out are vocabularies, distinct trigrams with counts,
and word numbers; what comes back are arrays in the same order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speechmill.llm.common import cut, groups_of, id_text, packed, partitions, rows_of, tidy, unpacked
from speechmill.llm.seating import tables
from speechmill.llm.shingles import mix, word_hashes
from speechmill.sources.shared import discard, release

FLUSH, HOT, FREQUENT = 1_800_000, 256, 1 << 16
#: Words are told apart by the upper 48 bits of their hashes.
_48 = np.uint64(0xFFFFFFFFFFFF0000)
BOS, END = np.uint64(1 << 16), np.uint64(2 << 16)
ROWS = "part long, p long, a binary, b binary"
_STEP, _SWEEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["part", "p", "a", "b"])


def _bounds(v: np.ndarray, bits: int) -> np.ndarray:
    """Where each part of the hash range begins in a sorted vocabulary, and its end."""
    inner = np.searchsorted(v, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    return np.r_[0, inner, len(v)].astype(np.int64)


class Flush:
    """The documents of one flush: vocabulary, and the number of each token's word."""

    def __init__(self, ids: list, tokens: list[np.ndarray]) -> None:
        self.ids, self.size = ids, np.array([len(t) for t in tokens], np.int64)
        self.train = np.array([not held_out(i) for i in ids], bool)
        flat = np.concatenate(tokens)
        self.vocab, inverse = np.unique(np.r_[flat, BOS], return_inverse=True)
        self.word = inverse[:-1]


def codes(text: str) -> np.ndarray:
    """Codes of a text's words, and of its end."""
    h = word_hashes(text.encode().lower()) & _48
    return np.r_[np.where(h <= END, h + END, h), END]


def dealt_by(hot: np.ndarray, buckets: np.ndarray, u2: np.ndarray, u1: np.ndarray) -> np.ndarray:
    """Key of the restaurant that stands for u2, after u1 if u2 is a hot word. All are hashes of words."""
    key = mix(u2 + _STEP)
    if len(hot):
        slot = np.minimum(np.searchsorted(hot, u2), len(hot) - 1)
        found = hot[slot] == u2
        key[found] = mix(key[found] + (mix(u1[found] + _SWEEP) & (buckets[slot[found]] - np.uint64(1))) + np.uint64(1))
    return key


def context_key(unit: np.ndarray, u1: np.ndarray) -> np.ndarray:
    """Key of the restaurant of (u1, u2), given that of u2."""
    return mix(unit * _SWEEP + mix(u1 + _STEP))


def trigrams(vocab: np.ndarray, word: np.ndarray, size: np.ndarray, bits: int, hot: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the flush's distinct trigrams, in the order of their shards: numbers of u2, u1 and w, shard bounds; and each token's trigram."""
    begin, bos, n = np.r_[0, np.cumsum(size)[:-1]], np.searchsorted(vocab, BOS), len(vocab)
    u2 = np.r_[0, word[:-1]]
    u2[begin] = bos
    u1 = np.r_[0, u2[:-1]]
    u1[begin] = bos
    pair = u2 * n + u1
    if n >= 1 << 21:  # three numbers do not fit in 63 bits: pairs are numbered first
        pairs, pair = np.unique(pair, return_inverse=True)
    types, inverse = np.unique(pair * n + word, return_inverse=True)
    pair, w = types // n, types % n
    if n >= 1 << 21:
        pair = pairs[pair]
    u2, u1 = pair // n, pair % n
    shard = (dealt_by(hot, buckets, vocab[u2], vocab[u1]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(w), np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return u2[order], u1[order], w[order], np.searchsorted(shard[order], np.arange((1 << bits) + 1)), place[inverse]


def _send(kind: str, bits: int, hot: np.ndarray, buckets: np.ndarray):
    """What each task sends: "words", "trigrams" or "tokens"."""

    def out(f: Flush, p: int) -> list[tuple[int, int, bytes, bytes]]:
        if kind == "words":
            counts = np.bincount(f.word[np.repeat(f.train, f.size)], minlength=len(f.vocab)).astype(np.uint64)
            at = _bounds(f.vocab, bits)
            return [(k, p, packed(f.vocab[a:b], counts[a:b]), b"") for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
        if kind == "tokens":
            ids = np.array([0 if i is None else i for i in f.ids], np.int64)
            none = np.array([i is None for i in f.ids], np.uint8)
            wide = np.r_[np.uint32(0), f.word.astype(np.uint32)]  # the first entry keeps the column from being stored as differences
            return [(-1, p, packed(np.zeros(len(wide), np.uint8), wide), packed(np.zeros(len(ids), np.uint8), ids, f.size, none))]
        u2, u1, w, at, mine = trigrams(f.vocab, f.word, f.size, bits, hot, buckets)
        counts = np.bincount(mine[np.repeat(f.train, f.size)], minlength=len(w)).astype(np.uint32)
        rows = []
        used = np.zeros(len(f.vocab), np.int64)
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                parts = u2[a:b], u1[a:b], w[a:b]
                for x in parts:
                    used[x] = 1
                words = np.flatnonzero(used)
                used[words] = np.arange(len(words))
                rows.append((k, p, packed(*[used[x].astype(np.uint32) for x in parts], counts[a:b]), packed(f.vocab[words])))
                used[words] = 0
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        p = (context.partitionId() if context else 0) << 24
        ids, tokens, held = [], [], 0
        for some, texts in rows_of(batches):
            for i, t in zip(some, texts, strict=True):
                tokens.append(codes(t))
                ids.append(i)
                held += len(tokens[-1])
                if held >= FLUSH:
                    yield _batch(out(Flush(ids, tokens), p))
                    ids, tokens, held, p = [], [], 0, p + 1
        if ids:
            yield _batch(out(Flush(ids, tokens), p))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unigram counts of a part, back to every flush with its vocabulary; all of them under p = -1, and totals under p = -2."""
    for part, rows in groups_of(batches):
        every = [unpacked(r[2], "<u8", "<u8") for r in rows]
        words, inverse = np.unique(np.concatenate([v for v, _ in every]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([c for _, c in every]).astype(np.float64), len(words)).astype(np.uint64)
        out, at = [], 0
        for r, (v, _) in zip(rows, every, strict=True):
            out.append((part, r[1], packed(v), packed(np.zeros(len(v), np.uint8), counts[inverse[at : at + len(v)]])))
            at += len(v)
        out.append((part, -1, packed(words, counts), b""))
        out.append((part, -2, packed(np.zeros(2, np.uint8), np.array([counts.sum(), (counts > 0).sum()], np.uint64)), b""))
        yield _batch(out)


def _frequent(n: int):
    """(word, count) of words that are more than one in ``FREQUENT`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                words, counts = unpacked(blob.as_py(), "<u8", "<u8")
                often = counts * np.uint64(FREQUENT) > n
                yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["word", "n"])

    return run


def seated(key: np.ndarray, c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, sweep: int) -> np.ndarray:
    """Tables of dishes with c customers each, drawn from their conditional; see ``seating.tables``.

    ``others`` are the tables of the restaurant's other dishes, ``parent`` is the
    probability of the dish above. The draw is a hash of the dish and the sweep.
    """
    turn = np.uint64(((sweep + 1) * int(_SWEEP) + int(_STEP)) % 2**64)
    u = (mix(key + turn) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return tables(u, np.asarray(c, np.int64), strength + discount * np.asarray(others, np.float64), np.asarray(parent, np.float64), discount)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order in which they come, where each first is, and the number of every row's."""
    import pandas as pd

    number, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return distinct, first, number.astype(np.int32)


def _sum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.int64)


class Restaurants:
    """All of a shard's restaurants, from its trigrams, which may repeat: keys of u2's restaurants, u1 and w as codes, counts.

    ``row`` is the place of each given trigram among the distinct ones, x3 and x2
    are a trigram's restaurant and its parent, y is its dish in the parent.
    """

    def __init__(self, unit: np.ndarray, u1: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        dish = mix(w + _SWEEP)
        context = context_key(unit, u1)
        k3, first, self.row = _numbered(mix(context + dish))
        self.c3 = _sum(self.row, c, len(k3))
        context, unit, dish, w = context[first], unit[first], dish[first], w[first]
        units, _, self.x2 = _numbered(unit)
        contexts, _, self.x3 = _numbered(context)
        self.n2, self.n3 = len(units), len(contexts)
        del context, contexts
        self.k2, first, self.y = _numbered(mix(unit + dish))
        self.w, self.of = w[first], self.x2[first]
        self.big = np.flatnonzero(self.c3 > 1)  # a single customer has one table whatever comes
        self.k3 = k3[self.big]
        self.t3 = (self.c3 > 0).astype(np.int64)
        self.C3 = _sum(self.x3, self.c3, self.n3)
        self.c2 = _sum(self.y, self.t3, len(self.k2))
        self.t2 = (self.c2 > 0).astype(np.int64)

    def sweep(self, number: int, root: np.ndarray, d: tuple[float, ...], s: tuple[float, ...]) -> None:
        """One sweep over both levels; ``root`` is the unigram probability of each dish of the upper one."""
        T2, C2 = _sum(self.of, self.t2, self.n2), _sum(self.of, self.c2, self.n2)
        if len(self.big):
            j = self.big
            y = self.y[j]
            x2 = self.of[y]
            above = (self.c2[y] - d[1] * self.t2[y] + (s[1] + d[1] * T2[x2]) * root[y]) / (s[1] + C2[x2])
            T3, before = _sum(self.x3, self.t3, self.n3), self.t3[j]
            now = seated(self.k3, self.c3[j], T3[self.x3[j]] - before, above, d[2], s[2], number)
            self.t3[j] = now
            np.add.at(self.c2, y, now - before)
        big = np.flatnonzero(self.c2 > 1)
        new = (self.c2 > 0).astype(np.int64)
        new[big] = seated(self.k2[big], self.c2[big], T2[self.of[big]] - self.t2[big], root[big], d[1], s[1], number)
        self.t2 = new

    def predictive(self, d: tuple[float, ...], s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of every distinct trigram: its probability is a + b times that of w in the unigram restaurant."""
        T3, T2, C2 = _sum(self.x3, self.t3, self.n3), _sum(self.of, self.t2, self.n2), _sum(self.of, self.c2, self.n2)
        back3, back2 = (s[2] + d[2] * T3) / (s[2] + self.C3), (s[1] + d[1] * T2) / (s[1] + C2)
        above = (self.c2 - d[1] * self.t2) / (s[1] + C2[self.of])
        b = back3[self.x3]
        a = (self.c3 - d[2] * self.t3) / (s[2] + self.C3)[self.x3] + b * above[self.y]
        return a, b * back2[self.x2]


def frozen_root(words: np.ndarray, frequent: np.ndarray, counts: np.ndarray, n: int, v: int, d: float, s: float) -> np.ndarray:
    """Unigram probabilities while the sweeps run."""
    rest = (n - counts.sum()) / max(v - len(frequent), 1)
    c = np.full(len(words), max(float(rest), 1.0))
    if len(frequent):
        slot = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        c = np.where(frequent[slot] == words, counts[slot].astype(np.float64), c)
    return (c - d + (s + d * v) / (v + 1)) / (s + max(n, 1))


def shortened(x: np.ndarray, mantissa: int) -> np.ndarray:
    """Single precision, rounded to so many bits of the mantissa: what is equal up to there compresses."""
    cut = 23 - mantissa
    bits = x.astype(np.float32).view(np.uint32)
    return bits.view(np.float32) if cut <= 0 else ((bits + np.uint32(1 << (cut - 1))) >> np.uint32(cut) << np.uint32(cut)).view(np.float32)


def _sampled(d: tuple[float, ...], s: tuple[float, ...], burn: int, samples: int, mantissa: int, bits: int, hot: np.ndarray, buckets: np.ndarray, frequent: np.ndarray, counts: np.ndarray, n: int, v: int):
    """Seats the restaurants of a shard; sends their state back to flushes, and tables by word to the parts of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groups_of(batches):
            held: list[list[np.ndarray]] = [[], [], [], []]
            for row in rows:
                vocab = unpacked(row[3], "<u8")[0]
                *words, c = unpacked(row[2], "<u4", "<u4", "<u4", "<u4")
                for x, y in zip(held, (*[vocab[x] for x in words], c), strict=True):
                    x.append(y)
            sizes, flushes = [len(x) for x in held[0]], [row[1] for row in rows]
            rows.clear()
            u2, u1, w, c = (np.concatenate(x) for x in held)
            del held
            unit = dealt_by(hot, buckets, u2, u1)
            del u2
            r = Restaurants(unit, u1, w, c)
            del unit, u1, w, c
            root = frozen_root(r.w, frequent, counts, n, v, d[0], s[0])
            words, at = np.unique(r.w, return_inverse=True)
            a, b, sums = np.zeros(len(r.c3)), np.zeros(len(r.c3)), []
            for k in range(burn + samples):
                r.sweep(k, root, d, s)
                if k >= burn:
                    for x, y in zip((a, b), r.predictive(d, s), strict=True):
                        x += y
                    sums.append(np.bincount(at, r.t2, len(words)).astype(np.uint64))
            a, b, row = shortened(a / samples, mantissa), shortened(b / samples, mantissa), r.row
            del r, root
            out, at = [], 0
            for p, x in zip(flushes, sizes, strict=True):
                mine = row[at : at + x]
                out.append((p, part, packed(np.zeros(x, np.uint8), a[mine], b[mine]), b""))
                at += x
            del a, b, row
            bounds = _bounds(words, bits)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a < b:
                    out.append((-1 - k, part, packed(words[a:b], *[x[a:b] for x in sums]), b""))
            for at in range(0, len(out), 64):
                yield _batch(out[at : at + 64])

    return run


def _parent(d: float, s: float, samples: int, v: int):
    """Seats the unigram restaurant over a part of the vocabulary; sends customers and tables of its words, samples added up, to every flush, and totals under p = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groups_of(batches):
            flushes = [(r[1], unpacked(r[2], "<u8")[0], unpacked(r[3], "|u1", "<u8")[1]) for r in rows if r[4] == 0]
            words = np.unique(np.concatenate([x for _, x, _ in flushes])) if flushes else np.zeros(0, np.uint64)
            held, known = np.zeros((samples, len(words)), np.int64), np.zeros((len(words), 2), np.int64)
            for r in rows:
                if r[4] == 1:
                    w, *tables = unpacked(r[2], "<u8", *["<u8"] * samples)
                    at = np.searchsorted(words, w)
                    for k, t in enumerate(tables):
                        held[k, at] += t.astype(np.int64)
            for k in range(samples):
                known[:, 1] += seated(mix(words + _STEP), held[k], np.full(len(words), max(v - 1, 0)), np.full(len(words), 1 / (v + 1)), d, s, k)
            known[:, 0] = held.sum(0)
            out = []
            for p, x, c in flushes:
                mine = known[np.searchsorted(words, x)].astype(np.uint64)
                out.append((p, part, packed(x, c, *mine.T), b""))
            out.append((-1, part, packed(np.zeros(2, np.uint8), known.sum(0).astype(np.uint64)), b""))
            yield _batch(out)

    return run


def _scored(bits: int, hot: np.ndarray, buckets: np.ndarray, n: int, v: int, totals: list[int], samples: int, d: float, s: float, with_tokens: bool):
    """Scores the documents of each flush. Rows: (p, kind, part, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches):
            by: list[list] = [[], [], []]
            for row in rows:
                by[row[1]].append(row[2:])
            by = [sorted(x, key=lambda y: y[0]) for x in by]
            if not by[0]:
                continue
            _, word = unpacked(by[0][0][1], "|u1", "<u4")
            word = word[1:].astype(np.int64)
            _, ids, size, none = unpacked(by[0][0][2], "|u1", "<i8", "<i8", "|u1")
            vocab, c, customers, tables = (np.concatenate(x) for x in zip(*[unpacked(x[1], "<u8", "<u8", "<u8", "<u8") for x in by[1]], strict=True))
            a, b = (np.concatenate(x) for x in zip(*[unpacked(x[1], "|u1", "<f4", "<f4")[1:] for x in by[2]], strict=True))
            _, _, w, _, mine = trigrams(vocab, word, size, bits, hot, buckets)
            if len(w) != len(a) or len(vocab) != len(customers):
                raise RuntimeError("the documents came in another order than before; give the operator a table that reads the same each time")
            root = (customers.astype(np.float64) - d * tables + (samples * s + d * totals[1]) / (v + 1)) / (samples * s + totals[0])
            p = a + b * root[w]
            starts = np.r_[0, np.cumsum(size)[:-1]]
            each = np.log10(p)[mine]
            score = np.add.reduceat(each, starts)
            base = np.add.reduceat(np.log10((c + 1.0) / (n + v + 1))[word], starts)
            seen = np.add.reduceat((c > 0)[word].astype(np.int64), starts)
            names = [None if x else int(i) for i, x in zip(ids, none, strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array([held_out(i) for i in names], pa.bool_()), pa.array(size, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(names), n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            if with_tokens:
                columns.append(pa.array(np.split(each, starts[1:]), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] + ["token_scores"] * with_tokens)

    return run


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discounts: tuple[float, float, float] = (0.6, 0.8, 0.85), strengths: tuple[float, float, float] = (10.0, 1.0, 1.0),
    burn: int = 2, samples: int = 3, mantissa: int = 10, with_tokens: bool = False,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score[, token_scores]) of every row.

    Scores are log10 probabilities of whole texts, the end token included;
    10 ** (-score / n_tokens) is the perplexity. ``token_scores`` has one for each
    token. A null or empty text is the end token alone. Rows stay one to one;
    repeated rows train and are scored as often as they come; a null id is
    training text. An empty table gives an empty result. ``docs`` must read the
    same rows in the same order each time, as a scan of files does; this is
    checked. Words are told apart by hashes of 48 bits. ``discounts`` and ``strengths``
    are of the unigram restaurant, those of one word and those of two;
    ``burn`` sweeps are thrown away, ``samples`` more are averaged. What a context
    gives to a probability travels with ``mantissa`` bits: 10 make a token's score
    exact to 0.0003, 23 to single precision.
    """
    base, n_parts = id_text(docs, id_col, text_col), max(partitions(docs), 1)
    bits = max(n_parts - 1, 1).bit_length()
    nothing = np.zeros(0, np.uint64)

    def dealt(df: DataFrame, key: str, *more: str) -> DataFrame:
        return df.repartition(n_parts, key).sortWithinPartitions(key, *more)

    words = base.mapInArrow(tidy(_send("words", bits, nothing, nothing)), ROWS)
    counted = cut(dealt(words, "part", "p").mapInArrow(tidy(_counted), ROWS))
    release(docs.sparkSession)
    n = v = 0
    for row in counted.where("p = -2").select("a").toLocalIterator():  # a row for each part
        x = unpacked(bytes(row["a"]), "|u1", "<u8")[1]
        n, v = n + int(x[0]), v + int(x[1])
    often = counted.where("p = -1").select("a").mapInArrow(_frequent(n), "word long, n long")
    top = sorted((int(np.int64(r["word"]).view(np.uint64)), r["n"]) for r in often.toLocalIterator())  # fewer than FREQUENT words
    frequent, counts = np.array([w for w, _ in top], np.uint64), np.array([c for _, c in top], np.int64)
    split = [(w, 1 << (c * HOT // max(n, 1)).bit_length()) for w, c in top if c * HOT > n]
    hot, buckets = np.array([w for w, _ in split], np.uint64), np.array([b for _, b in split], np.uint64)

    grams = base.mapInArrow(tidy(_send("trigrams", bits, hot, buckets)), ROWS)
    sampled = cut(dealt(grams, "part", "p").mapInArrow(tidy(_sampled(discounts, strengths, burn, samples, mantissa, bits, hot, buckets, frequent, counts, n, v)), ROWS))
    release(docs.sparkSession)
    sums = sampled.where("part < 0").selectExpr("-1 - part as part", "p", "a", "b", "1 as kind")
    vocabularies = counted.where("p >= 0").selectExpr("part", "p", "a", "b", "0 as kind")
    parent = cut(dealt(vocabularies.unionByName(sums), "part", "kind", "p").mapInArrow(tidy(_parent(discounts[0], strengths[0], samples, v)), ROWS))
    discard(counted)
    release(docs.sparkSession)
    totals = [0, 0]
    for row in parent.where("part = -1").select("a").toLocalIterator():
        totals = [a + int(b) for a, b in zip(totals, unpacked(bytes(row["a"]), "|u1", "<u8")[1], strict=True)]

    tokens = base.mapInArrow(tidy(_send("tokens", bits, nothing, nothing)), ROWS).selectExpr("p", "0 as kind", "part", "a", "b")
    back = tokens.unionByName(parent.where("part >= 0").selectExpr("part as p", "1 as kind", "p as part", "a", "b"))
    back = back.unionByName(sampled.where("part >= 0").selectExpr("part as p", "2 as kind", "p as part", "a", "b"))
    run = _scored(bits, hot, buckets, n, v, totals, samples, discounts[0], strengths[0], with_tokens)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", token_scores array<double>" * with_tokens
    return dealt(back, "p", "kind", "part").mapInArrow(tidy(run), schema)
