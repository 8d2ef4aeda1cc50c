"""Removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every window of ``length`` bytes has an anchor, the least hash among the
``ANCHOR``-byte strings inside it, so equal windows have equal anchors and lie
equally around them. Runs of windows whose anchors have one hash are cut out as
segments (each window is in exactly one) and dealt to shards by that hash; so a
periodic stretch is one run, cut into pieces of a fixed size of which most are
the same. An anchor that only one segment has, at one place, cannot repeat a
window. The distinct segments of the others, weighted by how often they occur,
are suffix-sorted in batches; a group too large for a batch is divided by what
stands around its anchors;
breadth-first backward extension on the transform of a batch gives the boundaries
between suffixes that share fewer than ``length`` bytes, by increasing number of
shared bytes, and stops there. What no boundary parts has a window in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import cut, groups_of, id_text, packed, partitions, rows_of, tidy, unpacked
from speechmill.llm.shingles import _BASE, _BYTE, mix
from speechmill.sources.shared import release

#: A run of more windows than PIECE is cut there.
ANCHOR, CHUNK, FLUSH, BATCH, PIECE = 64, 1 << 20, 8_000_000, 600_000, 1024
#: A string around more than one in SHARE anchors, and at least LEAST of them, of one in EVERY documents is frequent.
SHARE, LEAST, EVERY = 1000, 8, 16
#: Set in a segment's size if its windows have anchors at several places.
MANY = np.uint32(1 << 31)
ROWS = "part long, p long, a binary, b binary"


def _gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by doubling."""
    power = lambda n: np.uint64(pow(_BASE, n, 2**64))
    by, size = {1: _BYTE[a]}, 1
    while size * 2 <= k:
        h = by[size]
        by[size * 2] = h[:-size] * power(size) + h[size:]
        size *= 2
    h, have = by[size], size
    while have < k:
        more = 1 << ((k - have).bit_length() - 1)
        n = len(h) - more
        h = h[:n] * power(more) + by[more][have : have + n]
        have += more
    return mix(h)


class Often:
    """Strings that are anchors only of windows that have no others: found often, so their windows would meet in one task."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where in ``h`` they are."""
        some = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        return some[self.hashes[at] == h[some]]


def _least(a: np.ndarray, length: int, k: int, often: Often | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the place of its anchor, and all hashes. Of equal ones the first counts; frequent strings come after all others."""
    h = _gram_hashes(a, k)
    low = np.uint64(0xFFFFFFFF)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    if often is not None:
        late = often.places(h)
        m = ((h >> np.uint64(1)) & ~low) | np.arange(len(h), dtype=np.uint64)
        m[late] |= np.uint64(1 << 63)
    w, size = length - k + 1, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    return (m & low).astype(np.int64), h


def anchors(a: np.ndarray, length: int, k: int, often: Often | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose anchors have one hash: first window, end, hash, and whether it has several places.

    ``a`` has at least ``length`` bytes. Least hashes are small, so they are mixed
    again to be spread over the parts.
    """
    at, h = _least(a, length, k, often)
    key = h[at]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(at)]
    if (end - start).max() > PIECE:
        count = -(-(end - start) // PIECE)
        first = np.cumsum(count) - count
        start = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(first, count)) * PIECE
        end = np.minimum(start + PIECE, np.repeat(end, count))
    return start, end, mix(key[start] + np.uint64(1)), at[start] != at[end - 1]


def divided(s: bytes, length: int, k: int, width: int) -> list[tuple[tuple[int, bytes], int, int]]:
    """Runs of a segment's windows by where their anchor lies, ``width`` places at a time: key, first window, end.

    The key has all bytes that every window with such an anchor has, so equal
    windows have equal keys. With a width of 1 it is the window.
    """
    at, _ = _least(np.frombuffer(s, np.uint8), length, k)
    band = (at - np.arange(len(at))) // width
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (band[1:] != band[:-1])])
    out = []
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        j, p = int(band[lo]), int(at[lo])
        left, right = j * width, max(length - k - (j * width + width - 1), 0)
        out.append(((j, s[p - left : p + k + right]), lo, hi))
    return out


class Flush:
    """The texts of a flush as one buffer, and its segments in the order of their anchors."""

    def __init__(self, ids: list, data: list[bytes], length: int, k: int, often: Often | None = None) -> None:
        self.ids, self.size = ids, np.array([len(d) for d in data], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.buffer = np.frombuffer(b"".join(data), np.uint8)
        starts, ends, hashes, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for d in np.flatnonzero(self.size >= length):
            first, last = int(self.begin[d]), int(self.begin[d + 1]) - length + 1
            for c in range(first, last, CHUNK):
                stop = min(c + CHUNK, last)
                s, e, h, m = anchors(self.buffer[c : stop + length - 1], length, k, often)
                many.append(m)
                starts.append(s + c)
                ends.append(e + c)
                hashes.append(h)
        start, end, h = map(np.concatenate, (starts, ends, hashes))
        order = np.argsort(h, kind="stable")
        self.start, self.end, self.hash, self.many = start[order], end[order], h[order], np.concatenate(many)[order]


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _bounds(h: np.ndarray, bits: int) -> np.ndarray:
    inner = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    return np.r_[0, inner, len(h)].astype(np.int64)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    from pyspark import TaskContext

    context = TaskContext.get()
    p = (context.partitionId() if context else 0) << 24
    ids, data, held = [], [], 0
    for some, texts in rows_of(batches):
        for i, t in zip(some, texts, strict=True):
            ids.append(i)
            data.append(t.encode())
            held += len(data[-1]) + 16
            if held >= FLUSH:
                yield p, ids, data
                ids, data, held, p = [], [], 0, p + 1
    if ids:
        yield p, ids, data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["part", "p", "a", "b"])


def _frequent(length: int, k: int):
    """(hash, n) of the strings that frequent anchors of a flush have around them, with estimates of how many windows' anchors they would be; (null, n) are all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _flushes(batches):
            pieces = [np.frombuffer(d, np.uint8)[c : c + CHUNK + length - 1] for d in data if len(d) >= length for c in range(0, len(d) - length + 1, CHUNK)]
            places, keys = [], []
            for a in pieces:
                at, h = _least(a, length, k)
                key = h[at]
                runs = np.r_[True, key[1:] != key[:-1]]
                places.append(at[runs])
                keys.append(key[runs])
            if not pieces:
                continue
            _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            hot = (count * SHARE > len(inverse)) & (count > 3)
            near = [np.zeros(0, np.uint64)]
            for a, at, mine in zip(pieces, places, np.split(hot[inverse], np.cumsum([len(x) for x in places])[:-1]), strict=True):
                if mine.any():
                    h, at = _gram_hashes(a, k), at[mine]
                    for some in np.split(at, range(4096, len(at), 4096)):
                        around = some[:, None] + np.arange(-(length - k), length - k + 1)
                        near.append(h[around[(around >= 0) & (around < len(h))]])
            h, n = np.unique(np.concatenate(near), return_counts=True)
            often = n * SHARE > len(inverse)
            h, n = h[often], n[often]
            yield pa.RecordBatch.from_arrays([pa.array([None, *h.view(np.int64).tolist()], pa.int64()), pa.array([len(inverse), *n.tolist()], pa.int64())], ["hash", "n"])

    return run


def frequent_strings(base: DataFrame, length: int, k: int) -> Often | None:
    """Strings that would be anchors of more than one in ``SHARE`` runs of windows.

    Told from one in ``EVERY`` documents: which strings these are decides only in
    which task windows meet, never what is removed. Their number is bounded by
    ``SHARE`` times the strings around an anchor.
    """
    some = base.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(EVERY)) == 0)
    counts = some.mapInArrow(tidy(_frequent(length, k)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.where("hash is null").agg(F.sum("n")).first()[0] or 0
    found = [r[0] for r in counts.where((F.col("hash").isNotNull()) & (F.col("n") * SHARE > total) & (F.col("n") >= LEAST)).select("hash").collect()]  # bounded, see above
    return Often(np.array(found, np.int64).view(np.uint64)) if found else None


def _segments(length: int, k: int, bits: int, often: Often | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, ids, data in _flushes(batches):
            f = Flush(ids, data, length, k, often)
            at = _bounds(f.hash, bits)
            for part, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a < b:
                    size = f.end[a:b] - f.start[a:b] + length - 1
                    ends = np.cumsum(size)
                    spot = np.arange(ends[-1], dtype=np.int32) + np.repeat((f.start[a:b] - (ends - size)).astype(np.int32), size)
                    yield _batch([(part, p, packed(f.hash[a:b], size.astype(np.uint32) | np.where(f.many[a:b], MANY, np.uint32(0))), _zip(f.buffer[spot].tobytes()))])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, ids, data in _flushes(batches):
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        none = np.array([i is None for i in ids], np.uint8)
        yield _batch([(-1, p, packed(np.zeros(len(ids), np.uint8), numbers, np.array([len(d) for d in data], np.int64), none), _zip(b"".join(data)))])


def suffix_order(symbols: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling on what is still tied.

    A suffix ends with its segment; ``left`` has how many symbols it has, the
    segment's end mark (symbol 0) included. Suffixes alike up to their end marks
    are in the order of their segments.
    """
    n, width = len(symbols), 7
    padded = np.r_[symbols, np.zeros(width, symbols.dtype)]
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << 9) | np.where(left > j, padded[j : j + n], np.int16(0))
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int32)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = width
    while h < longest:
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        sub = sa[tied]
        more = left[sub] > h
        key = rank[sub].astype(np.int64) * (n + 1)
        key[more] += rank[sub[more] + h] + 1
        order = np.argsort(key, kind="stable")
        sub, key = sub[order], key[order]
        sa[tied] = sub
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[tied] = fresh
        rank[sub] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h *= 2
    inverse = np.empty(n, np.int32)
    inverse[sa] = np.arange(n, dtype=np.int32)
    return sa, inverse


def boundaries(sa: np.ndarray, inverse: np.ndarray, symbols: np.ndarray, marks: int, length: int) -> np.ndarray:
    """True at i where suffixes i - 1 and i share fewer than ``length`` symbols.

    Breadth-first: the intervals of all strings of one size are extended to the
    left together, and a string of size n parts its interval from the next where
    no shorter one did. Rows below ``marks`` begin with end marks.
    """
    n = len(sa)
    done = np.zeros(n + 1, bool)
    done[: marks + 1] = True
    before = np.where(sa > 0, symbols[sa - 1], 0)
    open_ = before > 0  # an end mark before it: nothing to extend by
    lf = np.where(open_, inverse[np.maximum(sa - 1, 0)], np.int32(-1))
    first = symbols[sa]
    follows = np.full(n, n, np.int32)  # the next row with the same symbol before it
    rows = np.flatnonzero(open_)
    r = lf[rows]
    same = (r + 1 < n) & (first[np.minimum(r + 1, n - 1)] == first[r])
    follows[rows[same]] = inverse[sa[r[same] + 1] + 1]
    precedes = np.full(n, -1, np.int32)
    ok = follows < n
    precedes[follows[ok]] = np.flatnonzero(ok)
    lo, hi = np.r_[0, np.arange(marks)], np.r_[n - 1, np.arange(marks)]
    whole = True  # at size 0 there is the empty string alone, and the end marks from size 1 on
    for _ in range(length):
        if whole:
            lo_now, hi_now = lo[:1], hi[:1]
        else:
            lo_now, hi_now = lo, hi
        one = lo_now == hi_now
        j = lo_now[one]
        j = j[open_[j]]
        a1 = b1 = lf[j]
        a, b = lo_now[~one], hi_now[~one]
        if len(a):
            size = b - a + 1
            ends = np.cumsum(size)
            spot = np.arange(ends[-1], dtype=np.int32) + np.repeat((a - (ends - size)).astype(np.int32), size)
            owner = np.repeat(np.arange(len(a), dtype=np.int32), size)
            keep = open_[spot]
            spot, owner = spot[keep], owner[keep]
            last, head = follows[spot] > b[owner], precedes[spot] < a[owner]
            tail_rows, head_rows = lf[spot[last]], lf[spot[head]]
            ot = np.argsort(owner[last].astype(np.int64) * 512 + first[tail_rows], kind="stable")
            oh = np.argsort(owner[head].astype(np.int64) * 512 + first[head_rows], kind="stable")
            a2, b2 = head_rows[oh], tail_rows[ot]
            a1, b1 = np.r_[a1, a2], np.r_[b1, b2]
        fresh = ~done[b1 + 1]
        done[b1[fresh] + 1] = True
        if whole:
            lo, hi, whole = np.r_[a1[fresh], lo[1:]], np.r_[b1[fresh], hi[1:]], False
        else:
            lo, hi = a1[fresh], b1[fresh]
        if not len(lo):
            break
    return done[:n]


def repeated(segments: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice or more, weights counted."""
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.r_[0, np.cumsum(sizes + 1)]
    symbols = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8).astype(np.int16) + np.int16(1)
    symbols[begin[1:] - 1] = 0
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes + 1)
    left = (begin[1:][owner] - np.arange(len(symbols))).astype(np.int32)
    sa, inverse = suffix_order(symbols, left, int(sizes.max()) + 1)
    parted = boundaries(sa, inverse, symbols, len(segments), length)
    parted[0] = True
    group = np.cumsum(parted) - 1
    total = np.bincount(group, np.array(weights, np.float64)[owner[sa]])
    often = np.zeros(len(symbols), bool)
    often[sa] = (total >= 2)[group]
    return [often[b : b + max(s - length + 1, 0)] for b, s in zip(begin[:-1], sizes, strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


class Matcher:
    """Runs of windows that occur elsewhere, for segments that are given a group at a time."""

    def __init__(self, length: int, k: int, batch: int = BATCH) -> None:
        self.length, self.k, self.batch = length, k, batch
        self.found: dict[int, list[tuple[int, int]]] = {}
        self.text: list[bytes] = []
        self.weight: list[int] = []
        self.members: list[list[tuple[int, int]]] = []
        self.held = 0

    def _mark(self, who: list[tuple[int, int]], runs: list[tuple[int, int]]) -> None:
        for i, at in who:
            self.found.setdefault(i, []).extend((at + lo, at + hi) for lo, hi in runs)

    def settle(self) -> None:
        if self.text:
            for mask, who in zip(repeated(self.text, self.weight, self.length), self.members, strict=True):
                if mask.any():
                    self._mark(who, [(int(a), int(b)) for a, b in zip(*_runs(mask), strict=True)])
        self.text, self.weight, self.members, self.held = [], [], [], 0

    def add(self, group: dict[bytes, list[tuple[int, int]]], many: bool, width: int = 0) -> None:
        """Distinct segments with one key and who has them; ``many``: one of them may repeat a window by itself."""
        if len(group) == 1:
            (s, who), = group.items()
            if len(who) > 1:  # all alike: nothing to compare
                return self._mark(who, [(0, len(s) - self.length + 1)])
            if not many:
                return None
        size = sum(map(len, group))
        if size > self.batch and width != 1:
            return self._divide(group, 1 if width else max((self.length - self.k) // 8, 1))
        if self.held and self.held + size > self.batch:
            self.settle()
        for s, who in group.items():
            self.text.append(s)
            self.weight.append(len(who))
            self.members.append(who)
        self.held += size
        return None

    def _divide(self, group: dict[bytes, list[tuple[int, int]]], width: int) -> None:
        """A group too large for a batch, by smaller keys; a key of the smallest ones is a window, so none is too large again."""
        parts: dict[tuple[int, bytes], dict[bytes, list[tuple[int, int]]]] = {}
        for s, who in group.items():
            for key, lo, hi in divided(s, self.length, self.k, width):
                parts.setdefault(key, {}).setdefault(s[lo : hi + self.length - 1], []).extend((i, at + lo) for i, at in who)
        for part in parts.values():
            self.add(part, False, width)


def _matched(length: int, k: int):
    """For each segment that a flush sent, the runs of its windows that occur elsewhere, in the order it sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groups_of(batches):
            heads = [unpacked(r[2], "<u8", "<u4") for r in rows]
            data = [_unzip(r[3]) for r in rows]
            count = np.array([len(h) for h, _ in heads])
            h, size = (np.concatenate([x[j] for x in heads]) for j in (0, 1))
            many, size = size >= MANY, (size & ~MANY).astype(np.int64)
            source = np.repeat(np.arange(len(rows)), count)
            ends = np.concatenate([np.cumsum(x) for x in np.split(size, np.cumsum(count)[:-1])])
            order = np.argsort(h, kind="stable")
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            shared = order[~(new & np.r_[new[1:], True]) | many[order]]
            matcher = Matcher(length, k)
            group: dict[bytes, list[tuple[int, int]]] = {}
            some = False
            for i, after in zip(shared.tolist(), [*shared[1:].tolist(), -1], strict=True):
                e = int(ends[i])
                group.setdefault(data[source[i]][e - int(size[i]) : e], []).append((i, 0))
                some = some or bool(many[i])
                if after < 0 or h[after] != h[i]:
                    matcher.add(group, some)
                    group, some = {}, False
            matcher.settle()
            out, at = [], 0
            for r, n in zip(rows, count.tolist(), strict=True):
                hits = [(j, lo, hi) for j in range(n) for lo, hi in matcher.found.get(at + j, ())]
                who, a, b = np.array(hits, np.int64).reshape(-1, 3).T
                out.append((r[1], part, packed(who.astype(np.uint64), a.astype(np.uint32), b.astype(np.uint32)), np.array([n, 0], np.int64).tobytes()))
                at += n
            yield _batch(out)

    return run


def _removed(length: int, k: int, bits: int, with_text: bool, often: Often | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches):
            texts = [r for r in rows if r[1] == 0]
            if not texts:
                continue
            _, ids, size, none = unpacked(texts[0][3], "|u1", "<i8", "<i8", "|u1")
            whole = _unzip(texts[0][4])
            at = np.r_[0, np.cumsum(size)]
            f = Flush([], [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], length, k, often)
            cuts = _bounds(f.hash, bits)
            change = np.zeros(len(whole) + 1, np.int32)
            for r in rows:
                if r[1] == 1:
                    a, b = cuts[r[2]], cuts[r[2] + 1]
                    if b - a != np.frombuffer(r[4], np.int64)[0]:
                        raise RuntimeError("the documents came in another order than before; give the operator a table that reads the same each time")
                    who, lo, hi = unpacked(r[3], "<u8", "<u4", "<u4")
                    start = f.start[a:b][who.astype(np.int64)]
                    np.add.at(change, start + lo, 1)
                    np.add.at(change, start + hi + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            names, n_removed, n_spans, shas, kept = [], [], [], [], []
            for d in range(len(size)):
                g = gone[at[d] : at[d + 1]]
                n = int(np.count_nonzero(g))
                b = whole[at[d] : at[d + 1]]
                if n:
                    n_spans.append(len(_runs(g)[0]))
                    b = f.buffer[at[d] : at[d + 1]][~g].tobytes()
                else:
                    n_spans.append(0)
                names.append(None if none[d] else int(ids[d]))
                n_removed.append(n)
                shas.append(hashlib.sha256(b).hexdigest())
                if with_text:
                    kept.append(b)
            cols = [pa.array(names, pa.int64()), pa.array(size, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Every byte that a string of ``length`` bytes covers which also starts anywhere
    else, in this or another row, is removed; strings never cross rows. ``kept``
    is binary: what is left need not be valid UTF-8. A null text counts as empty;
    shorter texts stay whole. Repeated rows repeat each other, so nothing of them
    but short texts stays. An empty table gives an empty result. ``docs`` must read
    the same rows in the same order each time, as a scan of files does; this is
    checked.
    """
    base, n = id_text(docs, id_col, text_col), max(partitions(docs), 1)
    bits, k = max(n - 1, 1).bit_length() + 1, min(anchor, length)
    often = frequent_strings(base, length, k)
    segments = base.mapInArrow(tidy(_segments(length, k, bits, often)), ROWS)
    matched = cut(segments.repartition(n, "part").sortWithinPartitions("part", "p").mapInArrow(tidy(_matched(length, k)), ROWS))
    release(docs.sparkSession)
    texts = base.mapInArrow(tidy(_texts), ROWS).selectExpr("p", "0 as kind", "part", "a", "b")
    back = texts.unionByName(matched.selectExpr("part as p", "1 as kind", "p as part", "a", "b"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return back.repartition(n, "p").sortWithinPartitions("p", "kind").mapInArrow(tidy(_removed(length, k, bits, with_text, often)), schema)
