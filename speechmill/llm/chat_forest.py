"""Chat formatting as a prefix tree: turns that conversations share at their start are written once.

1. A turn is formatted by a template; its control characters are escaped in texts, so
   the format can be read back. A conversation's path is the MD5 of each formatted
   turn, one after another; equal paths are one entity from there on.
2. Sorted by path, conversations come in the depth-first order of the tree: what one
   has in common with the one before is their common ancestors, and only the rest
   is new. This needs paths and lengths, not texts. The running sum of what is new
   cuts the order into sequences of about ``window`` characters.
3. Texts of new turns go to their sequence, once each. There every turn gets its
   offset, its position (the length of its ancestors) and the intervals of the sequence
   that it attends to: its ancestors, and itself up to the token in question. A
   sequence repeats the ancestors that it needs, once, so none depends on another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmill.llm.common import cut, join_skewed, partitions, tidy

OPEN, CLOSE, BETWEEN = "### ", "</turn>\n", "\n"
ASSISTANT = "assistant"
WINDOW = 1 << 16
#: Fixed values of the template: what stands for a backslash, a sharp, a less-than sign and, in roles, a line feed.
ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
IN_ROLES = (*ESCAPES, ("\n", "\\n"))
_BACK = {"\\": "\\", "h": "#", "l": "<", "n": "\n"}
#: The characters of a path that stand for one turn: an MD5 in bytes.
STEP = 16

EMITTED = "sequence long, at long, length long, position long, depth int, text string, ids array<int>, loss_start long, loss_end long, attends array<struct<start:long,end:long>>, conversation long, key binary"
READ = "key binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column, role: bool = False) -> Column:
    for mark, code in IN_ROLES if role else ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role, True), F.lit(BETWEEN))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, head, body, digest, length, loss) of every turn; its format is head, body and ``CLOSE``."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    made = read.select("conv_id", "turn", head(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == ASSISTANT).alias("loss"))
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    return made.select("conv_id", "turn", "head", "body", F.unhex(F.md5(F.concat("head", "body"))).alias("digest"), length.cast("long").alias("length"), "loss")


def _paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, lengths, key): a narrow row a conversation; turns in order, a null turn first, those of one turn by their MD5."""
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn").isNotNull()).alias("has"), "turn", "digest", "length"))).alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    return gathered.select("conv_id", path.alias("path"), F.transform("t", lambda x: x["length"]).alias("lengths")).withColumn("key", F.unhex(F.md5("path")))


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their start."""
    n = min(len(a), len(b)) // STEP
    differ = np.flatnonzero((np.frombuffer(a, np.uint8, n * STEP) != np.frombuffer(b, np.uint8, n * STEP)))
    return int(differ[0]) // STEP if len(differ) else n


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of (part, path, lengths, ...) sorted by path: its first and last row, and the characters that are new in it if nothing is known."""
    part = first = last = None
    count = new = 0
    for b in batches:
        for p, path, lengths in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            mine = sum(lengths[_common(last[0], path):]) if last else sum(lengths)
            part, last, count, new = p, (path, mine), count + 1, new + mine
            first = first or (path, lengths)
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([new], pa.int64()), pa.array([first[0]], pa.binary()), pa.array([first[1]], pa.list_(pa.int64())), pa.array([last[0]], pa.binary()), pa.array([last[1]], pa.int64())], ["part", "count", "new", "first", "lengths", "last", "last_new"])


def _placed(starts: dict[int, tuple[int, int, int]], window: int):
    """(representative, sequence, start, shared, turns, key) of every distinct conversation; ``shared`` turns are in its sequence already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        start = sequence = shared = 0
        for b in batches:
            out = []
            for p, path, lengths, representative, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None:
                    start, shared, sequence = starts[p]
                else:
                    shared = _common(last, path)
                mine = start // window
                out.append((representative, mine, start, shared if mine == sequence else 0, len(lengths), key))
                start, sequence, last = start + sum(lengths[shared:]), mine, path
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 5, pa.binary()), strict=True)], ["representative", "sequence", "start", "shared", "turns", "key"])

    return run


def _order(distinct: DataFrame, window: int) -> DataFrame:
    """Depth-first order and sequences of distinct paths; the driver gets the ends of each partition."""
    n = max(partitions(distinct), 1)
    dealt = cut(distinct.repartitionByRange(n, "path").sortWithinPartitions("path"))
    dealt = dealt.select(F.spark_partition_id().alias("part"), "path", "lengths", "representative", "key")
    ends = dealt.mapInArrow(tidy(_ends), "part int, count long, new long, first binary, lengths array<long>, last binary, last_new long")
    starts: dict[int, tuple[int, int, int]] = {}
    start, path, sequence = 0, b"", -1
    for r in sorted(ends.collect()):  # a row for each partition, of which the part comes first
        shared = _common(path, bytes(r["first"]))
        again = sum(r["lengths"][:shared])
        starts[r["part"]] = (start, shared, sequence)
        start += r["new"] - again
        path, sequence = bytes(r["last"]), (start - r["last_new"] + (again if r["count"] == 1 else 0)) // window
    return dealt.mapInArrow(tidy(_placed(starts, window)), "representative long, sequence long, start long, shared long, turns long, key binary")


def _emit(tokenizer: str | None):
    """The turns of each sequence in order, with their places: see :func:`chat_forest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer) if tokenizer else None
        sequence, at, stack = None, 0, []  # of each open turn: start, length
        names = [c.split()[0] for c in re.split(r", (?=[a-z_]+ )", EMITTED)]
        types = [pa.int64()] * 4 + [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.binary()]
        for b in batches:
            out = []
            for s, place, begin, body, loss, representative, turns_, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != sequence:
                    sequence, at, stack = s, 0, []
                del stack[place:]
                parts = (begin, body, CLOSE)
                ids = [encode(p) for p in parts] if encode else None
                lengths = [len(p) for p in ids or parts]
                attends: list[list[int]] = []
                for a, n in stack:  # neighbours are one interval
                    if attends and attends[-1][1] == a:
                        attends[-1][1] = a + n
                    else:
                        attends.append([a, a + n])
                masked = at + lengths[0]
                out.append((
                    s, at, sum(lengths), sum(n for _, n in stack), place, "".join(parts), sum(ids, []) if ids else None, masked if loss else None, masked + lengths[1] if loss else None,
                    [{"start": a, "end": e} for a, e in attends], representative if place + 1 == turns_ else None, key if place + 1 == turns_ else None,
                ))
                stack.append((at, sum(lengths)))
                at += sum(lengths)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _encoder(path: str) -> Callable[[str], list[int]]:
    from speechmill.llm.common import single_threaded

    single_threaded()
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return lambda text: coder.encode(text, add_special_tokens=False).ids


def _distinct(paths: DataFrame) -> DataFrame:
    return paths.groupBy("key").agg(F.first("path").alias("path"), F.first("lengths").alias("lengths"), F.min("conv_id").alias("representative"), F.count(F.lit(1)).alias("copies"))


def _forest(rows: DataFrame, distinct: DataFrame, window: int, tokenizer: str | None) -> DataFrame:
    named = lambda c: (F.col(c).isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("own"))  # noqa: E731 - keys that equal each other, so that turns are numbered and joined in one shuffle
    order = _order(distinct, window).select(*named("representative"), "*")
    numbered = rows.select(*named("conv_id"), "turn", "head", "body", "digest", "loss").withColumn("place", F.row_number().over(Window.partitionBy("none", "own").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1)
    new = numbered.join(order, ["none", "own"]).where("place >= shared")
    dealt = new.repartition(max(partitions(rows), 1), "sequence").sortWithinPartitions("sequence", "start", "place")
    return dealt.select("sequence", F.col("place").cast("int"), "head", "body", "loss", "representative", "turns", "key").mapInArrow(tidy(_emit(tokenizer)), EMITTED)


def chat_forest(conversations: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """The turns of all sequences, depth first: a row for each turn, once for all conversations of its sequence that share it.

    ``at`` and ``length`` are its place in the sequence in characters, or in ids of
    ``tokenizer`` (a tokenizer's file; head, body and end are encoded apart, and ``ids``
    has them); ``position`` is the position id of its first token, the next ones
    follow; ``attends`` are the intervals of its ancestors, next to which a token
    attends to its own turn up to itself; ``loss_start`` and ``loss_end`` bound the
    text of an assistant, else null. ``conversation`` and ``key`` name the one that
    ends with the turn: the least id of those with these turns, and their digest.

    A sequence begins with the next conversation after every ``window`` characters
    of new turns, with all its turns; a conversation is never cut. Null texts and
    roles are empty; a null id is a conversation like others; repeated rows are turns
    of their own, and rows of one turn come by the MD5 of their format; texts are
    read whole; other columns do not matter; an empty table gives an empty result.
    Conversations are told apart by the MD5 of their turns.
    """
    rows = turns(conversations)
    return _forest(rows, cut(_distinct(_paths(rows))), window, tokenizer)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of :func:`chat_forest` in characters, sequence by sequence: each conversation from the intervals that its last turn attends to."""
    turn = re.compile(f"{re.escape(OPEN)}([^\n]*){BETWEEN}([^<]*){re.escape(CLOSE)}")
    sequence, held, starts, masks = None, [], [], {}
    for b in batches:
        cols = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("sequence", "at", "length", "text", "loss_start", "loss_end", "attends", "key")}
        out = []
        for s, at, length, text, loss_start, loss_end, attends, key in zip(*cols.values(), strict=True):
            if s != sequence:
                sequence, held, starts, masks = s, [], [], {}
            held.append(text)
            starts.append(at)
            if loss_start is not None:
                masks[at] = (loss_start, loss_end)
            if key is None:
                continue
            whole, loss, loss_chars, n, digest, formatted = [], hashlib.sha256(), 0, 0, hashlib.sha256(), 0
            for start, end in [*((i["start"], i["end"]) for i in attends), (at, at + length)]:
                k = int(np.searchsorted(starts, start))
                while k < len(starts) and starts[k] < end:
                    whole.append(held[k])
                    if starts[k] in masks:
                        a, e = masks[starts[k]]
                        said = unescaped(held[k][a - starts[k] : e - starts[k]])
                        loss.update(said.encode())
                        loss_chars += len(said)
                    k += 1
            text = "".join(whole)
            spot = 0
            while spot < len(text):
                m = turn.match(text, spot)
                if not m:
                    raise ValueError("a sequence that is not in the format of its template")
                digest.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                n, spot = n + 1, m.end()
            out.append((key, n, digest.hexdigest(), loss_chars, loss.hexdigest(), len(text)))
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], [c.split()[0] for c in READ.split(", ")])


def round_trip(conversations: DataFrame, window: int = WINDOW) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from :func:`chat_forest`.

    ``turns_sha256`` is of role, line feed, text, line feed of all turns, ``loss_sha256``
    of all text under the loss mask, both unescaped; the cases of :func:`chat_forest`.
    """
    rows = turns(conversations)
    paths = cut(_paths(rows))
    distinct = cut(_distinct(paths))
    told = cut(_forest(rows, distinct, window, None).mapInArrow(tidy(read_back), READ)).join(distinct.select("key", "copies"), "key")
    named = join_skewed(paths.select("conv_id", "key"), told, "key", "copies", paths.count())
    return named.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
