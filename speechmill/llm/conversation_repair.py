"""Conversation structure repair: a dynamic programme over the turns that stay.

A repaired conversation is empty, or an optional system turn and pairs of user and
assistant. Turns are kept, given the other role, deleted, or empty ones inserted.
Between two turns that stay everything is deleted, which prefix sums price, and the
pair of their roles says how many turns have to be inserted. So a running minimum
for each role is all that the next turn that stays needs to know, from the last turn
to the first. Of equally cheap repairs the audit (the edits' initials in order) that
comes first in ASCII wins: in a gap deletions come before insertions, so it is the one
whose next turn that stays is farthest away, then the one with more insertions, then
keep before rerole.

A conversation is shuffled once, by its id, as narrow rows without text, which decide
its edits, followed by its turns in order, which are streamed through these decisions:
a task holds some 50 bytes for each turn of one conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import partitions, tidy

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Insertions between two roles that follow each other; what is not named cannot.
BETWEEN = ({SYSTEM: 0, USER: 0, ASSISTANT: 1}, {USER: 0, ASSISTANT: 1}, {USER: 1, ASSISTANT: 0}, {USER: 0, ASSISTANT: 1})
#: Insertions after the last turn that stays.
AT_END = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}

AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string, edit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that a checksum of id and turn chooses; nulls count as one space.

    Of 20 remainders 0 drops a turn, 1 empties its text, 2 removes its ``.!?``, 3
    repeats it, 4 makes it the user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("k") == 3, 2).otherwise(1)
    return rows.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def cheapest(initials: list[str], faults: bytes) -> tuple[int, bytearray, bytearray, int]:
    """The cheapest repair, of equals the one whose audit comes first.

    Returns its cost, for each turn its role if it stays (0: deleted), for each turn
    the insertions before it, and the insertions at the end.
    """
    n = len(initials)
    deletions = array("q", bytes(8 * (n + 1)))  # of the turns before each place
    for j in range(n):
        deletions[j + 1] = deletions[j] + DELETE_COST
    best: dict[int, tuple[int, int]] = {}  # of each role: cost from the first turn that has it on, plus deletions before; and that turn
    choice = [array("q", bytes(8 * (n + 1))) for _ in range(4)]  # 4 * turn + role of what stays next, or -1: nothing

    def onward(state: int, at: int) -> int:
        """The cost after a turn ``at - 1`` that stays with the role ``state``; notes what stays next."""
        cost, rank, found = deletions[n] + INSERT_COST * AT_END[state], (n, 0, 0), -1
        for role, inserted in BETWEEN[state].items():
            if role in best:
                total, turn = best[role][0] + INSERT_COST * inserted, best[role][1]
                mine = (turn, inserted, INITIAL.get(initials[turn]) == role)
                if total < cost or (total == cost and mine > rank):
                    cost, rank, found = total, mine, 4 * turn + role
        choice[state][at] = found
        return cost - deletions[at]

    for j in range(n - 1, -1, -1):
        if faults[j] in (BLANK, DUPLICATE):
            continue
        own, late = INITIAL.get(initials[j]), TRUNCATED_COST if faults[j] == TRUNCATED else 0
        stays = {role: (0 if role == own else REROLE_COST) + late for role in (SYSTEM, USER, ASSISTANT) if role == own or role != SYSTEM}
        totals = {role: deletions[j] + own_cost + onward(role, j + 1) for role, own_cost in stays.items()}
        for role, total in totals.items():
            if role not in best or total < best[role][0]:
                best[role] = (total, j)
    cost = onward(START, 0)
    roles, before = bytearray(n), bytearray(n)
    state, at = START, 0
    while (found := choice[state][at]) >= 0:
        turn, role = divmod(found, 4)
        roles[turn], before[turn] = role, BETWEEN[state][role]
        state, at = role, turn + 1
    return cost, roles, before, AT_END[state]


class _Conversation:
    """The narrow rows of one conversation, then its edits and what they leave."""

    def __init__(self) -> None:
        self.initials: list[str] = []
        self.faults = bytearray()
        self.seen: set[bytes] = set()
        self.first = self.last = None
        self.turns = 0
        self.decided = False

    def told(self, turn: int | None, initial: str, blank: bool, late: bool, digest: bytes) -> None:
        again = digest in self.seen
        self.seen.add(digest)
        self.faults.append(BLANK if blank else DUPLICATE if again else TRUNCATED if late else 0)
        self.initials.append(initial)
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def decide(self) -> None:
        self.cost, self.roles, self.before, self.end = cheapest(self.initials, bytes(self.faults))
        self.seen.clear()
        self.hash, self.place, self.at, self.state, self.decided, self.edits = hashlib.sha256(), 0, 0, START, True, []

    def _put(self, role: str, text: str, edit: str) -> tuple:
        if self.place:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.place += 1
        return self.place - 1, role, text, edit

    def _inserted(self, n: int) -> Iterator[tuple]:
        for _ in range(n):
            self.state = ASSISTANT if self.state == USER else USER
            yield self._put(NAME[self.state], "", "I")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        """What the next turn becomes, deletions aside."""
        i, stays = self.at, self.roles[self.at]
        self.at += 1
        if not stays:
            self.edits.append("D")
            return
        self.edits.append("I" * self.before[i])
        yield from self._inserted(self.before[i])
        kept = INITIAL.get(self.initials[i]) == stays
        self.edits.append("K" if kept else "R")
        self.state = stays
        yield self._put(role if kept else NAME[stays], text, self.edits[-1])

    def ended(self) -> Iterator[tuple]:
        self.edits.append("I" * self.end)
        yield from self._inserted(self.end)

    def audit(self) -> tuple:
        f = self.faults
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        illegal = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:], strict=False))
        return gaps, f.count(BLANK), f.count(DUPLICATE), f.count(TRUNCATED), illegal, self.cost, "".join(self.edits), self.hash.hexdigest()


def _repaired(want_turns: bool):
    """Rows of partitions sorted by conversation, phase and turn: (conv_id, phase, turn, role, text, blank, late, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if want_turns else [*[pa.int64()] * 7, pa.string(), pa.string()]
        names = [c.split()[0] for c in (TURNS if want_turns else AUDIT).split(", ")]
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        held, now = None, None

        def add(rows: Iterator[tuple]) -> None:
            nonlocal size
            for row in rows:
                if want_turns:
                    out.append((now, *row))
                    size += 64 + len(row[2])

        def close() -> None:
            nonlocal size
            if held is not None:
                add(held.ended())
                if not want_turns:
                    out.append((now, *held.audit()))
                    size += 256 + len(out[-1][7])

        for b in batches:
            for conv, phase, turn, role, text, blank, late, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or conv != now:
                    close()
                    held, now = _Conversation(), conv
                if phase == 0:
                    held.told(turn, role[:1], blank, late, digest)
                else:
                    if not held.decided:
                        held.decide()
                    add(held.turn(role, text))
                if size > 4_000_000:
                    yield batch()
                    out, size = [], 0
        close()
        if out:
            yield batch()

    return run


def _streams(rows: DataFrame) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    said = read.select(
        "conv_id", "turn", "role", "text", F.md5("text").alias("tie"), (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"), (~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("late"),
        F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("digest"), F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"),
    )
    first = F.col("phase") == 0
    cols = [F.when(~first, F.col("text")).alias("text"), *[F.when(first, F.col(c)).alias(c) for c in ("blank", "late", "digest")]]
    dealt = said.select("conv_id", "phase", "turn", "role", *cols, "tie").repartition(max(partitions(rows), 1), "conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "tie")
    return dealt.drop("tie")


def repair_audits(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows are (conv_id, turn, role, text), whatever other columns there are; turns come
    in order, a null turn first, and rows of one turn by role and the MD5 of the text.
    A null role or text counts as one space, so such a text is blank; a repeated row
    is a duplicate; a null id is a conversation like others. Roles count by their
    first character. ``every`` names conversations that are in the result even
    without a row: zeros, an empty audit and the hash of an empty text. An empty
    table gives an empty result. Texts are streamed whole, however long.
    """
    done = _streams(rows).mapInArrow(tidy(_repaired(False)), AUDIT)
    if every is None:
        return done
    ids = every.select(F.col("conv_id").cast("long").alias("asked")).distinct()
    both = ids.join(done, F.col("asked").eqNullSafe(F.col("conv_id")), "left")
    empty = hashlib.sha256().hexdigest()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(F.col("asked").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations, places from 0.

    ``edit`` is K for a turn that was kept, R for one with another role, I for one
    that was inserted. The same cases as in :func:`repair_audits`; a conversation of
    which nothing stays has no rows.
    """
    return _streams(rows).mapInArrow(tidy(_repaired(True)), TURNS)
