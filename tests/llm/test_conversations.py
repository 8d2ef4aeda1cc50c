"""Conversation repair, the chat forest and fill-in-middle against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from speechmill.llm import chat_forest as cf
from speechmill.llm import conversation_repair as cr
from speechmill.llm import fill_in_middle as fim

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def talks(spark):
    def make(rows, extra=()):
        d = spark.createDataFrame(rows, SCHEMA).repartition(3)
        for n in extra:
            d = d.withColumn(n, F.lit("other"))
        return d

    return make


def conversations(n, r, roles=("system", "user", "assistant")):
    out = []
    for c in range(n):
        turn = 0
        for _ in range(r.randint(1, 9)):
            turn += r.choice([0, 1, 1, 1, 3])
            out.append((c, turn, r.choice(roles), r.choice(["", " ", "yes.", "no", "What? ", "It is.\n", "a b c! x", "1. 2", "é🙂."])))
    return out


# 11

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_repair(rows):
    """Of all edits of (role, text), step by step, the cheapest whose audit comes first; and what it leaves."""
    seen, faults = set(), []
    for row in rows:
        late = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", row[1])
        faults.append("blank" if not re.search(r"[^\x20\x09-\x0D]", row[1]) else "duplicate" if row in seen else "truncated" if late else "")
        seen.add(row)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return faults, cost, audit, "\n".join(made)
        if (i, state) in done:
            continue
        done.add((i, state))
        names = {"u": "user", "a": "assistant"}
        ways = [(2, "I", i, to, f"{names[to]}:") for to in NEXT[state].values() if to in names]
        if i < len(rows):
            role, text = rows[i]
            ways.append((3, "D", i + 1, state, None))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                ways += [(2 + late, "R", i + 1, to, f"{names[to]}:{text}") for to in NEXT[state].values() if to in names]
                if role[:1] in NEXT[state]:
                    ways.append((late, "K", i + 1, NEXT[state][role[:1]], f"{role}:{text}"))
        for c, edit, j, to, line in ways:
            heapq.heappush(heap, (cost + c, audit + edit, j, to, made if line is None else (*made, line)))


def brute_audits(rows):
    told = {}
    for c, turn, role, text in rows:
        told.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, mine in told.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        faults, cost, audit, made = brute_repair([x[1:] for x in mine])
        turns = [x[0] for x in mine if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha(made))
    return out


def audits(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_cheapest_repair_equals_all_edits():
    r = random.Random(41)
    for _ in range(3000):
        rows = [(r.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), r.choice(["a.", "b.", "c.", "d", "e", " "])) for _ in range(r.randint(0, 8))]
        faults, cost, audit, _ = brute_repair(rows)
        code = bytes({"": 0, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.TRUNCATED}[f] for f in faults)
        got, roles, before, end = cr.cheapest([x[0][:1] for x in rows], code)
        told = "".join("D" if not roles[i] else "I" * before[i] + ("K" if cr.INITIAL.get(rows[i][0][:1]) == roles[i] else "R") for i in range(len(rows))) + "I" * end
        assert (got, told) == (cost, audit)


def test_repair_against_brute_force(talks):
    r = random.Random(42)
    rows = conversations(150, r) + [(1000 + c, t, x, y) for c, t, x, y in conversations(50, r, ("system", "user", "assistant", "tool", "", None))]
    rows += [(5000, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(3000)]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (5001, None, "user", None), (5002, 7, "assistant", "x" * 300000 + "."), (5003, 1, "user", "q?"), (5003, 1, "user", "q?")]
    d = talks(rows, ("phase", "tie", "digest", "place"))
    want = brute_audits([x for x in rows if x[0] != 5000])
    got = audits(cr.repair_audits(d))
    long = got.pop(5000)
    assert got == want
    assert long[5] == 4 and long[6] == "I" + "K" * 3000 + "I"
    made = {}
    for x in sorted(cr.repaired(d).collect(), key=lambda x: x.place):
        made.setdefault(x.conv_id, []).append(x)
    for c, x in (got | {5000: long}).items():
        mine = made.get(c, [])
        assert sha("\n".join(f"{y.role}:{y.text}" for y in mine)) == x[7] and [y.place for y in mine] == list(range(len(mine)))
        assert "".join(y.edit for y in mine) == x[6].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(y.role[:1] for y in mine))


def test_damage_and_conversations_of_which_nothing_is_left(talks):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Say {t}. And more!") for c in range(60) for t in range(4)] + [(None, 2, None, "x."), (3, None, "user", None)]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            want += [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    made = cr.damaged(talks(rows))
    order = lambda x: tuple((v is not None, v or "") if isinstance(v, (str, type(None))) else (True, str(v)) for v in x)
    assert sorted((tuple(x) for x in made.collect()), key=order) == sorted(want, key=order)
    gone = next(c for c in range(100, 10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    every = talks([*rows, (gone, 0, "user", "a.")])
    got = audits(cr.repair_audits(cr.damaged(every), every=every))
    assert got == brute_audits(want) | {gone: (0, 0, 0, 0, 0, 0, "", sha(""))}
    none = talks(rows).where("turn < -1")
    assert cr.repair_audits(none, every=none).collect() == [] and cr.repaired(none).collect() == []


# 12

def plain_format(role, text):
    esc = lambda t: t.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")
    return "### " + esc(role).replace("\n", "\\n") + "\n" + esc(text) + "</turn>\n"


def grouped(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    for c, mine in by.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(plain_format(x[1], x[2])[:-8].encode()).digest()))
    return by


def branching(r, n=120):
    """Conversations that share their starts, a hot one among them, and copies."""
    texts = ["Hello.", "### x", "</turn>\n### user\n", "a\\b \\h", "", "é🙂\n\nz", "\\### Assistant: </turn> ok", "<turn>"]
    rows = []
    for c in range(n):
        rows.append((c, 0, "system" if c % 3 else "user", "The common start." if c % 3 else r.choice(texts)))
        for t in range(1, r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "to\nol#"]), r.choice(texts)))
    rows += [(1000 + c, t, x, y) for c, t, x, y in rows if c < 20]
    return [*rows, (2000, None, None, None), (None, 1, "user", "no id"), (2001, 1, "assistant", "same"), (2001, 1, "assistant", "same"), (2002, 0, "assistant", "long " * 60000)]


@pytest.mark.parametrize("window", [1, 300, 1 << 16])
def test_round_trip_of_conversations(talks, window):
    rows = branching(random.Random(51))
    want = {}
    for c, mine in grouped(rows).items():
        loss = "".join(t for _, role, t in mine if role == "assistant")
        want[c] = (len(mine), sha("".join(f"{role}\n{t}\n" for _, role, t in mine)), len(loss), sha(loss), sum(len(plain_format(role, t)) for _, role, t in mine))
    got = {x.conv_id: tuple(x)[1:] for x in cf.round_trip(talks(rows, ("key", "sequence", "head")), window).collect()}
    assert got == want


@pytest.mark.parametrize(("window", "tokens"), [(1, False), (400, False), (1 << 16, False), (400, True)])
def test_forest(spark, talks, window, tokens):
    """Shared turns come once in a sequence; positions, intervals and loss rebuild every conversation; sequences are the same for any partitioning."""
    rows = branching(random.Random(52))
    path = P.path("byte_bpe_50k.json") if tokens else None
    sequences = {}
    for x in cf.chat_forest(talks(rows), window, path).collect():
        sequences.setdefault(x.sequence, []).append(x)
    by = grouped(rows)
    distinct = {tuple(plain_format(role, t) for _, role, t in mine) for mine in by.values()}
    found = set()
    for mine in sequences.values():
        mine.sort(key=lambda x: x.at)
        assert [x.at for x in mine] == [sum(y.length for y in mine[:i]) for i in range(len(mine))]  # gapless
        paths = {}
        for x in mine:
            seen = [y for y in mine if any(i.start <= y.at < i.end for i in x.attends)] + [x]
            assert sum(i.end - i.start for i in x.attends) == x.position == sum(y.length for y in seen[:-1])
            assert all(a.end < b.start for a, b in zip(x.attends, x.attends[1:], strict=False)) and len(seen) == x.depth + 1
            line = tuple(y.text for y in seen)
            assert line not in paths  # emitted once
            paths[line] = x
            if x.loss_start is not None:
                assert x.text.startswith("### assistant\n") and x.at <= x.loss_start <= x.loss_end <= x.at + x.length
            if x.key is not None:
                assert line not in found and line == tuple(plain_format(role, t) for _, role, t in by[x.conversation])
                found.add(line)
            if tokens:
                import tokenizers

                coder = tokenizers.Tokenizer.from_file(path)
                assert coder.decode([i for y in seen for i in y.ids], skip_special_tokens=False) == "".join(line) and len(x.ids) == x.length
    assert found == distinct
    if window == 1 << 16:  # every shared start is one turn: no sequence but the last begins with ancestors
        assert len(sequences) <= 1 + sum(len(t) for p in distinct for t in p) // window + 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        again = {}
        for x in cf.chat_forest(talks(rows), window, path).collect():
            again.setdefault(x.sequence, []).append(x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {s: sorted(x, key=lambda y: y.at) for s, x in again.items()} == sequences


def test_forest_of_nothing(talks):
    none = talks([(1, 1, "user", "a")]).where("turn < 0")
    assert cf.chat_forest(none).collect() == [] and cf.round_trip(none).collect() == []


# 13

def plain_fim(i, t, seed=7, percent=100, spm=50, units=fim.LINES):
    t, h = t or "", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = re.findall(units, t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(u), "plain", None, None, t
    if h4 % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["a\nb\nc\n", "one line", "\n", "\n\n\n", "x\r\ny z\x85w\n<\nP>\n<S\n>", "has <S> inside\nmore", "<P", "é🙂\n漢\n" * 50, "", None, "tail without end\n\nlast", "line of a long text, " * 20 + "\n"]


@pytest.mark.parametrize("args", [{}, {"percent": 40, "spm_percent": 10, "seed": 9}, {"units": r"[^ ]*[ ]|[^ ]+", "spm_percent": 100}])
def test_fill_in_middle(docs, args):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(None, "no\nid\n"), (None, "no\nid\n"), (5, TEXTS[5]), (10**6, "z" * 10**6 + "\n" + "y\n" * 10**5)]
    d = docs(rows)
    for n in ("unit", "digest", "h1", "p", "n", "output"):
        d = d.withColumn(n, F.lit("other"))
    made = fim.fill_in_middle(d, **args)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in x)
    told = {"spm": args.get("spm_percent", 50), "percent": args.get("percent", 100), "seed": args.get("seed", 7), "units": args.get("units", fim.LINES)}
    want = [(i, *plain_fim(i, t, **told)) for i, t in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(want, key=key)
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got} >= ({"plain", "spm"} if told["spm"] == 100 else {"plain", "spm", "psm"})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_fill_in_middle_of_nothing(docs):
    assert fim.fill_in_middle(docs([(1, "a")]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "x<P>y", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>")])
def test_sentinels_that_could_be_confused(marks):
    with pytest.raises(ValueError):
        fim.Sentinels(*marks)
