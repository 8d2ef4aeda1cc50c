"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Fixed patterns give base spans. The model adds what is written another way: it
is trained in numpy from labelled spans and reads the text around every digit,
at-sign, the word "dot" and a bracketed "at"; what is spelled out with other
words alone is not read. Windows overlap; each is decoded on its own, a span that
reaches a window's edge is decoded again in a wider window around it, and of the
spans that windows propose for a document the set of disjoint ones with the
greatest total confidence is chosen.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speechmill.llm.common import id_text, rows_of
from speechmill.llm.nets import LstmCrf, batch_ids

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
#: Training texts have WINDOW characters. READ and STEP are of the windows that are read, NARROW is for short areas.
WINDOW, READ, STEP, NARROW, REACH = 160, 320, 160, 160, 64
#: Units of the network in each direction.
HIDDEN = 28
#: An address has up to 254 characters, and more when it is spelled out.
LONGEST = 400

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|\bdot\b|[\[({<]\x20*at\x20*[\])}>]", re.I)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind and then start."""
    out: list[Span] = []
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


# Labelled spans

_SYLLABLES = "the on er an re ti th ha en ou st es tion der und le la ment que os con ci ver lich un ai é ö ñ ing of".split()

_SMALL = "to a of in is it at we you for from by or and not with was on this und der die an zu le de la les et y en al con il per do no me us my mail write contact".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _found(r: random.Random, kind: str) -> str:
    """One labelled value, written as the patterns have it or otherwise."""
    if kind == "email":
        user = r.choice([".", ".", "_", "-", ""]).join(_name(r) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6]))) + r.choice(["", "", _digits(r, 2)])
        host = r.choice(["-", "-", "", "."]).join(_name(r) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6]))) + r.choice(["", "", _digits(r, 1)])
        top = r.choice(["com", "com", "org", "net", "de", "edu", "info", "example.com", "co.uk", *["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2))] * 4])
        at, dot = r.choice(["at", "at", "at", "AT", "At"]), r.choice(["dot", "dot", "dot", "DOT", "Dot"])
        if r.random() < 0.3:  # every dot is spelled out
            host, top = host.replace(".", f" {dot} "), top.replace(".", f" {dot} ")
        return r.choice([f"{user}@{host}.{top}", f"{user} ({at}) {host} {dot} {top}", f"{user} [{at}] {host} [{dot}] {top}", f"{user} {at} {host} {dot} {top}", f"{user} ({at}) {host}.{top}", f"{user} [{at}] {host}.{top}", f"{user}[{at}]{host}[{dot}]{top}", f"{user} @ {host}.{top}"])
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".".join(parts)] * 3 + ["[.]".join(parts)])
    if kind == "card":
        d = "4" + _digits(r, 14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))])
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+1 {a}.{b}.{c}"])


def _ascii(r: random.Random) -> str:
    return "".join(c for c in _word(r) if c.isascii()) or "on"


def _name(r: random.Random) -> str:
    """A part of an address: syllables as in running text, syllables of any letters, or letters at random."""
    kind = r.random()
    if kind < 0.3:
        return _ascii(r)
    if kind < 0.8:
        onset, vowel, coda = "b c d f g h j k l m n p r s t v w y z br ch cl dr fr gr kr mc ph pr qu sch sh st th tr zw".split(), "a e i o u ai ee ei ie oa ou y".split(), " n r s l m t ck ng nd ld rt ss tz x".split(" ")
        return "".join(r.choice(onset) + r.choice(vowel) + r.choice([*coda, "", "", "", ""]) for _ in range(r.randint(1, 4)))
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 12)))


def _running(r: random.Random) -> str:
    """A word of running text."""
    x = r.random()
    w = r.choice(_SMALL) if x < 0.3 else _word(r) if x < 0.65 else _name(r)
    return w.capitalize() if r.random() < 0.15 else w


def _clean(r: random.Random) -> str:
    """A value with digits or words that is nobody's data."""
    return r.choice([
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}", lambda: str(r.randint(1, 9999)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 999)},{_digits(r, 3)}", lambda: f"{_digits(r, 2)}:{_digits(r, 2)}:{_digits(r, 2)}",
        lambda: f"{_word(r)} at {_word(r)}", lambda: f"{_name(r)} at {_name(r)}. {_name(r)}", lambda: f"{_name(r)}-{_name(r)}.{_name(r)}", lambda: f"dot {_word(r)}", lambda: hashlib.md5(_digits(r, 6).encode()).hexdigest(), lambda: f"{r.randint(0, 99)}.{r.randint(0, 99)} %",
        lambda: f"Apache License, Version {r.randint(1, 3)}.0", lambda: f"@{_ascii(r)}", lambda: _digits(r, r.randint(5, 8)), lambda: _digits(r, r.randint(20, 26)),
        lambda: f'token = "{hashlib.sha1(_digits(r, 6).encode()).hexdigest()}"',
    ])()


def labelled_spans(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """n texts of about a window's length, each with its spans. This is the bounded training sample."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 10:
            text += " ".join(_running(r) for _ in range(r.randint(1, 5))) + r.choice([" ", " ", " ", ", ", ". ", ": ", "&&& ", "\n"])
            x = r.random()
            if x < 0.4:
                kind = r.choice(KINDS)
                value = _found(r, kind)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice([" ", " ", " ", ". ", ", ", " . ", "\n", "$$$ "])
            elif x < 0.7:
                text += _clean(r) + " "
        cut, end = r.randint(0, 10), WINDOW
        if r.random() < 0.4:  # a text that ends before its window does, but not inside a value
            end = r.randint(WINDOW // 4, WINDOW)
            end = next((e - cut for _, s, e in spans if s < cut + end < e), end)
        if end > WINDOW or any(s < cut < e for _, s, e in spans):
            cut, end = 0, WINDOW
        out.append((text[cut : cut + end], [(k, s - cut, min(e - cut, end)) for k, s, e in spans if cut <= s < cut + end]))
    return out


def _tags(texts: list[tuple[str, list[Span]]]) -> np.ndarray:
    """0: none; 1 + 2k: first character of kind k; 2 + 2k: a later one."""
    out = np.zeros((len(texts), WINDOW), np.int64)
    for i, (_, spans) in enumerate(texts):
        for kind, s, e in spans:
            k = 1 + 2 * KINDS.index(kind)
            out[i, s] = k
            out[i, s + 1 : e] = k + 1
    return out


@functools.lru_cache(maxsize=4)
def trained(sample: int = 5000, epochs: int = 12, seed: int = 7) -> LstmCrf:
    """The model, trained on ``sample`` labelled texts. The same arguments give the same model."""
    data = labelled_spans(sample, seed)
    model = LstmCrf(1 + 2 * len(KINDS), hidden=HIDDEN, seed=seed)
    model.train(batch_ids([t for t, _ in data], WINDOW), _tags(data), epochs, seed=seed)
    return model


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all that lies within reach of a digit, an at-sign, "dot" or a bracketed "at"."""
    areas: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if areas and s <= areas[-1][1]:
            areas[-1][1] = e
        else:
            areas.append([s, e])
    out = []
    for s, e in areas:
        size = NARROW if e - s <= NARROW else READ
        while True:
            out.append((s, min(s + size, len(text))))
            if s + size >= e:
                break
            s += STEP
    return out


def _proposed(text: str, start: int, end: int, tags: np.ndarray, sure: np.ndarray) -> tuple[list[tuple[float, Span]], list[tuple[int, int]]]:
    """Spans of one window; and where it has one that touches an edge and may go on."""
    out, cut, i, n = [], [], 0, end - start
    while i < n:
        t = int(tags[i])
        if t % 2 == 0:
            i += 1
            continue
        j = i + 1
        while j < n and tags[j] == t + 1:
            j += 1
        if (i > 0 or start == 0) and (j < n or end == len(text)):
            out.append((float(sure[i:j].min()), (KINDS[t // 2], start + i, start + j)))
        else:
            cut.append((start + i, start + j))
        i = j
    return out, cut


def _wider(length: int, s: int, e: int) -> tuple[int, int]:
    """A window with WINDOW characters at least on both sides of a span."""
    a = max(0, s - WINDOW)
    return a, min(length, a + -(-(e + WINDOW - a) // WINDOW) * WINDOW)


def reconcile(proposed: list[tuple[float, Span]]) -> list[Span]:
    """The disjoint spans of a document with the greatest total confidence."""
    best: dict[Span, float] = {}
    for p, s in proposed:
        best[s] = max(p, best.get(s, 0.0))
    order = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    total, chosen = [0.0], [None]
    for i, s in enumerate(order):
        before = int(np.searchsorted(ends, s[1], side="right"))
        take = total[min(before, i)] + best[s]
        total.append(max(total[i], take))
        chosen.append(min(before, i) if take > total[i] else None)
    out, i = [], len(order)
    while i:
        if chosen[i] is None:
            i -= 1
        else:
            out.append(order[i - 1])
            i = chosen[i]
    return out[::-1]


def _plausible(kind: str, value: str) -> bool:
    digits = len(_DIGIT.findall(value))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", value, re.I)) and bool(re.search(r"\.|\bdot\b", value, re.I))
    return {"ip": 4 <= digits <= 12 and value.count(".") >= 3, "card": 13 <= digits <= 19, "phone": 9 <= digits <= 15 and not value.isdigit()}[kind]


def find(texts: list[str], model: LstmCrf, confidence: float) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) of every text."""
    base = [base_spans(t) for t in texts]
    where = [(i, s, e) for i, t in enumerate(texts) for s, e in windows(t)]
    proposed: list[list] = [[] for _ in texts]
    asked = set(where)
    while where:
        wider: dict[tuple[int, int, int], None] = {}
        where.sort(key=lambda x: -(-(x[2] - x[1]) // WINDOW))
        for at in range(0, len(where), 256):
            part = where[at : at + 256]
            tags, sure = model.decode(batch_ids([texts[i][s:e] for i, s, e in part], max(-(-(e - s) // WINDOW) * WINDOW for _, s, e in part)))
            for (i, s, e), t, p in zip(part, tags, sure, strict=True):
                found, cut = _proposed(texts[i], s, e, t, p)
                proposed[i] += found
                for a, b in cut:
                    if b - a <= LONGEST and not any(x[1] < b and a < x[2] for x in base[i]):
                        wider[i, *_wider(len(texts[i]), a, b)] = None
        where = [x for x in wider if x not in asked]
        asked.update(where)
    out = []
    for t, b, p in zip(texts, base, proposed, strict=True):
        covered = bytearray(len(t) if p else 0)
        for _, s, e in b if p else ():
            covered[s:e] = b"\x01" * (e - s)
        p = [(c, x) for c, x in p if c >= confidence and _plausible(x[0], t[x[1] : x[2]]) and not any(covered[x[1] : x[2]])]
        out.append((b, reconcile(p) if p else []))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.7, sample: int = 5000, epochs: int = 12) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts are of base spans; ``spans`` has the base ones and those that the
    model adds with at least ``confidence``, by kind and then start. A null or
    empty text has none. Rows stay one to one, repeated rows and null ids
    included; an empty table gives an empty result. ``sample`` bounds the
    labelled texts that the model is fitted to.
    """
    params = {k: np.asarray(v) for k, v in trained(sample, epochs).p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LstmCrf(1 + 2 * len(KINDS), hidden=HIDDEN, params=params)
        for ids, texts in rows_of(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, spans = [], []
            for base, added in find(texts, model, confidence):
                for c, kind in zip(counts, KINDS, strict=True):
                    c.append(sum(b[0] == kind for b in base))
                shas.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
