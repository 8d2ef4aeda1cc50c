"""Secret scans by a character convolutional network over candidates and their context.

Fixed patterns give base spans. Every other run of token characters that is long
enough and has a digit or mixed case is a candidate; a shorter or plainer one if a
word for credentials stands before it; and so is what base spans leave of a run.
The network reads it with the text around
it, in overlapping windows where it is long, and its logit is calibrated by
temperature; a run counts by its most suspicious window. The threshold is the highest that
still recalls the wanted share of each sort of held-out labelled findings; what
share of held-out clean candidates passes it is reported with the model.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speechmill.llm.common import id_text, rows_of, tidy
from speechmill.llm.nets import CharCnn, batch_ids

KINDS = ("assign", "access", "hex")
ADDED = "secret"
Span = tuple[str, int, int]
CONTEXT, SIZE, LEAST, SHORT = 28, 96, 16, 6

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PLAIN = re.compile(r"[A-Z]?[a-z=_/+-]*|[A-Z=_/+-]*", re.A)
_CREDENTIAL = re.compile(r"(?:pass|pwd|key|bearer|auth|cred|login|secret|token|access|signing|private)", re.I | re.A)
#: A shorter run; it may begin after an equals sign.
_SHORT = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{%d,}" % (SHORT - 1))
_ASSIGNED = re.compile(r"[:=]\x20?[\"']?\Z")
_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")


def _short_runs(text: str) -> list[tuple[int, int]]:
    """Runs too short for a candidate elsewhere that begin within ``CONTEXT`` characters after a word for credentials.

    A plain word is one only after a colon or an equals sign.
    """
    out: dict[tuple[int, int], None] = {}
    for c in _CREDENTIAL.finditer(text):
        for m in _SHORT.finditer(text, c.end(), c.end() + CONTEXT + LEAST):
            s, e = m.span()
            if s > c.end() + CONTEXT:
                break
            a = s
            while a and e - a < LEAST and text[a - 1] in _TOKEN:
                a -= 1
            plain = _PLAIN.fullmatch(m[0]) and not _ASSIGNED.search(text, max(0, s - 4), s)
            if e - a < LEAST and not plain and (e == len(text) or text[e] not in _TOKEN):
                out[s, e] = None
    return list(out)


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans by start and then kind; and the runs that are candidates."""
    out: list[Span] = []
    runs = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        if len(run) >= 20 and "AKIA" in run:
            out += [("access", at + x.start(), at + x.end()) for x in _ACCESS.finditer(run) if len(x[0]) >= 20]
        if len(run) >= 24:
            out += [("hex", at + x.start(), at + x.end()) for x in _HEX.finditer(run)]
        if not _PLAIN.fullmatch(run) or _CREDENTIAL.search(text, max(0, at - CONTEXT), at) or any(x[1] < m.end() and at < x[2] for x in out):
            runs.append(m.span())
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out, sorted(runs + _short_runs(text))


def uncovered(run: tuple[int, int], base: list[Span]) -> list[tuple[int, int]]:
    """What base spans leave of a run. A short part right before an assignment is the name's beginning, not a value."""
    out, at = [], run[0]
    for kind, s, e in base:
        if s >= run[1]:
            break
        if s > at and (kind != "assign" or s - at >= LEAST):
            out.append((at, s))
        at = max(at, e)
    return [*out, (at, run[1])] if at < run[1] else out


# Labelled findings

_SYLLABLES = "the on er an re ti th ha en ou st es tion der und le la ment que os con ci ver lich un ai of".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _of(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_B64 = _UP + _LOW + _NUM


def _positive(r: random.Random) -> tuple[str, str, str]:
    value = r.choice([
        lambda: "ghp_" + _of(r, _B64, 36), lambda: "sk_live_" + _of(r, _B64, 24), lambda: _of(r, _B64 + "+/", 40), lambda: _of(r, _B64, 32), lambda: _of(r, _B64 + "_-", 43),
        lambda: "AIza" + _of(r, _B64 + "_-", 35), lambda: "xoxb-" + _of(r, _NUM, 11) + "-" + _of(r, _B64, 24), lambda: "eyJ" + _of(r, _B64, 60), lambda: _of(r, _LOW + _NUM, 20), lambda: _of(r, _UP + _NUM, 24),
    ])()
    left = r.choice(["Authorization: Bearer ", "auth=", "client_key: ", "AWS_ACCESS=", "credential ", "key: ", "private key ", "access key is ", "login with ", 'cred = "', "export KEY=", "signing key ", "bearer ", "pwd: "])
    return left, value, '"' if left.endswith('"') else ""


def _negative(r: random.Random) -> tuple[str, str, str]:
    word = lambda: _words(r, 1).replace(" ", "")
    left, value = r.choice([
        lambda: ("", _of(r, _NUM, r.randint(16, 30))), lambda: ("order number ", _of(r, _NUM, 18)), lambda: ("", f"{word()}-{word()}-{r.randint(1, 9999)}-{word()}-{word()}"), lambda: ("", f"2024-{r.randint(10, 12)}-{r.randint(10, 28)}-{word()}{word()}x"),
        lambda: ("see /usr", f"/lib/{word()}/{word()}{r.randint(1, 99)}/{word()}"), lambda: ("https:", f"//{word()}/{word()}/{r.randint(1, 999)}/{word()}/x"), lambda: ("", f"{word()}{word()}{word()}{r.randint(0, 99)}{word()}"), lambda: ("", "=" * r.randint(10, 30) + f"{r.randint(0, 9)}" + "=" * 8),
        lambda: ("id ", "-".join(_of(r, _NUM + "ABCDEF", k) for k in (8, 4, 4, 4, 12))), lambda: ("call ", "-".join(_of(r, _NUM, k) for k in (4, 4, 4, 4))), lambda: ("", f"{word()}_{word()}_{word()}_{r.randint(0, 99)}"), lambda: ("page ", f"{_of(r, _NUM, 4)}-{_of(r, _NUM, 4)}/{_of(r, _NUM, 9)}"),
    ])()
    return left, value + "x" * max(0, LEAST - len(value)), ""


@dataclass(frozen=True)
class Finding:
    text: str
    start: int
    end: int
    secret: bool


def labelled_findings(n: int, seed: int = 7) -> list[Finding]:
    """n candidates with context, half of them secrets. This is the bounded training sample."""
    r, out = random.Random(seed), []
    for k in range(n):
        left, value, right = _positive(r) if k % 2 else _negative(r)
        before = _words(r, r.randint(0, 6)) + r.choice([" ", " ", ".\n", ", "]) + left
        out.append(Finding(before + value + right + r.choice([" ", ". ", "\n", ", "]) + _words(r, r.randint(0, 6)), len(before), len(before) + len(value), bool(k % 2)))
    return out


def views(length: int, s: int, e: int) -> list[int]:
    """Where the windows over a candidate begin: the last one has the context to its right, or the text's end."""
    out = [max(0, s - CONTEXT)]
    while out[-1] + SIZE < min(e + CONTEXT, length):
        out.append(out[-1] + SIZE - 2 * CONTEXT)
    return out


_WORDS_FOR = ["key", "pwd", "password", "bearer", "access", "login", "credential", "private key", "auth", "signing key", "pass"]


def labelled_rest(n: int, seed: int = 7) -> list[tuple[str, int, int, int, bool]]:
    """n short or digit-free candidates, and parts that a base span leaves of a run: text, candidate, where its window begins, and whether it is a secret."""
    r, out = random.Random(seed + 2), []
    word = lambda: _words(r, 1).replace(" ", "")
    other = lambda k: "".join(r.choice(("bcdfghklmnprstvwz", "sch pf tz ch st br".split())[r.random() < 0.2]) + r.choice("aeiou") + r.choice(["", "n", "r", "t"]) for _ in range(k))
    mixed = lambda k: _of(r, "GHJKMNPQRSTUVWXYZ", 1) + _of(r, _B64, max(k - 2, 0)) + _of(r, "GHJKMNPQRSTUVWXYZ", k > 1)
    for k in range(n):
        secret, sort = bool(k % 2), r.random()
        left, right, name = "", "", r.choice(_WORDS_FOR)
        name = r.choice([name, name, name.capitalize(), name.upper()])
        if sort < 0.35:  # short, after a word for credentials
            if secret:
                left = name + r.choice([": ", " = ", "=", " is ", " ", ': "', ": '"])
                value = r.choice([lambda: _of(r, _B64, r.randint(8, 15)), lambda: _of(r, _LOW + _NUM, r.randint(8, 15)), lambda: f"{word()}{r.randint(1, 99)}{word()}{r.randint(1, 9)}"[-15:], lambda: f"{other(2)}{r.randint(1, 99)}{other(2)}{r.randint(1, 9)}"[-15:], lambda: f"{other(2)}{r.randint(1, 9999)}"[-15:], lambda: word().capitalize() + str(r.randint(10, 9999))])()
                value += _of(r, _NUM, max(0, SHORT - len(value)))
                right = left[-1] if left[-1] in "\"'" else ""
            else:
                left = name + r.choice([" ", ": ", " to the ", " of ", " is ", " for ", ", ", " was ", ". ", "s and ", " page ", " number ", " on "])
                value = r.choice([lambda: word() + word(), lambda: other(3), lambda: (word() + word()).capitalize(), lambda: f"{word()}-{word()}-{word()}", lambda: f"2024-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: _of(r, _NUM, r.randint(6, 12)), lambda: f"{word()}/{word()}"])()
                value = (value + "ation")[:15] if len(value) < SHORT else value[:15]
        elif sort < 0.6:  # no digit
            if secret:
                left, value = name + r.choice([": ", " = ", " is ", " ", ': "']), _of(r, _UP + _LOW, r.randint(20, 44))
                right = '"' if left.endswith('"') else ""
            else:
                left = r.choice(["", "", name + " ", name + ": "])
                value = r.choice([lambda: "_".join(word() for _ in range(4)), lambda: "/" + "/".join(word() for _ in range(4)), lambda: r.choice("-=_/+") * r.randint(16, 70), lambda: "".join(word() for _ in range(5)), lambda: other(8), lambda: "".join(word().capitalize() for _ in range(5)), lambda: "-".join(word() for _ in range(5)), lambda: "".join(word() for _ in range(4)).upper()])()
                value += value[:1] * max(0, LEAST - len(value))
        else:  # beside a span of hex digits
            hexes, after = _of(r, "0123456789abcdef", r.choice([24, 24, 32, 40])), r.random() < 0.5
            if secret:
                left, value = r.choice(["", name + ": ", name + " "]), mixed(r.randint(3, 20))
            else:
                value = r.choice([lambda: f"{word()}/{word()}/", lambda: word() + "-", lambda: word() + "_", lambda: "/" + word() + "/", lambda: "sha" + r.choice(["1", "256"]) + "-", lambda: f"/commit/{word()}/" if r.random() < 0.3 else "/commit/"])()
                value = value.rstrip("/-_") if after and value[-1] in "-_" else value
                value = r.choice("/-_") + value.strip("/-_") if after else value
            left, right = (left + hexes, right) if after else (left, hexes + right)
            if not after and value[-1] in "0123456789abcdef":
                value += "/"
        before = _words(r, r.randint(0, 6)) + r.choice([" ", " ", ".\n", ", "])
        text = before + left + value + right + r.choice([" ", ". ", "\n", ", "]) + _words(r, r.randint(0, 6))
        s, e = len(before) + len(left), len(before) + len(left) + len(value)
        if left.endswith("=") and e - s + len(left) >= LEAST:
            s -= len(left)
        out.append((text, s, e, max(0, s - CONTEXT), secret))
    return out


def labelled_windows(n: int, seed: int = 7) -> list[tuple[str, int, int, int, bool]]:
    """n windows of long runs: text, run, where the window begins, and whether it has (20 characters of) a secret."""
    r, out = random.Random(seed + 1), []
    while len(out) < n:
        parts: list[str] = []
        while sum(map(len, parts)) < r.randint(30, 160):
            parts.append(r.choice([lambda: _words(r, 1), lambda: _words(r, 1), lambda: f"{_words(r, 1)}{r.randint(1, 99)}", lambda: str(r.randint(1, 9999)), lambda: _negative(r)[1].strip("/")])())
        run, value = r.choice(["/", "/", "-", "_"]).join(parts), ""
        s = e = 0
        if r.random() < 0.6:
            value = _positive(r)[1]
            joint, tail = r.choice(["/", "=", "-"]), r.choice(["", "", "/" + _words(r, 2).replace(" ", "/")])
            s = len(run) + 1
            run, e = run + joint + value + tail, len(run) + 1 + len(value)
        before = _words(r, r.randint(0, 6)) + r.choice([" ", ".\n", ", ", " https:", " see "])
        text = before + run + r.choice([" ", ". ", "\n", ", "]) + _words(r, r.randint(0, 6))
        at, end = len(before), len(before) + len(run)
        for a in views(len(text), at, end):
            seen = min(at + e, a + SIZE) - max(at + s, a)
            if not value or seen <= 0 or seen >= min(len(value), 20):
                out.append((text, at, end, a, bool(value) and seen > 0))
    return out[:n]


def features(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each candidate and its context; which of them are the candidate, and how long it is.

    ``found`` has text, start and end, and where the window begins if it is not the first one.
    """
    texts, marks = [], np.zeros((len(found), SIZE, 2), np.float32)
    for i, (t, s, e, *at) in enumerate(found):
        a = at[0] if at else max(0, s - CONTEXT)
        texts.append(t[a : a + SIZE])
        marks[i, max(s - a, 0) : min(e - a, SIZE), 0] = 1
        marks[i, max(s - a, 0) : min(e - a, SIZE), 1] = min(e - s, 200) / 100
    return batch_ids(texts, SIZE), marks


@dataclass(frozen=True)
class Scanner:
    params: dict
    temperature: float
    threshold: float
    #: Shares of held-out findings and of held-out clean candidates that reach the threshold.
    recalled: float = 0.0
    passed: float = 0.0


@functools.lru_cache(maxsize=4)
def trained(sample: int = 3000, epochs: int = 8, recall: float = 0.95, seed: int = 7) -> Scanner:
    """Trained on two thirds of ``sample`` labelled findings, as many windows of long runs and as many other candidates, calibrated on the rest."""
    sorts = zip(labelled_findings(sample, seed), labelled_windows(sample, seed), labelled_rest(sample, seed), strict=True)
    data = [x for f, *more in sorts for x in ((f.text, f.start, f.end, max(0, f.start - CONTEXT), f.secret), *more)]
    ids, marks = features([x[:4] for x in data])
    y = np.array([x[4] for x in data], np.float64)
    part = len(data) * 2 // 3
    model = CharCnn(SIZE, seed=seed)
    model.train(ids[:part], marks[:part], y[:part], epochs, seed=seed)
    logits, truth = model.logits(ids[part:], marks[part:]), y[part:]
    grid = np.geomspace(0.25, 8, 40)
    loss = [float(np.mean(np.logaddexp(0, -np.where(truth > 0, 1, -1) * logits / t))) for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = 1 / (1 + np.exp(-logits / t))
    sort = np.arange(part, len(data)) % 3  # each sort of candidates is recalled
    least = [float(np.quantile(x, 1 - recall, method="lower")) for k in range(3) if len(x := p[(truth > 0) & (sort == k)])]
    threshold = min(least, default=1.0)
    return Scanner(model.p, t, threshold, float(np.mean(p[truth > 0] >= threshold)), float(np.mean(p[truth == 0] >= threshold)))


def find(texts: list[str], model: CharCnn, scanner: Scanner) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) of every text."""
    base, asked = [], []
    for i, t in enumerate(texts):
        spans, runs = base_spans(t)
        base.append(spans)
        asked += [(i, s, e) for run in runs for s, e in uncovered(run, sorted((b for b in spans if b[1] < run[1] and run[0] < b[2]), key=lambda b: b[1:]))]
    added: list[list[Span]] = [[] for _ in texts]
    seen = [(k, a) for k, (i, s, e) in enumerate(asked) for a in views(len(texts[i]), s, e)]
    most = np.zeros(len(asked))
    for at in range(0, len(seen), 1024):
        part = seen[at : at + 1024]
        logits = model.logits(*features([(texts[asked[k][0]], *asked[k][1:], a) for k, a in part]))
        np.maximum.at(most, [k for k, _ in part], 1 / (1 + np.exp(-logits / scanner.temperature)))
    for (i, s, e), x in zip(asked, most, strict=True):
        if x >= scanner.threshold:
            added[i].append((ADDED, s, e))
    return list(zip(base, added, strict=True))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def merged(base: list[Span], added: list[Span]) -> list[Span]:
    return sorted(base + added, key=lambda s: (s[1], (*KINDS, ADDED).index(s[0])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, epochs: int = 8) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Counts are of base spans; ``spans`` has them and the candidates that the
    network takes for secrets, by start and then kind. A null or empty text has
    none. Rows stay one to one, repeated rows and null ids included; an empty
    table gives an empty result. ``sample`` bounds the labelled findings.
    """
    scanner = trained(sample, epochs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharCnn(SIZE, params=scanner.params)
        for ids, texts in rows_of(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, spans = [], []
            for base, added in find(texts, model, scanner):
                for c, kind in zip(counts, KINDS, strict=True):
                    c.append(sum(b[0] == kind for b in base))
                shas.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(merged(base, added)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", sample: int = 3000, epochs: int = 8) -> DataFrame:
    """``docs`` with every span, base or added, replaced by ``mask``.

    A null or empty text stays as it is; so does every row without a finding. Rows
    stay one to one with all their columns, repeated rows, null ids and very long
    texts included; an empty table gives an empty result.
    """
    scanner = trained(sample, epochs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharCnn(SIZE, params=scanner.params)
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = b.column(k).to_pylist()
            out = []
            for t, (base, added) in zip(texts, find([t or "" for t in texts], model, scanner), strict=True):
                parts, at = [], 0
                for _, s, e in merged(base, added):
                    if s >= at:
                        parts += [t[at:s], mask]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))

    return docs.mapInArrow(tidy(run), docs.schema)
