"""BPE encoding and decoding by a deterministic automaton.

The automaton starts with one state and a loop for every base symbol, and takes
one gadget for each merge (u, v), in order: the state after u is copied without
its arc v, arcs labelled u are led to the copy, and every state with an arc u
gets an arc uv that leads to where v led. The state that an arc leads to depends
only on the arc's label, so the states are the tokens, and whether a state has
an arc follows from the order in which gadgets were added. ``MergeAutomaton``
keeps the gadgets as arrays and fills its transition table as arcs are asked
for. A word has exactly one accepted path; its labels are the word's tokens.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from speechmill.llm.common import id_text, rows_of

#: White space as the tokenizer's library has it (fixed values, Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class MergeAutomaton:
    """Tokens as states; ``allowed`` tells whether a state has an arc."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        n = max(vocab.values(), default=-1) + 1
        self.born, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        self.gadget: dict[int, int] = {}
        self.n, self.table = n, {}
        self.labels = [""] * n
        for label, i in vocab.items():
            self.labels[i] = label
        made = set()
        for k, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            self.gadget[u * n + v] = k
            if self._arc(u, v, k - 1):  # else no path takes the gadget
                self.born[uv], self.left[uv], self.right[uv] = k, u, v
                made.add(uv)
        reached = [i for i in vocab.values() if i in made or len(self.labels[i].removesuffix(end) if end and self.labels[i] != end else self.labels[i]) == 1]
        self.last = {self.labels[i].removesuffix(end): i for i in reached if self.labels[i].endswith(end)}
        self.inner = {self.labels[i]: i for i in reached if not end or not self.labels[i].endswith(end)}
        self.longest = max(map(len, [*self.last, *self.inner]), default=1)

    def _arc(self, state: int, label: int, time: int) -> bool:
        """Whether the automaton after ``time`` gadgets has the arc ``label`` in ``state``."""
        n, gadget, born = self.n, self.gadget, self.born
        while True:
            if gadget.get(state * n + label, NEVER) <= time:
                return False  # its own gadget took the arc away
            s, t = born[state], born[label]
            if not s and not t:
                return True
            if s == t:  # both came with one gadget
                state, label, time = self.right[state], self.left[label], s - 1
            elif s > t:  # the state was made from that of its right part
                state, time = self.right[state], s - 1
            else:  # the arc was added where its left part was still an arc
                label, time = self.left[label], t

    def allowed(self, state: int, label: int) -> bool:
        key = state * self.n + label
        found = self.table.get(key)
        if found is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            found = self.table[key] = self._arc(state, label, NEVER - 1)
        return found

    def word(self, s: str) -> list[int]:
        """Labels of the one accepted path of a word given in byte symbols."""
        n, inner, last, longest = len(s), self.inner, self.last, self.longest
        path: list[int] = []
        starts: list[int] = []
        dead = bytearray(n + 1)  # only one accepted path leads to a position, so it fails once
        at, most = 0, min(longest, n)
        while at < n:
            for size in range(most, 0, -1):
                to = at + size
                if dead[to]:
                    continue
                t = last.get(s[at:]) if to == n else inner.get(s[at:to])
                if t is not None and (not path or self.allowed(path[-1], t)):
                    path.append(t)
                    starts.append(at)
                    at = to
                    most = min(longest, n - at)
                    break
            else:
                if not path:
                    raise ValueError(f"the vocabulary has no path for {s!r}")
                dead[at] = 1
                path.pop()
                most, at = at - starts[-1] - 1, starts.pop()
        return path


def plain_lower(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma


class Characters:
    """Lower case and classes of characters as the tokenizer's library has them, which goes by a Unicode version of its own.

    The library is asked once for every character that turns up. Texts of
    characters that Python's tables treat alike are left to these.
    """

    #: What stands for a letter, a number, white space and anything else where classes differ.
    STANDS = ("é", "٣", " ", "¤")

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.own = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", f"[{SPACE}]")]
        self.lowered, self.known = set(map(chr, range(128))), set(map(chr, range(128)))
        self.strange: set[str] = set()  # not lowered or composed alike
        self.odd: dict[int, str] = {}  # classed otherwise

    def normalized(self, text: str) -> str:
        """The text composed and in lower case."""
        found = set(text)
        for c in found - self.lowered:
            if unicodedata.category(c) == "Cn" or self.normalize(c) != (" " if self.own[2].match(c) else plain_lower(c)):
                self.strange.add(c)
        self.lowered |= found
        return plain_lower(text) if self.strange.isdisjoint(found) else self.normalize(text)

    def kinds(self, text: str) -> str:
        """The text itself, or one in which each character that is classed otherwise is one of its class."""
        found = set(text)
        for c in found - self.known:
            kind = self.kind(c)
            if kind != next((k for k, x in enumerate(self.own) if x.match(c)), 3):
                self.odd[ord(c)] = self.STANDS[kind]
        self.known |= found
        return text.translate(self.odd) if any(chr(c) in found for c in self.odd) else text

    def kind(self, c: str) -> int:
        """0 a letter, 1 a number, 2 white space, 3 anything else: by how the library splits it."""
        if not self.split(c):
            return 2
        if len(self.split("a" + c)) == 1:
            return 0
        return 1 if len(self.split(c + c)) == 2 else 3


class WordBpe:
    """A tokenizer file with white space dropped, lower case and an end-of-word suffix."""

    def __init__(self, path: str, cache: int = 300_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = self.automaton.labels + [""] * (max([*self.specials.values(), -1]) + 1 - len(self.automaton.labels))
        for s, i in self.specials.items():
            self.labels[i] = s
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.characters = Characters(path)
        self.symbols = byte_symbols()
        self.cache: dict[str, bytes] = {}
        self.size = cache

    def _word(self, w: str) -> bytes:
        ids = self.automaton.word("".join([self.symbols[b] for b in w.encode()]))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii():
            found = self.words.findall(text.lower())
        else:
            text = self.characters.normalized(text)
            kinds = self.characters.kinds(text)
            found = self.words.findall(text) if kinds is text else [text[m.start() : m.end()] for m in self.words.finditer(kinds)]
        out = list(map(self.cache.get, found))
        if None in out:
            cache = self.cache
            if len(cache) > self.size:
                cache.clear()
            for i, v in enumerate(out):
                if v is None:
                    w = found[i]
                    out[i] = v = cache.get(w) or self._word(w)
                    if len(w) <= 64:
                        cache[w] = v
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, at = [], 0
        if self.split_special and any(x in text for x in self.specials):
            for m in self.split_special.finditer(text):
                parts += self._plain(text[at : m.start()])
                parts.append(struct.pack("<I", self.specials[m[0]]))
                at = m.end()
        parts += self._plain(text[at:] if at else text)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Emits the arc labels; ids without a label emit nothing."""
        numbers, labels = struct.unpack(f"<{len(ids) // 4}I", ids), self.labels
        try:
            out = [labels[i] for i in numbers]
        except IndexError:
            out = [labels[i] for i in numbers if i < len(labels)]
        return " ".join(out if "" not in out else filter(None, out))


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<long>) of every row.

    A null or empty text has no ids. Rows stay one to one, repeated rows and null
    ids included; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = WordBpe(tokenizer_path)
        for ids, texts in rows_of(batches):
            coded = [np.frombuffer(coder.encode(t), "<u4").astype(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in coded], pa.int64()), pa.array(coded, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<long>")


def bpe_decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): labels of ``ids``, joined by blanks.

    Null or empty ids decode to an empty text, an id without a label to nothing.
    Rows stay one to one, repeated rows and null row ids included; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe(tokenizer_path)
        for b in batches:
            texts = [coder.decode(struct.pack(f"<{len(x or ())}I", *(x or ()))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kept = rows.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({ids_col} as array<long>) as ids")
    return kept.mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, without the ids leaving it.

    The decoded text comes from the ids alone. A null or empty text has no ids.
    Rows stay one to one, repeated rows and null ids included; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe(tokenizer_path)
        for ids, texts in rows_of(batches):
            n, a, b = [], [], []
            for t in texts:
                coded = coder.encode(t)
                n.append(len(coded) // 4)
                a.append(hashlib.sha256(coded).hexdigest())
                b.append(hashlib.sha256(coder.decode(coded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
