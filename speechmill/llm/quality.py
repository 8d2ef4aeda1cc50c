"""Quality rules: a threshold table compiled into one Spark projection.

No user functions. Each rule is a ratio with bounds; a document is kept when it
has enough words, does not repeat itself and breaks no rule. Arrays are bound
once with ``transform(array(x), v -> ...)[0]`` so that they are not computed
again for every reference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for with on are was by it be as at from this or an "
    "der die das und ist nicht ein eine von mit auf für den dem im zu "
    "le la les et de des un une est que dans pour qui sur pas en au "
    "el los las y del una por con para no se su es lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` is a SQL expression over the measures; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_words_per_word", "n_stop / n_words", 0.04, None),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.4),
    Rule("shouting", "n_upper / greatest(n_alpha, 1)", None, 0.6),
    Rule("words_with_letters", "n_letter_words / n_words", 0.6, None),
)

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _n_repeat_words(words: str, k: int = WINDOW) -> str:
    """Words inside k-word windows that are found twice or more."""
    covered = f"aggregate(at, struct(0 as c, -{k} as p), (a, x) -> struct(a.c + least({k}, x - a.p) as c, x as p), a -> a.c)"
    twice = "filter(transform(sequence(0, size(s) - 1), j -> if(get(s, j - 1).h = s[j].h or get(s, j + 1).h = s[j].h, s[j].i, -1)), x -> x >= 0)"
    slow = _let("sort_array(transform(g, (h, i) -> struct(h as h, i as i)))", "s", _let(f"sort_array({twice})", "at", covered))
    grams = f"transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k})))"
    return _let(words, "w", f"if(size(w) <= {k}, 0, " + _let(grams, "g", f"if(size(array_distinct(g)) = size(g), 0, {slow})") + ")")


#: SQL of each measure over the columns text, words and lines.
MEASURES = {
    "n_words": "size(words)",
    "word_chars": r"length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ''))",
    "n_symbols": r"length(regexp_replace(text, '[^#*$%&|<>]+', ''))",
    "n_lines": "size(lines)",
    "n_dup_lines": "size(lines) - size(array_distinct(lines))",
    "n_repeat_words": _n_repeat_words("words"),
    "n_stop": f"size(filter(words, x -> lower(x) in ({', '.join(repr(w) for w in dict.fromkeys(STOP_WORDS))})))",
    "n_letter_words": r"size(filter(words, x -> x rlike '\\p{L}'))",
    "n_alpha": r"length(regexp_replace(text, '[^\\p{L}]+', ''))",
    "n_upper": r"length(regexp_replace(text, '[^\\p{Lu}]+', ''))",
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the counts of every row as long, and the whole row as the struct ``row``."""
    held = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct("*").alias("row"),
    )
    split = held.select(
        "doc_id", "text", "row",
        F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    # the place keeps a filter on measures from being moved below them, where each reference would compute them again
    return split.select("doc_id", "row", *[F.expr(f"cast({e} as long)").alias(n) for n, e in MEASURES.items()], F.monotonically_increasing_id().alias("place"))


def compiled(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL for the names of the rules that a row breaks."""
    parts = []
    for r in rules:
        bad = " or ".join([f"{r.metric} < {r.low}D"] * (r.low is not None) + [f"{r.metric} > {r.high}D"] * (r.high is not None))
        parts.append(f"if({bad or 'false'}, '{r.name}', null)")
    return f"array_compact(array({', '.join(parts)}))"


def judged(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...], min_words: int, max_repeat_percent: int) -> DataFrame:
    return (
        measures(docs, id_col, text_col)
        .withColumn("base_failed", F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"))
        .withColumn("broken", F.expr(f"if(n_words = 0, cast(array() as array<string>), {compiled(rules)})"))
        .withColumn("kept", F.expr("not base_failed and size(broken) = 0"))
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Measures, ``base_failed``, ``broken`` (names of broken rules) and ``kept`` of every row.

    A null or empty text has no words and fails the base rule; its ratios are not
    evaluated. Rows stay one to one, repeated rows and null ids included; an
    empty table gives an empty result.
    """
    return judged(docs, id_col, text_col, rules, min_words, max_repeat_percent).drop("row", "place")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, in the same pass.

    Null, empty and blank texts go, as they have too few words; ids are not read,
    so null ids, ties and repeated rows are judged row by row; very long texts are
    read whole; an empty table gives an empty result. Columns may have any names.
    """
    return judged(docs, id_col, text_col, rules, min_words, max_repeat_percent).where("kept and place >= 0").select("row.*")
