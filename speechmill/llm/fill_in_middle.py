"""Fill-in-middle transformation, as one projection of native Spark SQL.

``regexp_extract_all`` makes the array of units (lines, unless another pattern is
given). ``conv`` over substrings of a ``sha2`` of seed and id gives four numbers:
the two cuts and whether and how a document is arranged. ``slice`` and
``array_join`` build prefix, middle and suffix; sentinels mark them in the output,
and :func:`restored` rebuilds the text from output and form alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Sentinels:
    """Marks of the three parts. None may begin another, and no mark may overlap itself or another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("sentinels have to be three texts that do not contain each other")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("sentinels have to be texts that do not overlap")


def _number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits, from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, units: str = LINES, sentinels: Sentinels = Sentinels()
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text, output) of every row.

    ``n`` counts units. The prefix ends after the smaller of two drawn numbers of
    units, the middle after the larger; what follows is the suffix. Of ``percent``
    in a hundred documents ``spm_percent`` in a hundred have the form "spm" (suffix,
    prefix, middle), the others "psm"; the rest is "plain", and so is an empty text
    and one that contains a sentinel: then the output is the text and the numbers of
    characters are null. Draws depend on seed and id alone, so repeated rows are cut
    alike. A null text is empty; a null id draws like an empty one; very long texts are
    read whole; an empty table gives an empty result. Columns of any other names
    are left out. ``units`` has to match every character of a text.
    """
    s = sentinels
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    cut = read.select("doc_id", "text", F.regexp_extract_all("text", F.lit(units), F.lit(0)).alias("unit"), *[_number("digest", k).alias(f"h{k + 1}") for k in range(4)])
    n = F.size("unit").cast("long")
    ends = [F.pmod(F.col(h), n + 1).cast("int") for h in ("h1", "h2")]
    marked = F.lit(False)
    for mark in (s.prefix, s.suffix, s.middle):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    placed = cut.select("doc_id", "text", "unit", n.alias("n"), form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    joined = lambda start, size: F.array_join(F.slice("unit", start, size), "")
    parts = placed.select("doc_id", "n", "form", "text", joined(F.lit(1), F.col("a")).alias("p"), joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), joined(F.col("b") + 1, F.size("unit") - F.col("b")).alias("s"))
    p, m, x = ((F.lit(mark), F.col(c)) for mark, c in ((s.prefix, "p"), (s.middle, "m"), (s.suffix, "s")))
    output = F.when(F.col("form") == "psm", F.concat(*p, *x, *m)).when(F.col("form") == "spm", F.concat(*x, *p, *m)).otherwise(F.col("text"))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return parts.select("doc_id", "n", "form", chars("p").alias("prefix_chars"), chars("m").alias("middle_chars"), "text", output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of a form was made of, parsed at its sentinels; null if either is null."""
    s = sentinels
    head = lambda c, mark: F.substring_index(c, mark, 1)
    # what follows the first mark; the remainder has no mark of that kind, as texts with sentinels stay plain
    tail = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(head(tail(output, s.prefix), s.suffix), tail(output, s.middle), head(tail(output, s.suffix), s.middle))
    spm = F.concat(head(tail(output, s.prefix), s.middle), tail(output, s.middle), head(tail(output, s.suffix), s.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(F.when(form.isNotNull(), output))
