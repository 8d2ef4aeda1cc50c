"""Text functions as columns: tokens for scoring, normalisation, joins of transcripts, corpus fields."""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The character classes and tables that results depend on.
CJK = "一-鿿㐀-䶿"
WIDE = CJK + "，。？！、；：“”‘’（）《》"
FULL_WIDTH = {",": "，", "?": "？", "!": "！", ";": "；", ":": "："}
TRAILING = "。．.，,、；;：:？?！!… "
TOKEN = f"[{CJK}]|[a-z0-9']+"


def simplified_table(spark: SparkSession) -> tuple[str, str]:
    """(traditional, simplified) characters in order, for ``translate``; asked once from the JVM's transliterator."""
    jvm = spark.sparkContext._jvm
    convert = jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate
    every = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]))
    pairs = [(a, b) for a, b in zip(every, convert(every), strict=False) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@functools.lru_cache(maxsize=1)
def _table(application: str) -> tuple[str, str]:
    return simplified_table(SparkSession.active())


def simplified(text: Column) -> Column:
    """The text in simplified characters; one without CJK characters is left as it is."""
    return F.when(text.rlike(f"[{CJK}]"), F.translate(text, *_table(SparkSession.active().sparkContext.applicationId))).otherwise(text)


def score_tokens(text: Column, script: bool = True) -> Column:
    """Tokens that an error rate counts: each CJK character, each run of Latin letters, digits and apostrophes.

    Case is ignored, markup tags are dropped, and traditional characters count as
    the simplified ones, unless ``script`` is off. Null stays null.
    """
    s = simplified(text) if script else text
    s = F.regexp_replace(F.lower(s), "<[^>]*>", "")
    return F.regexp_extract_all(s, F.lit(f"({TOKEN})"), F.lit(1))


def squash(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s", "")


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def app_normalize(text: Column) -> Column:
    """A raw transcript as the app shows it.

    Outer white space goes, and so does a blank that repeats one or touches a
    wide character; half-width marks after a CJK character become full-width.
    """
    s = unicode_trim(text)
    s = F.regexp_replace(s, f"(?<=[{WIDE}]) +", "")
    for half, full in FULL_WIDTH.items():
        s = F.regexp_replace(s, f"(?<=[{CJK}])\\{half}", full)
    s = F.regexp_replace(s, f"(?<=[{WIDE}]) +", "")
    s = F.regexp_replace(s, f"(?<! ) (?=[{WIDE}])", "")
    return unicode_trim(F.regexp_replace(s, " {2,}", " "))


def strip_trailing(text: Column) -> Column:
    """Without closing punctuation and blanks."""
    return F.regexp_replace(text, f"[{TRAILING}]+$", "")


def same_text(a: Column, b: Column) -> Column:
    """Whether a raw transcript is what the app shows, closing punctuation aside."""
    return strip_trailing(app_normalize(a)).eqNullSafe(strip_trailing(b))


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_digit(text: Column) -> Column:
    """Any Unicode decimal digit."""
    return text.rlike(r"\p{Nd}")


def id_number(id_: Column) -> Column:
    """The number after the last hyphen of an id; null if there is none."""
    return F.nullif(F.regexp_extract(id_, "-([0-9]+)$", 1), F.lit("")).try_cast("int")


_ASCII_END = "[0-9A-Za-z]$"


def _joined(acc: Column, nxt: Column, continued: bool) -> Column:
    if continued:
        acc = F.regexp_replace(F.regexp_replace(acc, r"(?U)\s+$", ""), "[。.]$", "")
        lowered = F.concat(F.lower(F.substring(nxt, 1, 1)), F.substr(nxt, F.lit(2)))
        nxt = F.when(nxt.rlike(r"^\p{Lu}\p{Ll}") & acc.rlike(_ASCII_END), lowered).otherwise(nxt)
    gap = acc.rlike(_ASCII_END) | (acc.rlike("[.,?!]$") & nxt.rlike("^[0-9A-Za-z]"))
    return F.concat(acc, F.when(gap, " ").otherwise(""), nxt)


def join_texts(parts: Column, continued: bool) -> Column:
    """The transcript of utterances heard as one; an empty list gives null.

    ``continued``: the later parts carry a sentence on, so a full stop before them
    goes and a capital letter that only opens a word is lowered.
    """
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(parts, F.lit(0)), lambda acc, nxt: _joined(acc, nxt, continued))


def first_filled(columns: list[str], have: list[str]) -> Column:
    """The first of ``columns`` that the row has and that is not empty."""
    found = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in columns if c in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


TEXT_COLUMNS = ["answer", "text", "transcription", "Text", "sentence"]
SPEAKER_COLUMNS = ["speaker_id", "client_id", "original_speaker_id"]


def corpus_text(have: list[str]) -> Column:
    return first_filled(TEXT_COLUMNS, have)


def speaker(have: list[str]) -> Column:
    """Key that ties rows of one voice together: a speaker column, else a part of a session or row id, else null."""
    parts = [F.col(f"`{c}`").cast("string") for c in SPEAKER_COLUMNS if c in have]
    if "sid" in have:
        sid = F.nullif(F.col("sid"), F.lit(""))
        parts.append(F.when(sid.contains("_S"), F.regexp_extract(sid, "(?s)^(.*)_S", 1)).otherwise(sid))
    if "ID" in have:
        parts.append(F.when(F.col("ID").contains("_"), F.split_part(F.col("ID"), F.lit("_"), F.lit(1))))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def decode_pieces(ids: Column, pieces: Column) -> Column:
    """Text of piece numbers: pieces joined, the word mark read as a blank, outer white space dropped."""
    joined = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    return unicode_trim(F.replace(joined, F.lit("▁"), F.lit(" ")))
