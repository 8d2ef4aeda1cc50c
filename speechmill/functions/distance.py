"""Token edit distance on the built-in ``levenshtein``.

Tokens become single characters, so the built-in string distance is the token
distance. A pair of token lists is interned by itself (scoring: every row meets
one partner); a table of forms is interned once (joins: rows meet many).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _character(number: Column) -> Column:
    """The character of a number: code points from U+10000 on, far from surrogates, 1 048 575 of them."""
    return F.decode(F.unhex(F.lpad(F.hex(number + F.lit(0x10000)), 8, "0")), "UTF-32")


def _interned(tokens: Column, vocabulary: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: _character(F.array_position(vocabulary, t).cast("bigint"))), "")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance between two arrays of tokens; null if either is null."""
    vocabulary = F.array_distinct(F.concat(a, b))
    return F.get(F.transform(F.array(vocabulary), lambda v: F.levenshtein(_interned(a, v), _interned(b, v))), F.lit(0))


def error_counts(ref: Column, hyp: Column) -> Column:
    """struct(errors, tokens) of a hypothesis against a reference, both as token arrays."""
    return F.struct(token_distance(ref, hyp).alias("errors"), F.size(ref).alias("tokens"))


#: So many distinct tokens of a table can be told apart as characters, numbered in so many buckets.
CHARACTERS, BUCKETS = 0x100000, 64


def few_tokens(rows: DataFrame, tokens: str) -> bool:
    """Whether :func:`intern_tokens` has a character for every distinct token."""
    words = rows.select(F.explode(tokens).alias("token")).distinct().groupBy(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return ((words.agg(F.max("n")).first()[0] or 0) + 1) * BUCKETS <= CHARACTERS


def intern_tokens(rows: DataFrame, key: str, tokens: str, out: str = "coded") -> DataFrame:
    """(key, tokens, coded): every distinct token of the table is one character of ``coded``.

    The dictionary is numbered by rank within hash buckets, so no task sees it
    whole. At most about a million distinct tokens can be told apart, see
    :func:`few_tokens`; more raise an error when the result is read.
    """
    words = rows.select(F.explode(tokens).alias("token")).distinct().withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)))
    ranked = words.withColumn("number", F.row_number().over(Window.partitionBy("bucket").orderBy("token")).cast("bigint") * BUCKETS + F.col("bucket"))
    ranked = ranked.withColumn("letter", F.when(F.col("number") < CHARACTERS, _character(F.col("number"))).otherwise(F.raise_error(F.lit("more distinct tokens than characters"))))
    placed = rows.select(key, F.posexplode(tokens).alias("at", "token")).join(ranked.select("token", "letter"), "token")
    coded = placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias(out))
    return rows.join(coded, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def hashed(tokens: Column) -> Column:
    """A text with a character for each token, from its hash; two forms can look nearer than they are, never farther."""
    return F.array_join(F.transform(tokens, lambda t: _character(F.pmod(F.xxhash64(t), F.lit(CHARACTERS)))), "")


def near(a: Column, b: Column, threshold: float = 0.3) -> Column:
    """Whether two interned forms are within ``threshold`` of the longer one; two empty ones are not."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor(F.lit(float(threshold)) * longest).cast("int")
    # the limit has to be a literal in the function's Python form, so the comparison is left to the column
    return (longest > 0) & (F.levenshtein(a, b) <= most)
