"""Error rates of systems: completeness, subsets, rates, differences, bootstrap intervals, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.functions import text as tx
from speechmill.functions.distance import error_counts
from speechmill.operators.resampling import intervals


def merged_systems(files: DataFrame) -> DataFrame:
    """(system, id, hyp) of (system, ord, id, hyp): a later file of a system overrides equal ids."""
    return files.groupBy("system", "id").agg(F.max_by("hyp", "ord").alias("hyp"))


def missing(labels: DataFrame, hyps: DataFrame, systems: list[str]) -> DataFrame:
    """(system, missing, total, example) of the systems that lack a transcript; the example is the first by ``pos``."""
    wanted = labels.select("id", "pos").withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    lacking = wanted.join(hyps.select("system", "id"), ["system", "id"], "left_anti")
    total = labels.agg(F.count(F.lit(1)).alias("total"))
    return lacking.groupBy("system").agg(F.count(F.lit(1)).alias("missing"), F.min_by("id", "pos").alias("example")).crossJoin(F.broadcast(total))  # one row


def complete(labels: DataFrame, hyps: DataFrame, systems: list[str]) -> DataFrame:
    """Labels that every system has a transcript of."""
    have = hyps.where(F.col("system").isin(systems)).groupBy("id").agg(F.count_distinct("system").alias("n")).where(F.col("n") == len(systems))
    return labels.join(have, "id", "left_semi")


def require_complete(labels: DataFrame, hyps: DataFrame, systems: list[str]) -> None:
    """Raises ValueError unless every system has a transcript of every label."""
    found = missing(labels, hyps, systems).collect()  # a row for each system
    if found:
        told = "; ".join(f"{r['system']} lacks {r['missing']} of {r['total']} (first: {r['example']})" for r in found)
        raise ValueError(f"incomplete systems: {told}")


def with_status(labels: DataFrame, utterances: DataFrame, most: int = 5) -> DataFrame:
    """Labels with the ``status`` of their utterance; raises ValueError if one has none, naming the first ``most`` by ``pos``."""
    lost = [r[0] for r in labels.join(utterances, "id", "left_anti").select("id", "pos").orderBy("pos").limit(most).collect()]
    if lost:
        raise ValueError(f"labels without an utterance: {', '.join(map(str, lost))}")
    return labels.join(utterances.select("id", "status"), "id")


def without_digits(labels: DataFrame, hyps: DataFrame) -> DataFrame:
    """Labels with a token whose transcripts, in every system, have no digit."""
    wrote = hyps.where(tx.has_digit(F.col("hyp"))).select("id").distinct()
    return labels.where(F.size(tx.score_tokens(F.col("text"))) > 0).join(wrote, "id", "left_anti")


def cells(labels: DataFrame, hyps: DataFrame) -> DataFrame:
    """(system, id, errors, tokens) and the label's columns, one row for each system and label."""
    both = labels.join(hyps.select("system", "id", "hyp"), "id")
    counted = both.withColumn("_c", error_counts(tx.score_tokens(F.col("text")), tx.score_tokens(F.col("hyp"))))
    return counted.withColumn("errors", F.col("_c.errors")).withColumn("tokens", F.col("_c.tokens")).drop("_c")


def subset_tags(text: Column, status: Column | None) -> Column:
    """Names of the subsets a row is in; without a status only "all"."""
    if status is None:
        return F.array(F.lit("all"))
    latin = F.when(tx.has_latin(text), "latin").otherwise("no latin")
    return F.array_compact(F.array(F.lit("all"), F.when(status == "corrected", "corrected"), latin))


def rate(errors: Column, tokens: Column) -> Column:
    """Ratio of sums in percent."""
    return F.lit(100.0) * F.sum(errors) / F.greatest(F.sum(tokens), F.lit(1))


def subset_rates(cells_: DataFrame, with_status: bool = True) -> DataFrame:
    """(subset, system, utterances, tokens, rate, wrong): all subsets in one pass."""
    tags = subset_tags(F.col("text"), F.col("status") if with_status else None)
    return cells_.withColumn("subset", F.explode(tags)).groupBy("subset", "system").agg(
        F.count(F.lit(1)).alias("utterances"), F.sum("tokens").alias("tokens"), rate(F.col("errors"), F.col("tokens")).alias("rate"), F.count_if(F.col("errors") > 0).alias("wrong")
    )


def differences(rates: DataFrame, first: str) -> DataFrame:
    """(subset, system, difference): rate minus that of ``first``, for the others."""
    base = rates.where(F.col("system") == first).select("subset", F.col("rate").alias("_base"))
    return rates.where(F.col("system") != first).join(base, "subset").select("subset", "system", (F.col("rate") - F.col("_base")).alias("difference"))


def wrong_cells(cells_: DataFrame) -> DataFrame:
    """(pos, id, grade, text, wrong): of each label that a system got wrong, those systems' transcripts by name."""
    bad = cells_.where("errors > 0")
    return bad.groupBy("pos", "id", "grade", "text").agg(F.array_sort(F.collect_list(F.struct("system", "hyp"))).alias("wrong"))


def bootstrap(cells_: DataFrame, first: str, rounds: int = 2000, seed: int = 0, exact: bool = False) -> DataFrame:
    """(system, low, high): 95 % interval of the difference to ``first``, resampling groups; see ``resampling.intervals``."""
    tagged = cells_.select(F.lit("all").alias("subset"), "group", "system", "errors", "tokens")
    return intervals(tagged, first, rounds, seed, exact).drop("subset")


def subset_intervals(cells_: DataFrame, first: str, rounds: int = 2000, seed: int = 0, exact: bool = False, with_status: bool = True) -> DataFrame:
    """(subset, system, low, high): :func:`bootstrap` of each subset over the groups that it has, all in one pass over the cells."""
    tags = subset_tags(F.col("text"), F.col("status") if with_status else None)
    tagged = cells_.select(F.explode(tags).alias("subset"), "group", "system", "errors", "tokens")
    return intervals(tagged, first, rounds, seed, exact)


def term_hits(labels: DataFrame, hyps: DataFrame, terms: DataFrame, systems: list[str]) -> DataFrame:
    """(pos, term, said, one column a system) and a last row of totals with null pos and term.

    Counts utterances, not occurrences, over grade A labels that every system has.
    ``terms`` is a short list that a person wrote and is broadcast by Spark's own
    size check.
    """
    kept = complete(labels.where("grade = 'A'"), hyps, systems)
    said = kept.select("id", tx.squash(F.col("text")).alias("said"))
    hits = said.join(terms, F.col("said").contains(F.col("term"))).select("id", "pos", "term")
    heard = hyps.where(F.col("system").isin(systems)).select("system", "id", tx.squash(F.col("hyp")).alias("heard"))
    wide = hits.join(heard, "id").groupBy("id", "pos", "term").agg(*[F.max(((F.col("system") == s) & F.col("heard").contains(F.col("term"))).cast("int")).alias(s) for s in systems])
    per = wide.groupBy("pos", "term").agg(F.count(F.lit(1)).alias("said"), *[F.sum(s).alias(s) for s in systems])
    full = terms.join(per, ["pos", "term"], "left").na.fill(0, ["said", *systems])
    return full.rollup(F.struct("pos", "term").alias("key")).agg(*[F.sum(c).alias(c) for c in ("said", *systems)]).select("key.pos", "key.term", "said", *systems)


def agreement(rows: DataFrame, heard: str = "hyp", shown: str = "phone") -> DataFrame:
    """(same, total): rows whose raw transcript is what the app showed."""
    return rows.agg(F.count_if(tx.same_text(F.col(heard), F.col(shown))).alias("same"), F.count(F.lit(1)).alias("total"))


def identical(a: DataFrame, b: DataFrame, keys: list[str], value: str = "hyp") -> DataFrame:
    """(same, total) transcripts of two exports; a row that one side lacks is not the same."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ina")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_inb")), keys, "full")
    return both.agg(F.count_if(F.col("_ina").isNotNull() & F.col("_inb").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"), F.count(F.lit(1)).alias("total"))
