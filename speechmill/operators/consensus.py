"""What was said: agreement between recognizers, the user's field and the large model, and human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.functions.text import score_tokens

PRIMARY = "small"


def hypothesis_lists(hyps: DataFrame, primary: str = PRIMARY) -> DataFrame:
    """(id, hyps): the transcripts of an id, the primary system first and the rest by name."""
    ranked = F.struct((F.col("system") != primary).alias("later"), "system", "hyp")
    return hyps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: F.struct(x["system"].alias("system"), x["hyp"].alias("hyp"))).alias("hyps"))


def opinions() -> Column:
    """Token arrays of all evidence on a row: hypotheses, field of a session of one utterance, refined text."""
    said = F.transform("hyps", lambda h: score_tokens(h["hyp"]))
    field_counts = (F.col("of") == 1) & F.col("field").isNotNull() & (F.col("status") != "undone")
    none = F.array().cast("array<array<string>>")
    return F.concat(
        said,
        F.when(field_counts, F.array(score_tokens(F.col("field")))).otherwise(none),
        F.when(F.col("refined").isNotNull(), F.array(score_tokens(F.col("refined")))).otherwise(none),
    )


def agreed(rows: DataFrame) -> DataFrame:
    """Adds ``agreed``: the primary transcript where at least two opinions exist and all are the same, else null."""
    heard = rows.withColumn("_said", opinions())
    same = (F.size("_said") >= 2) & (F.size(F.get("_said", F.lit(0))) > 0) & F.forall("_said", lambda x: x == F.get("_said", F.lit(0)))
    return heard.withColumn("agreed", F.when(same, F.get("hyps", F.lit(0))["hyp"])).drop("_said")


def graded(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Adds grade, text, source and ``outcome`` (A, B, dropped, unreviewed); review outranks agreement."""
    manual = reviewed.select("id", F.col("grade").alias("_grade"), F.col("text").alias("_text"))
    both = agreed(rows).join(manual, "id", "left")
    by_hand, in_accord = F.col("_grade").isNotNull(), F.coalesce(F.col("agreed"), F.lit("")) != ""
    grade = F.when(by_hand, F.col("_grade")).when(in_accord, "A")
    return (
        both.withColumn("grade", grade)
        .withColumn("text", F.when(by_hand, F.col("_text")).when(in_accord, F.col("agreed")))
        .withColumn("source", F.when(by_hand, "reviewed").when(in_accord, "agreed"))
        .withColumn("outcome", F.when(F.col("grade") == "X", "dropped").otherwise(F.coalesce("grade", F.lit("unreviewed"))))
        .drop("_grade", "_text", "agreed")
    )


def unknown_ids(reviewed: DataFrame, rows: DataFrame, most: int = 5) -> list[str]:
    """Up to ``most`` reviewed ids that no utterance has."""
    return [r[0] for r in reviewed.join(rows, "id", "left_anti").select("id").orderBy("id").limit(most).collect()]


def outcome_counts(rows: DataFrame) -> DataFrame:
    """(outcome, n) for all four outcomes, zeros included."""
    every = F.explode(F.array(*map(F.lit, ["A", "B", "dropped", "unreviewed"]))).alias("outcome")
    counts = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(1).select(every).join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def review_blocks(rows: DataFrame) -> DataFrame:
    """(pos, block): what a person sees of each row that nothing settles yet."""
    line = lambda name, text: F.format_string("  %-12s %s", name, text)
    head = F.concat(F.format_string("## %s  %s  %s s  %d/%d", "id", "status", F.col("seconds").cast("string"), F.col("index") + 1, "of"), F.when(F.col("continues"), "  continues").otherwise(""))
    heard = F.array_join(F.transform("hyps", lambda h: line(h["system"], F.coalesce(h["hyp"], F.lit("")))), "\n")
    field = F.when(F.col("field").isNotNull(), F.concat_ws("\n", line(F.lit("dictated"), F.coalesce("dictated", F.lit("None"))), line(F.lit("field"), F.col("field"))))
    block = F.concat_ws("\n", head, heard, line(F.lit("large model"), F.coalesce("refined", F.lit("None"))), field)
    return rows.where("outcome = 'unreviewed'").select("pos", block.alias("block"))
