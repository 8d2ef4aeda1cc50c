"""From a log of records to utterances: sessions, their status, and places in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmill.schemas import LOG_VERSION

ACCEPTED, CORRECTED, UNCONFIRMED, UNDONE = "accepted", "corrected", "unconfirmed", "undone"


def checked(log: DataFrame, version: int = LOG_VERSION) -> DataFrame:
    """The log itself; reading it raises if any record has another version or none."""
    fine = F.assert_true(F.col("v").eqNullSafe(F.lit(version)), F.concat(F.lit("unknown record version: "), F.coalesce(F.col("v").cast("string"), F.lit("none"))))
    return log.where(fine.isNull())


def refined_texts(log: DataFrame) -> DataFrame:
    """(id, refined): the last one in log order."""
    return log.where("type = 'refined'").groupBy("id").agg(F.max_by("text", "seq").alias("refined"))


def status_of(undone: Column, has_field: Column, text: Column, dictated: Column) -> Column:
    return F.when(undone, UNDONE).when(~has_field, UNCONFIRMED).when(text.eqNullSafe(dictated), ACCEPTED).otherwise(CORRECTED)


def session_states(log: DataFrame) -> DataFrame:
    """One row per session: first_seq, undone, dictated, field, status.

    Any record but a refined one opens a session. An undone record outranks all;
    else the last field record counts.
    """
    is_field = F.col("type") == "field"
    last = F.max_by(F.struct("dictated", "text"), F.when(is_field, F.col("seq")))
    found = log.where("type <> 'refined'").groupBy("session").agg(
        F.min("seq").alias("first_seq"),
        F.bool_or(F.col("type") == "undone").alias("undone"),
        F.count_if(is_field).alias("fields"),
        last.alias("last"),
    )
    status = status_of(F.col("undone"), F.col("fields") > 0, F.col("last.text"), F.col("last.dictated"))
    has = F.col("fields") > 0
    return found.select("session", "first_seq", "undone", F.when(has, F.col("last.dictated")).alias("dictated"), F.when(has, F.col("last.text")).alias("field"), status.alias("status"))


def positions(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Adds ``index`` (from 0, in log order) and ``of`` (rows of the session)."""
    whole = Window.partitionBy("session")
    return rows.withColumn("index", F.row_number().over(whole.orderBy(order)) - 1).withColumn("of", F.count(F.lit(1)).over(whole).cast("int"))


def utterances(log: DataFrame, audio_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) utterances; places are counted before rows without audio are dropped.

    ``audio_files`` has the column ``audio`` of files that exist under the root;
    without it every row is kept.
    """
    log = checked(log)
    said = positions(log.where("type = 'utterance'").select("seq", "id", "session", "audio", "seconds", "continues", F.col("text").alias("phone")))
    rows = said.join(session_states(log).drop("undone"), "session").join(refined_texts(log), "id", "left")
    rows = rows.select("first_seq", "seq", "id", "session", "audio", "seconds", "index", "of", "continues", "phone", "refined", "status", "dictated", "field")
    if audio_files is None:
        return rows, rows.limit(0)
    there = audio_files.select("audio").distinct()
    return rows.join(there, "audio", "left_semi"), rows.join(there, "audio", "left_anti")


def inside(path: Column) -> Column:
    """Whether a relative path stays under its root: no absolute path, no parts that leave it, no drive."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return ~path.rlike(r"^[/\\]") & ~F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains(":"))


def status_counts(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """(status, utterances, minutes), rows without audio under "audio missing"."""
    lost = dropped.select(F.lit("audio missing").alias("status"), F.lit(None).cast("double").alias("seconds"))
    rows = kept.select("status", "seconds").unionByName(lost)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("utterances"), (F.coalesce(F.sum("seconds"), F.lit(0.0)) / 60).alias("minutes"))


def chains(labels: DataFrame) -> DataFrame:
    """Adds ``joins``: the ids that a sentence carried on from, through labelled rows with consecutive numbers.

    Needs id, session, continues, and ``pos`` (the order of labels); a row without
    a labelled predecessor, or that does not continue, starts a chain.
    """
    from speechmill.functions.text import id_number

    by_number = Window.partitionBy("session").orderBy("number", "pos")
    numbered = labels.withColumn("number", id_number(F.col("id")))
    linked = F.coalesce(F.col("continues"), F.lit(False)) & F.coalesce(F.lag("number").over(by_number) == F.col("number") - 1, F.lit(False))
    islands = numbered.withColumn("starts", (~linked).cast("int")).withColumn("island", F.sum("starts").over(by_number))
    before = Window.partitionBy("session", "island").orderBy("number", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return islands.withColumn("joins", F.collect_list("id").over(before)).drop("starts", "island", "number")
