"""The test tables read as entities: a log, utterances, systems, labels, frames and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from speechmill.functions.portable import draw
from speechmill.operators.sessions import chains

#: Percent of words that a system drops, replaces and doubles, as running limits.
SYSTEMS = {"small": (5, 12, 14), "large": (2, 4, 5), "other": (3, 6, 7)}
STATUSES = ("accepted", "corrected", "unconfirmed", "undone")
TERMS = ("the", "tion", "der", "ungen", "les", "que", "ciones", "ththe", "in the", "zzzz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: a user's events of a day are a session."""
    kinds = {"view": "utterance", "click": "field", "purchase": "refined", "error": "undone"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("other"))
    e = table(spark, sf_dir, "events")
    session = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(
        F.col("event_id").alias("seq"), F.lit(1).alias("v"), kind.alias("type"), F.concat(session, F.lit("-"), F.col("event_id").cast("string")).alias("id"),
        session.alias("session"), F.col("event_type").alias("audio"), (F.floor(F.col("value") * 16) / 16.0).alias("seconds"),
        F.get_json_object("props", "$.k").alias("text"), (F.floor("value")).cast("string").alias("dictated"), (F.col("event_id") % 3 == 2).alias("continues"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of ``conversations`` as utterances; a conversation is a session."""
    parts = F.filter(F.regexp_extract_all("text", F.lit("[^.]+"), F.lit(0)), lambda x: x.rlike("[^ \n]"))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("part", "raw"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part")) - 1
    rows = said.withColumn("n", n).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("int"))
    text = F.expr("trim(both ' \\n' from raw)")
    rows = rows.select(
        (F.col("conv_id") * 100000 + F.col("n")).alias("pos"), F.format_string("%d-%02d", "conv_id", "n").alias("id"), F.col("conv_id").cast("string").alias("session"),
        F.col("conv_id").alias("group"), F.concat(F.col("conv_id").cast("string"), F.lit(".wav")).alias("audio"), (F.length(text) / F.lit(16.0)).alias("seconds"),
        F.col("n").alias("index"), "of", (F.col("n") % 3 == 2).alias("continues"), text.alias("text"),
    )
    status = F.get(F.array(*map(F.lit, STATUSES)), draw(4, "status", F.col("session")).cast("int"))
    return rows.withColumn("status", status).withColumn("grade", F.when(draw(10, "grade", F.col("id")) < 8, "A").otherwise("B"))


def corrupted(system: str, key: str = "id", text: str = "text"):
    """A transcript of ``system``: words dropped, replaced and doubled by draws of system, key and place."""
    drop, swap, twice = SYSTEMS[system]

    def word(w, i):
        def drawn(r):  # bound once: each reference would compute the draw again
            return F.when(r < drop, F.lit(None).cast("string")).when(r < swap, F.concat(F.lit("xh"), (r % 3).cast("string"))).when(r < twice, F.concat_ws(" ", w, w)).otherwise(w)

        return F.get(F.transform(F.array(draw(100, system, F.col(key), i)), drawn), F.lit(0))

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def hypotheses(rows: DataFrame, lossy: bool = True) -> DataFrame:
    """(system, id, hyp) of three systems; one of them lacks some ids."""
    said = F.array(*[F.struct(F.lit(s).alias("system"), corrupted(s).alias("hyp")) for s in SYSTEMS])
    every = rows.select("id", F.explode(said).alias("h")).select("h.system", "id", "h.hyp")
    return every.where((F.col("system") != "other") | (draw(50, "lost", F.col("id")) > 0)) if lossy else every


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with what the app kept of them: refined texts, and fields of sessions."""
    rows = utterances(spark, sf_dir)
    refined = F.when(draw(3, "refined", F.col("id")) == 0, F.col("text"))
    return rows.withColumn("refined", refined).withColumn("field", F.when(F.col("status") != "unconfirmed", F.col("text"))).withColumn("dictated", F.col("field"))


def reviewed(rows: DataFrame) -> DataFrame:
    grade = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("X")), draw(3, "verdict", F.col("id")).cast("int"))
    return rows.where(draw(10, "review", F.col("id")) == 0).select("id", grade.alias("grade"), "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as labels with joins and folds."""
    rows = utterances(spark, sf_dir).withColumn("source", F.when(draw(10, "review", F.col("id")) == 0, "reviewed").otherwise("agreed"))
    return chains(rows).withColumn("fold", draw(5, "fold", F.col("session")).cast("int"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ``benchmark`` text and what three systems make of it; two texts are a session."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("item_id").cast("string").alias("id"), "text")
    every = b.select("item_id", F.posexplode(F.array("text", *[corrupted(s) for s in SYSTEMS])).alias("k", "text")).select((F.col("item_id") * 4 + F.col("k")).alias("pos"), "text")
    return every.select("pos", F.col("pos").cast("string").alias("id"), F.expr("cast(pos div 8 as string)").alias("session"), "text", F.array().cast("array<string>").alias("joins"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as short waves of double samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("wave"))


def frames(spark: SparkSession, sf_dir: str, width: int = 4) -> DataFrame:
    """Each vector as frames of ``width`` values."""
    w = waves(spark, sf_dir)
    return w.select("vec_id", F.transform(F.sequence(F.lit(0), F.expr(f"size(wave) div {width} - 1").cast("int")), lambda t: F.slice("wave", t * width + 1, F.lit(width))).alias("frames"))
