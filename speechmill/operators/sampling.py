"""Shuffles, samples and splits that do not depend on partitions, and corpora to draw from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmill.functions import text as tx
from speechmill.functions.portable import order_key
from speechmill.sources.shared import cut

TEST, DEV = 300, 100
SHORTEST, LONGEST = 1.0, 15.0


def shuffled(rows: DataFrame, key: Column, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank``, from 1, in the shuffled order of seed and key, inside each group of ``by``."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order_key(seed, key), key)
    return rows.withColumn("rank", F.row_number().over(window))


def first_n(rows: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """The n rows that come first in the shuffled order: a top-k, no window over all rows."""
    return rows.withColumn("_o", order_key(seed, key)).orderBy("_o", key).limit(n).drop("_o")


def test_dev(rows: DataFrame, key: Column, seed: int = 0, test: int = TEST, dev: int = DEV) -> DataFrame:
    """The first ``test`` rows in shuffled order as "test", the next ``dev`` as "dev"; the rest is left out."""
    picked = first_n(rows, test + dev, key, seed)
    ranked = shuffled(picked, key, seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= test, "test").otherwise("dev"))


def benchmark_rows(rows: DataFrame, mixed_only: bool = False) -> DataFrame:
    """text, speaker and audio of a public corpus, whatever its columns are called; needs ``seconds`` at least 1."""
    have = rows.columns
    kept = rows.where(F.col("seconds") >= SHORTEST) if "seconds" in have else rows
    if mixed_only:
        kept = kept.where("language = 'mixed'")
    audio = F.coalesce(*[F.col(c) for c in ("context", "audio") if c in have]) if {"context", "audio"} & set(have) else F.lit(None)
    return kept.select("*", tx.corpus_text(have).alias("said"), tx.speaker(have).alias("who"), audio.alias("sound"))


def replay_pool(rows: DataFrame, per_corpus: int = 400, seed: int = 0) -> DataFrame:
    """The first ``per_corpus`` usable rows of each corpus in shuffled order.

    Needs corpus, key, text and seconds. Usable: 1 to 15 seconds and a token that
    counts. Rows get their place as part of the id.
    """
    usable = rows.where(F.col("seconds").between(SHORTEST, LONGEST) & (F.size(tx.score_tokens(F.col("text"))) > 0))
    ranked = shuffled(usable, F.col("key"), seed, ["corpus"]).where(F.col("rank") <= per_corpus)
    return ranked.withColumn("id", F.format_string("%s-%04d", F.col("corpus"), F.col("rank") - 1)).withColumn("seconds", F.bround("seconds", 2))


def corpus_names(paths: list[str]) -> list[str]:
    """A name for each file: its stem, with its folder's name in front on a clash; a second clash raises."""
    names: list[str] = []
    for path in paths:
        parts = path.rstrip("/").split("/")
        name = parts[-1].rsplit(".", 1)[0] if "." in parts[-1][1:] else parts[-1]
        if name in names and len(parts) > 1:
            name = f"{parts[-2]}-{name}"
        if name in names:
            raise ValueError(f"corpus name {name!r} is taken twice; give the files different names")
        names.append(name)
    return names


def sampled(rows: DataFrame, wanted: int, key: Column, seed: object = 0) -> DataFrame:
    """``wanted`` rows without replacement, or all if there are fewer; no task and no driver gets them all."""
    keyed = rows.withColumn("_o", order_key(seed, key)).withColumn("_k", key)
    return dense(keyed, "_o", "_k", name="_n").where(F.col("_n") < wanted).drop("_o", "_k", "_n")


def dense(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Adds dense numbers from 0 in the given order without gathering rows in one task.

    Rows are range-partitioned and numbered inside partitions; the offset of each
    partition comes from one row a partition. The ranges are drawn from a sample, so
    what they came out as is written down before it is read twice.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")  # a row for each partition
