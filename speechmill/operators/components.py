"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on node ids and ends in a
checkpoint in the shared folder; nothing is gathered on the driver but a count
and a checksum. The label of a node is the smallest node id of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.sources.shared import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that an edge between two nodes names.

    Null ends and loops are ignored, repeated edges and their direction do not
    matter; without edges the result is empty.
    """
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = ends.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    now = cut(now)
    before, told, rounds = None, _sum(now), 0
    while told != before:
        now = cut(_small_star(_large_star(now)))
        before, told, rounds = told, _sum(now), rounds + 1
        if rounds % 3 == 0:
            release(now.sparkSession)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
