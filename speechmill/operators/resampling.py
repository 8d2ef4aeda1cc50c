"""Bootstrap intervals of ratios of sums, over groups that are drawn with replacement.

What is shuffled are sums of rounds, never draws: each task folds what it drew of
its groups into one sum a round. Few groups are broadcast to where the draws are
made. Many are cut into blocks of dense numbers; how many of a round's draws fall into
a block comes from binomial halvings that every task can repeat by itself (a draw of n
from n groups is multinomial, and so are its parts), and which ones is drawn inside
the block.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechmill.functions.portable import draw
from speechmill.operators.sampling import dense
from speechmill.sources.shared import cut

#: Sums of so many groups are broadcast, some 40 bytes a group and system.
FEW_GROUPS = 200_000
#: Groups that one block has.
BLOCK = 1 << 16
SUMS = ("e", "t", "ea", "ta")


def falls(seed: int, subset: str, n: int, rounds: int, block: int, size: int) -> np.ndarray:
    """How many of each round's n draws from n groups fall into a block of ``size`` groups: the same in every task."""
    blocks = -(-n // size)
    lo, hi, counts = 0, blocks, np.full(rounds, n, np.int64)
    held = lambda a, b: min(b * size, n) - a * size
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, zlib.crc32(subset.encode()), lo, hi])
        left = rng.binomial(counts, held(lo, mid) / held(lo, hi))
        if block < mid:
            hi, counts = mid, left
        else:
            lo, counts = mid, counts - left
    return counts


def _folded(seed: int, sizes: dict[str, int], rounds: int, size: int):
    """Of (subset, block, place, system, sums) sorted by subset and block: (subset, system, sums of each round), a row a block and system."""

    def fold(subset: str, block: int, rows: list[tuple]) -> Iterator[tuple]:
        n = sizes[subset]
        m = min(size, n - block * size)
        systems = sorted({r[3] for r in rows})
        sums = np.zeros((m, len(SUMS) * len(systems)))
        for _, _, place, system, *values in rows:
            at = len(SUMS) * systems.index(system)
            sums[place, at : at + len(SUMS)] = values
        rng = np.random.default_rng([seed, zlib.crc32(subset.encode()), 1 << 40, block])
        total = np.empty((rounds, sums.shape[1]))
        for r, k in enumerate(falls(seed, subset, n, rounds, block, size)):
            total[r] = np.bincount(rng.integers(0, m, k), minlength=m) @ sums
        for i, system in enumerate(systems):
            yield subset, system, *(total[:, len(SUMS) * i + j].astype(np.int64) for j in range(len(SUMS)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch(now: tuple, rows: list) -> pa.RecordBatch:
            cols = list(zip(*fold(*now, rows), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.list_(pa.int64())) for c in cols[2:]]], ["subset", "system", *SUMS])

        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:2] != now:
                    yield batch(now, held)
                    held = []
                now = row[:2]
                held.append(row)
        if held:
            yield batch(now, held)

    return run


def intervals(tagged: DataFrame, first: str, rounds: int = 2000, seed: int = 0, exact: bool = False) -> DataFrame:
    """(subset, system, low, high): 95 % intervals of the difference to ``first``, groups of each subset resampled.

    ``tagged`` has subset, group, system, errors and tokens, a cell once for each of
    its subsets; it is read once for all of them. Bounds are the values at places
    int(0.025 rounds) and int(0.975 rounds) - 1 of the sorted differences. Draws of
    few groups come from a hash of the round, or with ``exact`` from Python's own
    generator over the sorted groups; those of more groups than may be broadcast
    from the block's own generator. Neither depends on the partitioning.
    """
    spark = tagged.sparkSession
    per = cut(tagged.groupBy("subset", "group", "system").agg(F.sum("errors").alias("e"), F.sum("tokens").alias("t")))
    base = per.where(F.col("system") == first).select("subset", "group", F.col("e").alias("ea"), F.col("t").alias("ta"))
    sizes = dict(base.groupBy("subset").agg(F.count(F.lit(1))).orderBy("subset").collect())  # a row for each subset
    most = FEW_GROUPS // max(len(sizes), 1)
    few = {s: n for s, n in sizes.items() if n <= most}
    if exact and len(few) < len(sizes):
        raise ValueError(f"draws of Python's generator are for {most} groups at most")
    both = per.where(F.col("system") != first).join(base, ["subset", "group"])
    chosen = lambda rows, names: rows.where(F.col("subset").isin(list(names)))
    parts = []
    if few:
        ranks = chosen(base, few).select("subset", "group", (F.row_number().over(Window.partitionBy("subset").orderBy("group")) - 1).cast("bigint").alias("g"))  # a bounded number of rows
        sums = both.join(ranks, ["subset", "group"]).select("subset", "system", "g", *SUMS)
        if exact:
            made = [(s, r, g) for s, n in few.items() for rng in [random.Random(seed)] for r in range(rounds) for g in rng.choices(range(n), k=n)]
            drawn = spark.createDataFrame(made, "subset string, round bigint, g bigint")
        else:
            drawn = None
            for s, n in few.items():
                one = spark.range(rounds * n).select(F.lit(s).alias("subset"), F.expr(f"id div {n}").alias("round"), draw(n, seed, F.col("id")).alias("g"))
                drawn = one if drawn is None else drawn.unionByName(one)
        # draws meet the sums where they are made, so only sums of rounds are shuffled
        parts.append(drawn.join(F.broadcast(sums), ["subset", "g"]).select("subset", "system", "round", *SUMS))
    if len(few) < len(sizes):
        many, before = {s: n for s, n in sizes.items() if s not in few}, F.lit(0)
        for s in many:
            before = F.when(F.col("subset") == s, sum(n for x, n in many.items() if x < s)).otherwise(before)
        ranks = dense(chosen(base, many).select("subset", "group"), "subset", "group", name="g").withColumn("g", F.col("g") - before)
        sums = both.join(ranks, ["subset", "group"]).select("subset", F.expr(f"g div {BLOCK}").alias("block"), F.expr(f"cast(g % {BLOCK} as int)").alias("place"), "system", *SUMS)
        dealt = sums.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "subset", "block").sortWithinPartitions("subset", "block")
        folded = dealt.mapInArrow(_folded(seed, many, rounds, BLOCK), "subset string, system string, " + ", ".join(f"{c} array<bigint>" for c in SUMS))
        parts.append(folded.select("subset", "system", F.posexplode(F.arrays_zip(*SUMS)).alias("round", "s")).select("subset", "system", F.col("round").cast("bigint"), *[F.col(f"s.{c}").alias(c) for c in SUMS]))
    if not parts:
        return spark.createDataFrame([], "subset string, system string, low double, high double")
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ratio = lambda e, t: 100.0 * F.sum(e) / F.greatest(F.sum(t), F.lit(1))
    rated = met.groupBy("subset", "system", "round").agg((ratio("e", "t") - ratio("ea", "ta")).alias("d"))
    ordered = rated.groupBy("subset", "system").agg(F.sort_array(F.collect_list("d")).alias("d"))  # a value for each round
    return ordered.select("subset", "system", F.get("d", F.lit(int(0.025 * rounds))).alias("low"), F.get("d", F.lit(int(0.975 * rounds) - 1)).alias("high"))
