"""Exact deduplication by deterministic block naming.

A text without its ASCII white space is cut into blocks of a fixed number of
bytes. Distinct blocks are dealt to partitions by hash and sorted there; a
block's integer name is its rank and its partition, so two blocks have one name
exactly if they are the same bytes. Adjacent pairs of names are then named the
same way, round by round, until every document has one name. (round, name)
identifies a text without collisions: no fingerprint decides.

Equal blocks are gathered inside each Arrow batch before they are shuffled, so
a text that a third of all rows repeat is shuffled once a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechmill.llm.common import WS_BYTES, cut, join_skewed, partitions, tidy

REF = "struct<row:struct<id:long,key:long,chars:int,sha:string,n:int>,pos:int>"


def _blocks(size: int):
    ref = pa.struct([("row", pa.struct([("id", pa.int64()), ("key", pa.int64()), ("chars", pa.int32()), ("sha", pa.string()), ("n", pa.int32())])), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs: dict[bytes, list] = {}
            for i, t, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                b = t.encode().translate(None, WS_BYTES)
                row = {"id": i, "key": key, "chars": len(t), "sha": hashlib.sha256(b).hexdigest(), "n": max(1, -(-len(b) // size))}
                for pos in range(row["n"]):
                    refs.setdefault(b[pos * size : (pos + 1) * size], []).append({"row": row, "pos": pos})
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.binary()), pa.array(refs.values(), pa.list_(ref))], ["block", "refs"])

    return run


def _named(keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """Adds ``name``: the rank of ``on`` within one of n partitions, times n + 1, plus the partition."""
    shard = keys.withColumn("_shard", F.pmod(F.xxhash64(*on), F.lit(n)))
    rank = F.dense_rank().over(Window.partitionBy("_shard").orderBy(*on))
    return shard.withColumn("name", rank.cast("long") * (n + 1) + F.col("_shard")).drop("_shard")


def _named_blocks(blocks: DataFrame, n: int, share: int) -> DataFrame:
    """(name, refs): blocks are named with their references, but those of more than one reference in ``share`` without them.

    There are fewer than ``share`` such blocks; they are gathered alone, their names
    have the remainder n, which no partition has, and are broadcast to the references.
    """
    held = blocks.select(F.xxhash64("block").alias("h"), F.size("refs").alias("held")).groupBy("h").agg(F.sum("held").alias("held")).agg(F.sum("held").alias("total"), F.max_by(F.struct("h", "held"), "held").alias("top"))
    top = held.first()
    if top["total"] is None or top["top"]["held"] * share <= top["total"] or top["top"]["held"] <= share:
        return _named(blocks, ["block"], n).select("name", "refs")
    counts = blocks.select(F.xxhash64("block").alias("h"), F.size("refs").alias("held")).groupBy("h").agg(F.sum("held").alias("held"))
    hot = F.broadcast(counts.where((F.col("held") * share > top["total"]) & (F.col("held") > share)).select("h"))
    keyed = blocks.withColumn("h", F.xxhash64("block"))
    ranked = F.dense_rank().over(Window.orderBy("block"))  # fewer than ``share`` blocks
    names = keyed.join(hot, "h", "left_semi").select("block").distinct().withColumn("name", ranked.cast("long") * (n + 1) + n)
    cold = _named(keyed.join(hot, "h", "left_anti"), ["block"], n).select("name", "refs")
    return cold.unionByName(keyed.join(hot, "h", "left_semi").join(F.broadcast(names), "block").select("name", "refs"))


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, key_col: str | None = None, share: int = 1000) -> DataFrame:
    """(doc_id, key, chars, text_sha256, level, name) of every row: equal (level, name), equal normalised text."""
    n = max(partitions(docs), 1)
    key = F.col(key_col).cast("long") if key_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), key.alias("key"))
    blocks = rows.mapInArrow(tidy(_blocks(block_bytes)), f"block binary, refs array<{REF}>")
    names = cut(_named_blocks(blocks, n, share).select(F.explode("refs").alias("r"), "name").select("r.row.*", "r.pos", "name"))
    row = ["id", "key", "sha", "chars"]  # rows alike in these are one text; "copies" tells how often the table has it
    level, most = 0, names.agg(F.max("n")).first()[0] or 1
    done = names.where("n = 1").select(*row, F.lit(0).alias("level"), "name")
    parts = names.where("n > 1").groupBy(*row, "n", "pos", "name").agg(F.count(F.lit(1)).alias("copies"))
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = parts.groupBy(*row, F.expr("pos div 2").alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"),
            F.max(F.expr("cast((n + 1) div 2 as int)")).alias("n"),
            F.max("copies").alias("copies"),
        )
        pairs = cut(_named(half.groupBy("a", "b").agg(F.count(F.lit(1)).alias("held")), ["a", "b"], n))
        total = pairs.agg(F.sum("held")).first()[0] or 0
        parts = cut(join_skewed(half, pairs, ["a", "b"], "held", total, share).select(*row, "n", "pos", "name", "copies"))
        done = done.unionByName(parts.where("n = 1").select(*row, F.lit(level).alias("level"), "name", F.explode(F.expr("sequence(1L, copies)")).alias("_")).drop("_"))
        parts = parts.where("n > 1")
    return done.select(F.col("id").alias("doc_id"), "key", "chars", F.col("sha").alias("text_sha256"), "level", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, key_col: str | None = None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal normalised texts the one with the most code points before
    normalisation stays, then the smallest id; a null id loses ties. A null text
    counts as empty; all texts of white space alone are equal. Rows that repeat
    an id and a text count as often as they come and share one verdict, unless
    ``key_col`` names a column that tells rows apart: then the smallest key stays,
    and the result has the column ``key``. An empty table gives an empty result.
    """
    named = block_names(docs, id_col, text_col, block_bytes, key_col)
    named = named.withColumn("identity", F.struct("level", "name"))
    groups = named.groupBy("identity").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("chars"), (-F.col("doc_id")).alias("neg"), (-F.col("key")).alias("negkey"))).alias("best"),
    )
    keep = -F.col("best.neg")
    kept = F.col("doc_id").eqNullSafe(keep) & F.col("key").eqNullSafe(-F.col("best.negkey"))
    out = join_skewed(named, cut(groups), "identity", "group_size", named.count()).select("doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "key")
    return out if key_col else out.drop("key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of equal texts, with all their columns.

    Null, empty and blank texts are one class. Of ties the smallest id stays, a null
    id last, then the first place; an empty table gives an empty result. Very long
    texts are read whole; columns may have any names.
    ``docs`` must read the same rows in the same order each time, as a scan of
    files does: rows are told apart by their place.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    read = keyed.select("place", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    stay = exact_dedup(read, "id", "text", block_bytes, "place").where("kept").select(F.col("key").alias("place"))
    return keyed.join(stay, "place", "left_semi").select("row.*")
