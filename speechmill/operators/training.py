"""Training sets: items, held-out rows, the plan of an epoch, batches, and weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.functions import text as tx
from speechmill.functions.portable import draw, order_key, uniform
from speechmill.operators.sampling import sampled
from speechmill.sources.shared import cut

LONGEST_PAIR = 20.0


def selected(labels: DataFrame, grades: str, holdout: int) -> DataFrame:
    """Labels to build from: a grade in ``grades``, or the held-out fold."""
    return labels.where((F.instr(F.lit(grades), F.col("grade")) > 0) | (F.col("fold") == holdout))


def split_of(holdout: int) -> Column:
    """"held" for grade A rows of the held-out fold, null for its other rows, else "train"."""
    return F.when(F.col("fold") == holdout, F.when(F.col("grade") == "A", "held")).otherwise("train")


def joined_items(labels: DataFrame) -> DataFrame:
    """One item for each row whose ``joins`` are all among the labels: ids, audio, text and seconds of the whole sentence."""
    parts = labels.where(F.size("joins") > 0).select("pos", "id", F.posexplode(F.concat("joins", F.array("id"))).alias("at", "part"), F.size("joins").alias("n"))
    found = parts.join(labels.select(F.col("id").alias("part"), "audio", "text", "seconds"), "part")
    whole = found.groupBy("pos", "id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "part", "audio", "text", "seconds"))).alias("p")).where(F.size("p") == F.col("n") + 1)
    texts = F.transform("p", lambda x: x["text"])
    seconds = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["seconds"])
    return whole.select("pos", F.transform("p", lambda x: x["part"]).alias("ids"), F.transform("p", lambda x: x["audio"]).alias("audio"), tx.join_texts(texts, True).alias("text"), seconds.alias("seconds"), F.lit(False).alias("hard"))


def items(labels: DataFrame, holdout: int = -1) -> DataFrame:
    """(split, pos, ids, audio, text, seconds, hard): one item a label, and one a sentence in several parts (never held out)."""
    rows = labels.withColumn("split", split_of(holdout))
    single = rows.where("split is not null").select("split", "pos", F.array("id").alias("ids"), F.array("audio").alias("audio"), "text", "seconds", (F.coalesce("source", F.lit("")) == "reviewed").alias("hard"))
    whole = joined_items(labels).join(rows.where("split = 'train'").select("pos", "split"), "pos")
    return single.unionByName(whole)


def epoch(train: DataFrame, seed: int, number: int, hard: int = 3, pairs: float = 0.15, replay: DataFrame | None = None, ratio: float = 2.0) -> DataFrame:
    """(kind, pos, ids, audio, text, seconds) of one epoch.

    All items; hard ones ``hard`` times in all; with probability ``pairs`` a single
    item followed by a drawn single one, if both are short enough; and rehearsal
    rows, ``ratio`` for each item so far. ``pos`` has to be dense from 0.
    """
    base = train.select("pos", "ids", "audio", "text", "seconds", "hard")
    plain = base.withColumn("kind", F.lit("item"))
    again = base.where("hard").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(hard - 1)))).drop("_n").withColumn("kind", F.lit("repeat")) if hard > 1 else plain.limit(0)
    total = base.agg(F.count(F.lit(1)).alias("_total"))
    singles = base.where(F.size("ids") == 1)
    picked = singles.where(uniform(seed, number, "pick", F.col("pos")) < pairs).crossJoin(F.broadcast(total))  # one row
    picked = picked.withColumn("_other", draw(F.col("_total"), seed, number, "partner", F.col("pos")))
    partner = singles.select(F.col("pos").alias("_other"), F.col("audio").alias("_audio"), F.col("text").alias("_text"), F.col("seconds").alias("_seconds"), F.col("ids").alias("_ids"))
    both = picked.join(partner, "_other").where((F.col("_other") != F.col("pos")) & (F.col("seconds") + F.col("_seconds") < LONGEST_PAIR))
    paired = both.select("pos", F.concat("ids", "_ids").alias("ids"), F.concat("audio", "_audio").alias("audio"), tx.join_texts(F.array("text", "_text"), False).alias("text"), (F.col("seconds") + F.col("_seconds")).alias("seconds"), "hard", F.lit("pair").alias("kind"))
    made = plain.unionByName(again).unionByName(paired)
    if replay is not None:
        wanted = round(ratio * made.count())  # half to even
        drawn = sampled(replay, wanted, F.col("id"), f"{seed}:{number}").select(F.lit(None).cast("bigint").alias("pos"), F.array("id").alias("ids"), F.array("audio").alias("audio"), "text", "seconds", F.lit(False).alias("hard"), F.lit("replay").alias("kind"))
        made = made.unionByName(drawn)
    return made.drop("hard")


def _closes(lengths: np.ndarray, held: int, max_cells: int, max_items: int) -> int:
    """How many of these items an open batch of ``held`` items takes before it closes; all if it stays open."""
    ahead = lengths[: max(max_items - held, 0)]
    over = np.flatnonzero(ahead * (held + 1 + np.arange(len(ahead))) > max_cells)
    if held == 0:
        over = over[over > 0]  # a batch has one item at least
    return int(over[0]) if len(over) else min(len(ahead), len(lengths))


def _runs(shards: np.ndarray) -> list[tuple[int, int]]:
    ends = np.flatnonzero(np.r_[shards[1:] != shards[:-1], True]) + 1
    return list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True))


def _walked(lengths: np.ndarray, held: int, max_cells: int, max_items: int, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(items in the batch open at the end, batches closed) if ``held`` items are in the open batch at the start.

    ``known`` has the same for a batch that begins at a place: walks soon meet one
    that was there before, so all of them together are little more than one.
    """
    if not len(lengths):
        return held, 0
    at = _closes(lengths, held, max_cells, max_items)
    if at == len(lengths):
        return held + at, 0
    path = []
    while at not in known:
        path.append(at)
        took = _closes(lengths[at:], 0, max_cells, max_items)
        if at + took == len(lengths):
            known[at] = took, 0
            break
        at += took
    for place in reversed(path):
        if place not in known:
            known[place] = known[at][0], known[at][1] + 1
        at = place
    return known[at][0], known[at][1] + 1


def _read(batches_) -> tuple[np.ndarray, ...]:
    cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches_]
    return tuple(np.concatenate(c) for c in zip(*cols, strict=True)) if cols else ()


def batches(rows: DataFrame, max_cells: int = 480, max_items: int = 24, seed: int = 0, jitter: bool = True, shards: int = 1) -> DataFrame:
    """(shard, batch, turn, pos, length): items by length with some jitter; a batch closes before its padded cells or items exceed a limit.

    Where a batch ends depends on where it began, but all that a range of the sorted
    items needs to know of those before is how many items the open batch has: at
    most ``max_items``. So each range, in parallel, says for each such number what
    it leaves behind, these small maps are applied one after another on the driver
    (``max_items`` numbers a partition), and each range numbers its batches. The
    result is that of one pass over all items. ``shards`` > 1 deals items out by hash
    first, and each shard has batches of its own. ``turn`` is a sort key that shuffles
    the batches. Lengths have to be positive.
    """
    if max_items < 1:
        raise ValueError("a batch holds one item at least")
    key = F.col("length") + (uniform(seed, F.col("pos")) if jitter else F.lit(0.0))
    shard = F.pmod(F.xxhash64("pos"), F.lit(shards)).cast("int")
    queue = rows.select(shard.alias("shard"), key.alias("key"), F.col("pos").cast("bigint").alias("pos"), F.col("length").cast("bigint").alias("length"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are drawn from a sample, so what they came out as is written down before it is read twice
    queue = cut(queue.repartitionByRange(n, "shard", "key", "pos").sortWithinPartitions("shard", "key", "pos").select("shard", "pos", "length"))
    queue = queue.select(F.spark_partition_id().alias("part"), "shard", "pos", "length")

    def told(batches_):
        import pyarrow as pa

        found = _read(batches_)
        if found:
            part, shard_, _, lengths = found
            ends = _runs(shard_)
            first = lengths[: ends[0][1]]
            known: dict = {}
            maps = [_walked(first, held, max_cells, max_items, known) for held in range(max_items + 1)]
            last = _walked(lengths[ends[-1][0] :], 0, max_cells, max_items, {}) if len(ends) > 1 else None
            values = [[int(part[0])], [int(shard_[0])], [int(shard_[-1])], [[x for m in ([last] if last else maps) for x in m]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["part", "first", "last", "state"])

    starts: dict[int, tuple[int, int]] = {}
    now, held, number = None, 0, 0
    for r in sorted(queue.mapInArrow(told, "part int, first int, last int, state array<bigint>").collect()):  # a row for each partition
        if r["first"] != now:
            held, number = 0, 0
        starts[r["part"]] = held, number
        if r["first"] == r["last"]:
            held, number = r["state"][2 * held], number + r["state"][2 * held + 1]
        else:
            held, number = r["state"]
        now = r["last"]

    def run(batches_):
        import pyarrow as pa

        now = None
        for b in batches_:
            part, shard_, pos, lengths = _read([b])
            if not len(part):
                continue
            if now is None:
                now, (held, number) = shard_[0], starts[int(part[0])]
            numbers = np.empty(len(part), np.int64)
            for a, e in _runs(shard_):
                if shard_[a] != now:
                    now, held, number = shard_[a], 0, 0
                while a < e:
                    took = _closes(lengths[a:e], held, max_cells, max_items)
                    numbers[a : a + took] = number
                    a, held = a + took, held + took
                    if a < e:
                        held, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(shard_, pa.int32()), pa.array(numbers, pa.int32()), pa.array(pos, pa.int64()), pa.array(lengths, pa.int64())], ["shard", "batch", "pos", "length"])

    dealt = queue.mapInArrow(run, "shard int, batch int, pos bigint, length bigint")
    return dealt.select("shard", "batch", order_key(seed, "batch", F.col("shard"), F.col("batch")).alias("turn"), "pos", "length")


def mixed(base: DataFrame, tuned: DataFrame, weight: float) -> DataFrame:
    """(name, is_float, values): base + weight * (tuned - base); what is no float stays as in the base."""
    from speechmill.functions.signal import mix_weights

    both = base.join(tuned.select("name", F.col("values").alias("_tuned")), "name", "left")
    moved = F.col("is_float") & F.col("_tuned").isNotNull()
    return both.select("name", "is_float", F.when(moved, mix_weights(F.col("values"), F.col("_tuned"), weight)).otherwise(F.col("values")).alias("values"))


def foreign_weights(base: DataFrame, tuned: DataFrame, most: int = 3) -> list[str]:
    """Up to ``most`` names that the tuned weights have and the base lacks."""
    return [r[0] for r in tuned.join(base, "name", "left_anti").select("name").orderBy("name").limit(most).collect()]


def lora_merge(w: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """(i, j, value) of W + scale * (B A), from cells (i, j, value) of W, (r, j, value) of A and (i, r, value) of B."""
    low = b.select("i", "r", F.col("value").alias("_b")).join(a.select("r", "j", F.col("value").alias("_a")), "r")
    delta = low.groupBy("i", "j").agg(F.sum(F.col("_b") * F.col("_a")).alias("_d"))
    return w.join(delta, ["i", "j"], "left").select("i", "j", (F.col("value") + F.lit(float(scale)) * F.coalesce("_d", F.lit(0.0))).alias("value"))


#: Families of blocks in order with the number of blocks, and what is always trained, or from 21 blocks on.
FAMILIES = (("encoder.encoders0.", 1), ("encoder.encoders.", 49), ("encoder.tp_encoders.", 20))
ALWAYS, FROM_21 = ("ctc.", "encoder.tp_norm"), ("encoder.after_norm",)


def block_place(name: Column) -> Column:
    """A parameter's place among all blocks, from 0; null outside of them."""
    place, before = F.lit(None).cast("int"), 0
    for prefix, count in FAMILIES:
        number = F.regexp_extract(name, "^" + prefix.replace(".", r"\.") + r"([0-9]+)\.", 1).try_cast("int")
        place, before = F.when(number < count, number + before).otherwise(place), before + count
    return place


def top_blocks(names: DataFrame, n: int) -> DataFrame:
    """Rows whose ``name`` is trained when the last n blocks are: those blocks, the output layer and the norms that follow."""
    total = sum(count for _, count in FAMILIES)
    chosen = F.coalesce(block_place(F.col("name")) >= total - n, F.lit(False)) if n else F.lit(False)
    for prefix in ALWAYS + (FROM_21 if n > 20 else ()):
        chosen = chosen | F.startswith(F.col("name"), F.lit(prefix))
    return names.where(chosen)


def train_spec(text: str) -> tuple[str, int]:
    """(kind, number) of "all", "lora:<rank>" or "top:<blocks>"; anything else raises."""
    kind, _, number = text.partition(":")
    if kind == "all" and not number:
        return kind, 0
    if kind not in ("lora", "top") or not number.isascii() or not number.isdigit() or (kind == "lora" and int(number) == 0):
        raise ValueError(f"what is trained is all, lora:<rank> or top:<blocks>, not {text!r}")
    return kind, int(number)


def trainable(text_ids: Column, frames: Column) -> Column:
    """Whether an item can be trained on: a target, and at least as many frames as labels."""
    return (F.size(text_ids) > 0) & (frames >= F.size(text_ids))
