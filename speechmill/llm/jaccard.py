"""N-gram Jaccard join by vertical partitioning.

1. Every text becomes its set of shingles; equal sets are one entity from there
   on. The range of shingles is cut into parts, and each part finds the shingles
   that two or more entities have, with their exact document frequency.
2. In the global order (frequency, shingle) a pair that is similar enough must
   share a shingle of each side's prefix. Shingles that one entity alone has come
   first and need not be kept: an entity whose prefix holds none that are shared
   is linked with nothing.
3. What shares a prefix shingle and fits in size is chained into groups, a
   superset of the wanted components. The global order is cut into fragments, and
   overlaps are counted fragment by fragment and summed for each pair; a pair that
   cannot reach the threshold any more is left out. The sets of a small group meet
   in one task, which does so by itself. The sets of a large group are compared
   with a few leaders first: fragments of blocks of sets are dealt to tasks, and
   partial overlaps are summed by a shuffle. Only what that leaves outside of a
   group's largest part is compared with every block. Links that join something
   new leave a task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import cut, groups_of, id_text, join_skewed, packed, partitions, rows_of, tidy, unpacked
from speechmill.llm.shingles import mix, shingle_set
from speechmill.operators.components import connected_components
from speechmill.sources.shared import release

FLUSH, HOT, HOT_LEAST = 4_000_000, 128, 1000
#: So many rows of keys, some 40 bytes each, may be broadcast.
FEW = 200_000


def _entity(s: np.ndarray) -> int:
    """Identity of a set: 62 bits, so that it is a positive long."""
    i = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(s + i * np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)], np.uint64))[0] >> np.uint64(2))


def _sets(k: int):
    """Kind 0: size and entity of each row. Kind 1: how many sets of a flush have a frequent gram. Kind 2: sets of a flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def batch(kind: int, ids: list, n, entity: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(entity, pa.int64())], ["kind", "doc_id", "n_shingles", "entity"])

        def counts() -> Iterator[pa.RecordBatch]:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n * 2 * HOT > len(held)
            yield batch(1, grams[often].view(np.int64), n[often], [None] * int(often.sum()))
            yield batch(2, [None], [len(held)], [None])

        for ids, texts in rows_of(batches):
            sets = [shingle_set(t, k) for t in texts]
            yield batch(0, ids, [len(s) for s in sets], [_entity(s) if len(s) else None for s in sets])
            for s in sets:
                if len(s):
                    held.append(s)
                    size += len(s)
                    if size >= FLUSH:
                        yield from counts()
                        held, size = [], 0
        if held:
            yield from counts()

    return run


def _hot_grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams that more than one in ``HOT`` sets have, and their counts: at most ``HOT`` times the mean size of a set."""
    total = rows.where("kind = 2").agg(F.sum("n_shingles")).first()[0] or 0
    often = rows.where("kind = 1").groupBy("doc_id").agg(F.sum("n_shingles").alias("n")).where((F.col("n") * HOT > total) & (F.col("n") >= HOT_LEAST))
    found = sorted((int(np.int64(r[0]).view(np.uint64)), r[1]) for r in often.toLocalIterator())
    return np.array([g for g, _ in found], np.uint64), np.array([n for _, n in found], np.uint32)


def _parts(k: int, bits: int, dests: int, hot: np.ndarray, hot_count: np.ndarray):
    """(part, blob of shingle, entity, size) of all that a task reads, each entity once a flush.

    Hot shingles, whose counts are known, go straight to their entities' shards,
    under part -1 - shard; so no part gets all entities that have one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            ids, sizes = np.fromiter(sets, np.int64, len(sets)), np.array([len(s) for s in sets.values()], np.int32)
            h = np.concatenate(list(sets.values()))
            who = np.repeat(np.arange(len(ids)), sizes)
            names, blobs = [], []
            slot = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
            if len(hot) and (known := hot[slot] == h).any():
                e, g, df, n = ids[who[known]], h[known], hot_count[slot[known]], sizes[who[known]]
                order = np.lexsort((e, e % dests))
                e, g, df, n = e[order], g[order], df[order], n[order]
                at = np.searchsorted(e % dests, np.arange(dests + 1))
                for d in range(dests):
                    a, b = at[d], at[d + 1]
                    if a < b:
                        names.append(-1 - d)
                        blobs.append([packed(e[a:b], g[a:b], df[a:b], n[a:b]), b""])
                h, who = h[~known], who[~known]
            order = np.argsort(h)
            h, who = h[order], who[order]
            ends = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
            for p, (a, b) in enumerate(zip(np.r_[0, ends], np.r_[ends, len(h)], strict=True)):
                if a < b:
                    at, slot = np.unique(who[a:b], return_inverse=True)
                    names.append(p)
                    blobs.append([packed(h[a:b], slot.astype(np.uint32)), packed(ids[at], sizes[at])])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.binary())], ["part", "grams", "entities"])

        for _, texts in rows_of(batches):
            for t in texts:
                s = shingle_set(t, k)
                if len(s) and (e := _entity(s)) not in sets:
                    sets[e] = s
                    held += len(s)
                    if held >= FLUSH:
                        yield flush()
                        sets, held = {}, 0
        if sets:
            yield flush()

    return run


def _shared(dests: int):
    """Shingles of a part that two entities or more have: (dest, blob of entity, shingle, frequency, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groups_of(batches):
            if part < 0:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["dest", "blob"])
                continue
            hs, es, ns = [], [], []
            for _, grams, entities in rows:
                h, slot = unpacked(grams, "<u8", "<u4")
                ids, sizes = unpacked(entities, "<i8", "<i4")
                hs.append(h)
                es.append(ids[slot])
                ns.append(sizes[slot])
            h, e, n = map(np.concatenate, (hs, es, ns))
            order = np.argsort(h)
            h = h[order]
            new = np.r_[True, h[1:] != h[:-1]]
            alone = new & np.r_[new[1:], True]
            order, h = order[~alone], h[~alone]
            e, n = e[order], n[order]
            order = np.lexsort((e, h))  # an entity that several flushes had counts once
            h, e, n = h[order], e[order], n[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (e[1:] != e[:-1])] if len(h) else np.zeros(0, bool)
            h, e, n = h[once], e[once], n[once]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(h)])
            df = np.repeat(count, count)
            keep = df > 1
            h, e, n, df = h[keep], e[keep], n[keep], df[keep]
            dest = e % dests
            order = np.lexsort((e, dest))
            h, e, n, df, dest = h[order], e[order], n[order], df[order], dest[order]
            at = np.searchsorted(dest, np.arange(dests + 1))
            names = [d for d in range(dests) if at[d] < at[d + 1]]
            blobs = [packed(e[a:b], h[a:b], df[a:b].astype(np.uint32), n[a:b]) for a, b in ((at[d], at[d + 1]) for d in names)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["dest", "blob"])

    return run


def _prefixes(percent: int):
    """Entities whose prefix has shared shingles: (entity, n, prefix, grams in global order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches):
            e, h, df, n = map(np.concatenate, zip(*[unpacked(r[1], "<i8", "<u8", "<u4", "<i4") for r in rows], strict=True))
            order = np.lexsort((h, e))
            e, h, df, n = e[order], h[order], df[order], n[order]
            once = np.r_[True, (e[1:] != e[:-1]) | (h[1:] != h[:-1])]  # several flushes may have sent a hot shingle
            e, h, df, n = e[once], h[once], df[once], n[once]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            held = np.diff(np.r_[first, len(e)])
            size = n[first].astype(np.int64)
            wanted = size - (percent * size + 99) // 100 + 1 - (size - held)
            out = []
            for i in np.flatnonzero(wanted > 0):
                a, b = first[i], first[i] + held[i]
                ranked = h[a:b][np.lexsort((h[a:b], df[a:b]))]
                out.append((int(e[a]), int(size[i]), ranked[: wanted[i]].astype(np.int64).tolist(), ranked.tobytes()))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], ["entity", "n", "prefix", "grams"])

    return run


def spanning_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, fragments: int = 4) -> list[tuple[int, int]]:
    """Links that join the components of these sets; ``sets`` may lack what no other set has.

    Each round takes one reached set and asks which sets not reached yet it is
    linked with. The shingles' range is cut into fragments: overlaps are counted
    per fragment and summed, and a set is dropped once it cannot reach the
    threshold.
    """
    total = np.concatenate(sets)
    terms, code = np.unique(total, return_inverse=True)
    edges = np.linspace(0, len(terms), fragments + 1).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cuts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        inside = (code >= a) & (code < b)
        cuts.append((code[inside], owner[inside]))
    rows = [(c, np.searchsorted(o, np.arange(len(sets) + 1))) for c, o in cuts]
    held = np.stack([np.diff(at) for _, at in rows], 1)
    later = held[:, ::-1].cumsum(1)[:, ::-1]  # of each set, shingles in this fragment and after
    waiting = np.ones(len(sets), bool)
    mark = np.zeros(len(terms), np.int32)
    out: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        reached = [seed]
        while reached:
            x = reached.pop()
            ask = np.flatnonzero(waiting)
            need = -(-percent * (sizes[ask] + sizes[x]) // (100 + percent))  # 100 o >= p (a + b - o)
            ask, need = ask[(small := np.minimum(sizes[ask], sizes[x]) >= need)], need[small]
            got = np.zeros(len(ask), np.int64)
            for f, (c, at) in enumerate(rows):
                if not len(ask):
                    break
                mine = c[at[x] : at[x + 1]]
                mark[mine] = 1
                size = at[ask + 1] - at[ask]
                ends = np.cumsum(size)
                spot = np.arange(ends[-1]) + np.repeat(at[ask] - (ends - size), size)
                sums = np.r_[0, np.cumsum(mark[c[spot]])]
                got = got + sums[ends] - sums[ends - size]
                mark[mine] = 0
                if f + 1 < len(rows):
                    can = got + np.minimum(later[ask, f + 1], later[x, f + 1]) >= need
                    ask, need, got = ask[can], need[can], got[can]
            for y in ask[got >= need]:
                waiting[y] = False
                reached.append(int(y))
                out.append((x, int(y)))
    return out


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches):
            ids = [r[1] for r in rows]
            links = spanning_links([np.frombuffer(r[3], "<u8") for r in rows], np.array([r[2] for r in rows], np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.int64()), pa.array([ids[b] for _, b in links], pa.int64())], ["src", "dst"])

    return run


def _candidates(kept: DataFrame, percent: int) -> DataFrame:
    """(src, dst): edges that put entities with a common prefix shingle and fitting sizes into one group.

    Sizes are cut into bands so narrow that two fitting ones lie in one band or in
    two neighbours. The entities of a shingle and band are joined to one of them,
    and those of neighbouring bands to each other.
    """
    band = F.floor(F.log("n") / -math.log(percent / 100 - 1e-6))
    slots = kept.select("entity", F.explode("prefix").alias("gram"), band.alias("band"))
    slots = slots.select("entity", F.xxhash64("gram", "band").alias("slot"), F.xxhash64("gram", F.col("band") + 1).alias("next"))
    leads = cut(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("held"), F.min("entity").alias("lead"), F.first("next").alias("next")))
    total = leads.agg(F.sum("held")).first()[0] or 0
    inside = join_skewed(slots.select("entity", "slot"), leads.where("held > 1").select("slot", "held", "lead"), "slot", "held", total)
    edges = inside.where("entity <> lead").select(F.col("entity").alias("src"), F.col("lead").alias("dst"))
    beside = leads.select(F.col("next").alias("slot"), F.col("lead").alias("src")).join(leads.select("slot", F.col("lead").alias("dst")), "slot").select("src", "dst")
    return edges.unionByName(beside).distinct()


def _with_grams(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``rows`` with the grams of their entities; few of them, counted, go to where the grams are, which then are not shuffled."""
    rows = cut(rows)
    return kept.join(F.broadcast(rows) if rows.count() <= FEW else rows, "entity")


def _compared(units: DataFrame, kept: DataFrame, percent: int, n: int) -> DataFrame:
    """(src, dst): links found in each unit; ``units`` is (unit, entity)."""
    rows = _with_grams(units.distinct(), kept).select("unit", "entity", "n", "grams")
    return cut(rows.repartition(n, "unit").sortWithinPartitions("unit", "entity").mapInArrow(tidy(_linked(percent)), "src long, dst long"))


def _fragments(parts: int):
    """Each row once for each fragment of the global order, with the grams it has there; rows are (key, lead, home, entity, n, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, lead, home, entity, n, grams = (c.to_pylist() for c in b.columns)
            out: list[list] = [[], [], [], [], [], [], []]
            for row in zip(key, lead, home, entity, n, grams, strict=True):
                g = np.sort(np.frombuffer(row[5], "<u8"))
                at = np.searchsorted(g, np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts))
                for f, x in enumerate(np.split(g, at)):
                    for c, v in zip(out, (row[0] * parts + f, *row[1:5], len(g) - len(x), x.tobytes()), strict=True):
                        c.append(v)
            types = (pa.decimal128(38), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["unit", "lead", "home", "entity", "n", "elsewhere", "grams"])

    return run


def _partial(percent: int):
    """Partial overlaps of a fragment: those of each set with each leader, unless the pair cannot reach the threshold any more.

    A leader is in every block of its group; it counts as a set in its own block
    alone, so that each pair has one overlap a fragment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches):
            home = np.array([r[2] for r in rows], bool)
            ids, n, elsewhere = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
            grams = [np.frombuffer(r[6], "<u8") for r in rows]
            owner, every = np.repeat(np.arange(len(rows)), [len(g) for g in grams]), np.concatenate(grams)
            out: list[tuple] = []
            for k in (k for k, r in enumerate(rows) if r[1]):
                mine = grams[k]
                slot = np.minimum(np.searchsorted(mine, every), max(len(mine) - 1, 0))
                got = np.bincount(owner[mine[slot] == every], minlength=len(rows)) if len(mine) else np.zeros(len(rows), np.int64)
                need = -(-percent * (n + n[k]) // (100 + percent))
                can = home & (ids != ids[k]) & (got + np.minimum(elsewhere, elsewhere[k]) >= need) & (got > 0)
                out += [(int(ids[x]), int(ids[k]), int(got[x]), int(need[x])) for x in np.flatnonzero(can)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["src", "dst", "got", "need"])

    return run


def _led(large: DataFrame, kept: DataFrame, percent: int, leaders: int, fragments: int, n: int) -> DataFrame:
    """(src, dst): links of the sets of large groups with a few leaders of their group, by vertical partitioning.

    The global order of shingles is cut into fragments. A task gets one fragment of
    a block of sets and of the leaders, and counts overlaps there; the counts of
    all fragments are summed for each pair.
    """
    least = large.groupBy("component", "mine").agg(F.min("entity").alias("entity"), F.first("blocks").alias("blocks"))
    led = least.groupBy("component").agg(F.max("blocks").alias("blocks"), F.slice(F.array_sort(F.collect_list("entity")), 1, leaders).alias("l"))  # an id for each block
    everywhere = led.select("component", F.explode("l").alias("entity"), "blocks").select("component", "entity", F.explode(F.expr("sequence(0, blocks - 1)")).alias("mine"))
    both = large.select("component", "entity", "mine", F.lit(False).alias("lead"), F.lit(True).alias("home")).unionByName(everywhere.withColumns({"lead": F.lit(True), "home": F.lit(False)}))
    both = _with_grams(both.groupBy("component", "mine", "entity").agg(F.max("lead").alias("lead"), F.max("home").alias("home")), kept)
    key = F.xxhash64("component", "mine").cast("decimal(38,0)").alias("key")
    cutup = both.select(key, "lead", "home", "entity", "n", "grams").mapInArrow(tidy(_fragments(fragments)), "unit decimal(38,0), lead boolean, home boolean, entity long, n long, elsewhere long, grams binary")
    counted = cutup.repartition(n, "unit").sortWithinPartitions("unit", "entity").mapInArrow(tidy(_partial(percent)), "src long, dst long, got long, need long")
    pairs = counted.groupBy("src", "dst").agg(F.sum("got").alias("got"), F.first("need").alias("need"))
    return cut(pairs.where("got >= need").select("src", "dst"))


def _large_groups(large: DataFrame, kept: DataFrame, percent: int, block: int, leaders: int, fragments: int, n: int) -> DataFrame:
    """Links of groups that do not fit in one unit; ``large`` is (component, entity, blocks, mine).

    First every set is compared with a few leaders of its group. What that leaves
    outside of a group's largest part is then compared with every block: a few
    members at most in a group of copies, while nothing that could link is left out.
    """
    first = _led(large, kept, percent, leaders, fragments, n)
    parts = connected_components(first).withColumnRenamed("node", "entity").withColumnRenamed("component", "sub")
    known = cut(large.join(parts, "entity", "left").withColumn("sub", F.coalesce("sub", "entity")))
    main = known.groupBy("component", "sub").agg(F.count(F.lit(1)).alias("size")).groupBy("component").agg(F.max_by("sub", F.struct("size", "sub")).alias("main"))
    outside = known.join(main, "component").where("sub <> main").select("component", "entity", "blocks")
    sizes = outside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("others"))
    outside = outside.join(sizes, "component").withColumn("theirs", F.pmod(F.xxhash64("entity", F.lit(1)), F.col("others")).cast("int"))
    unit = F.xxhash64("component", "mine", "theirs").alias("unit")
    members = known.join(sizes, "component").select("component", "entity", "mine", F.explode(F.expr("sequence(0, others - 1)")).alias("theirs")).select(unit, "entity")
    guests = outside.select("component", "entity", "theirs", F.explode(F.expr("sequence(0, blocks - 1)")).alias("mine")).select(unit, "entity")
    return first.unionByName(_compared(members.unionByName(guests), kept, percent, n))


def jaccard_links(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = 512, leaders: int = 8, fragments: int = 4, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(src, dst): entities linked so that the components of all links come out; see ``entities`` for their rows.

    ``hot`` has frequent shingles and their counts, if they are known already.
    """
    base, n = id_text(docs, id_col, text_col), max(partitions(docs), 1)
    bits = max(n - 1, 1).bit_length()
    hot_grams, hot_counts = hot or _hot_grams(entities(docs, k, id_col, text_col))
    grams = base.mapInArrow(tidy(_parts(k, bits, 2 * n, hot_grams, hot_counts)), "part int, grams binary, entities binary")
    shared = grams.repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_shared(2 * n)), "dest int, blob binary")
    kept = cut(shared.repartition(n, "dest").sortWithinPartitions("dest").mapInArrow(tidy(_prefixes(percent)), "entity long, n long, prefix array<long>, grams binary"))
    release(docs.sparkSession)
    groups = connected_components(_candidates(kept, percent)).withColumnRenamed("node", "entity")
    release(docs.sparkSession)
    size = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = cut(groups.join(size, "component").withColumn("mine", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int")))
    links = _compared(dealt.where("blocks = 1").select(F.col("component").alias("unit"), "entity"), kept, percent, n)
    large = dealt.where("blocks > 1")
    return links if large.isEmpty() else links.unionByName(_large_groups(large, kept, percent, block, leaders, fragments, n))


def entities(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kind 0: (doc_id, n_shingles, entity) of every row; rows with equal sets share an entity, empty sets have none. Other kinds count frequent shingles."""
    return id_text(docs, id_col, text_col).mapInArrow(tidy(_sets(k)), "kind int, doc_id long, n_shingles long, entity long")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest id that links reach. A null or empty text
    has no shingles and is linked with nothing; equal sets are linked. Repeated
    rows stay and share a component; a null id never names a component unless all
    its members have none. An empty table gives an empty result. Sets and
    shingles are told apart by hashes of 62 and 64 bits.
    """
    found = cut(entities(docs, k, id_col, text_col))
    rows = found.where("kind = 0").drop("kind")
    joined = connected_components(jaccard_links(docs, k, percent, id_col, text_col, hot=_hot_grams(found))).withColumnRenamed("node", "entity")
    release(docs.sparkSession)
    sets = rows.where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    rooted = cut(sets.join(joined, "entity", "left").withColumn("root", F.coalesce("component", "entity")).drop("component"))
    roots = cut(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("least").alias("component_id")))
    named = cut(join_skewed(rooted, roots, "root", "members", rooted.count()).select("entity", "copies", "component_id"))
    linked = join_skewed(rows.where("entity is not null"), named, "entity", "copies", rows.count()).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(rows.where("entity is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the smallest id, then the first place.

    Rows whose text is null, empty or blank have no shingles and stay; a null id
    comes after all others; of repeated rows one stays; very long texts are read
    whole; an empty table gives an empty result. Columns may have any names.
    ``docs`` must read the same rows in the same order each time, as a scan of
    files does: rows are told apart by their place.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    found = jaccard_components(keyed.select("place", F.col(f"row.`{text_col}`").alias("text")), k, percent, "place").select(F.col("doc_id").alias("place"), "component_id")
    ids = keyed.select("place", F.col(f"row.`{id_col}`").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("place").alias("place"))
    stay = ids.join(found, "place").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.place").alias("place"))
    return keyed.join(stay, "place", "left_semi").select("row.*")
