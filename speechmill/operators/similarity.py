"""Groups of near-identical transcripts: a token-level similarity join, and folds that keep groups whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechmill.functions.distance import hashed, near, token_distance
from speechmill.operators.components import connected_components
from speechmill.sources.shared import cut, delete, release, stored


def forms(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(pos, form): a row's tokens, and those of the whole sentence it carries on, if that differs."""
    parts = rows.select("pos", F.posexplode_outer("joins").alias("at", "id")).where("id is not null")
    whole = parts.join(rows.select("id", F.col(tokens).alias("_part")), "id").groupBy("pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "_part"))), lambda x: x["_part"])).alias("before"))
    both = rows.join(whole, "pos", "left").select("pos", F.array_distinct(F.array(F.col(tokens), F.concat(F.coalesce("before", F.array().cast("array<string>")), F.col(tokens)))).alias("forms"))
    return both.select("pos", F.explode("forms").alias("form"))


#: A power of two: forms that one key may have. A form's id is that times its least key, and a number.
FORMS = 16
#: Pairs of a frequent piece that one task compares at most.
PAIRS = 5_000_000
#: So many hashes of tokens may be broadcast.
FEW = 200_000
#: Pieces that a partition of a shuffle gets in one pass, about.
PIECES = 400_000
#: Pieces are first counted by so many buckets.
BUCKETS = 1 << 18


def _passes(pieces: int, partitions: int) -> int:
    return max(1, -(-pieces // (PIECES * partitions)))


def _pieces(uniq: DataFrame, kinds: tuple = (0, 1, 2)) -> DataFrame:
    """(form_id, len, at, kind, piece): every token (kind 0) and every two neighbours (kind 1 at even places, 2 at odd ones) of a form, hashed; and ``coded``, if a form has it."""
    piece = lambda kind, at, *tokens: F.struct(kind.alias("kind"), at.alias("at"), F.xxhash64(F.lit(len(tokens)), *tokens).alias("piece"))
    alone = F.transform("form", lambda t, i: piece(F.lit(0), i, t))
    pairs = F.array_compact(F.transform("form", lambda t, i: F.when(i + 1 < F.col("len"), piece(i % 2 + 1, i, t, F.get("form", i + 1)))))
    made = ([alone] if 0 in kinds else []) + ([pairs] if 1 in kinds else [])
    own = ["form_id", "len", *(["coded"] if "coded" in uniq.columns else [])]
    return uniq.select(*own, F.explode(F.concat(*made)).alias("p")).select(*own, "p.at", "p.kind", "p.piece")


def _signatures(pieces: DataFrame, threshold: float) -> DataFrame:
    """(form_id, len, most, at, piece, times, kind) of the index: ``most`` + 1 pieces of each form that do not overlap.

    ``most`` edits touch ``most`` of them, so a form within that distance has one
    of them unchanged. Any such pieces will do: of the tokens, the pairs at even and
    those at odd places, a form takes those whose most + 1 rarest ones are rarest in all.
    """
    most = F.floor(F.lit(float(threshold)) * F.col("len")).cast("int")
    dear = F.coalesce("times", F.when(F.col("kind") == 0, 2).otherwise(1).cast("bigint"))
    forms_ = pieces.withColumn("most", most).where("most > 0").groupBy("form_id", "len", "most").agg(F.collect_list(F.struct(dear.alias("dear"), "at", "piece", "times", "kind")).alias("all"))  # of one form

    def best(kind: int) -> Column:
        return F.slice(F.array_sort(F.filter("all", lambda x: x["kind"] == kind)), 1, F.col("most") + 1)

    ways = F.array(*[F.struct(F.aggregate(F.transform(best(k), lambda x: x["dear"]), F.lit(0).cast("bigint"), lambda t, x: t + x).alias("dear"), F.lit(-k).alias("kind"), best(k).alias("chosen")) for k in range(3)])
    chosen = F.array_min(F.filter(ways, lambda w: F.size(w["chosen"]) > F.col("most")))["chosen"]
    return forms_.select("form_id", "len", "most", F.explode(chosen).alias("p")).select("form_id", "len", "most", "p.at", "p.piece", "p.times", "p.kind")


def _met(uniq: DataFrame, threshold: float, share: int = 10_000) -> DataFrame:
    """(x, y, piece, row, col), and both texts ``cx`` and ``cy`` if forms have ``coded``, of forms that have a piece of x's signature in common, at places that so few edits allow; x is the longer one.

    Pieces that more than one in ``share`` places have are few enough to be broadcast
    with their numbers. Forms avoid them where they can. Where they cannot, the
    signatures and the places of such a piece are the rows and columns of a grid whose
    cells, of ``PAIRS`` pairs at most, are dealt to tasks; where no signature has it
    its places are left out.
    """
    spark, plain = uniq.sparkSession, uniq.select("form_id", "form", "len")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces, bucket = _pieces(plain), F.pmod("piece", F.lit(BUCKETS)).alias("bucket")
    total = uniq.agg(F.sum(2 * F.col("len") - 1)).first()[0] or 0
    full = cut(pieces.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > total).select("bucket"))  # at most ``share`` rows
    counts = pieces.select("piece", bucket).join(F.broadcast(full), "bucket", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("times"))
    often = cut(counts.where((F.col("times") * share > total) & (F.col("times") > 1)))  # at most ``share`` rows
    index, count = None, _passes(total, n)
    for k in range(count):  # what a pass sorts is a share of all pieces
        some = plain.where(F.pmod(F.xxhash64("form_id"), F.lit(count)) == k).repartition(n, "form_id")  # so that a form's pieces need not be shuffled to choose among them
        one = cut(_signatures(_pieces(some).join(F.broadcast(often), "piece", "left"), threshold))
        index = one if index is None else index.unionByName(one)
        release(spark)
    taken = index.where("times is not null").groupBy("piece").agg(F.count(F.lit(1)).alias("signed"), F.first("times").alias("times"))
    cells = F.ceil(F.col("signed") * F.col("times") / F.lit(float(min(max(total // 1000, 1000), PAIRS))))
    cols = F.least(F.ceil(F.sqrt(cells * F.col("times") / F.col("signed"))), cells)
    grid = cut(taken.select("piece", F.ceil(cells / cols).cast("int").alias("rows"), cols.cast("int").alias("cols")))
    idle = often.join(grid, "piece", "left_anti").select("piece")

    def dealt(rows: DataFrame, id_: str, at: str, own: str, other: str) -> DataFrame:
        """A row's own line of the grid, and every line that crosses it."""
        one = lambda c: F.coalesce(c, F.lit(1))
        placed = rows.join(F.broadcast(grid), "piece", "left").withColumn(own, F.pmod(F.xxhash64(id_, at), one(F.col(f"{own}s"))).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), one(F.col(f"{other}s")) - 1))).drop("rows", "cols")

    carried = "coded" in uniq.columns
    signed = index.drop("times", "kind")
    if carried:
        signed = signed.join(uniq.select("form_id", F.col("coded").alias("cx")), "form_id")
    signed = dealt(signed, "form_id", "at", "row", "col")
    tokens = cut(index.where("kind = 0").select("piece").distinct())  # single tokens are rarely what a form takes
    single = _pieces(uniq, (0,)).join(F.broadcast(tokens) if tokens.count() <= FEW else tokens, "piece", "left_semi")
    pairs = _pieces(uniq, (1, 2))
    probes = pairs.unionByName(single.select(pairs.columns)).join(F.broadcast(idle), "piece", "left_anti").select(F.col("form_id").alias("y"), F.col("len").alias("m"), F.col("at").alias("q"), "piece", *([F.col("coded").alias("cy")] if carried else []))
    met = signed.join(dealt(probes, "y", "q", "col", "row"), ["piece", "row", "col"])
    longer = (F.col("len") > F.col("m")) | ((F.col("len") == F.col("m")) & (F.col("form_id") > F.col("y")))
    shift, gap = F.col("at") - F.col("q"), F.col("len") - F.col("m")
    fits = (gap <= F.col("most")) & (F.abs(shift) + F.abs(gap - shift) <= F.col("most"))  # edits before the piece, and after it
    return met.where(longer & fits).select(F.col("form_id").alias("x"), "y", "piece", "row", "col", *(["cx", "cy"] if carried else []))


def _similar_forms(rows: DataFrame, threshold: float, key: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(x, y) of distinct forms that are similar, and (form_id, member) of all keys; see :func:`least_key` for a form's id."""
    spark = rows.sparkSession
    distinct, told = stored(rows.where(F.size(tokens) > 0).select(F.col(tokens).alias("form"), key).distinct())
    release(spark)
    least = distinct.groupBy("form").agg(F.min(key).alias("least"))
    nth = F.row_number().over(Window.partitionBy("least").orderBy("form")) - 1  # a key has two forms: its own and the whole sentence
    number = F.when(nth < FORMS, F.col("least") * FORMS + nth).otherwise(F.raise_error(F.lit("a key has too many forms")))
    uniq, path = stored(least.select("form", number.cast("bigint").alias("form_id"), F.size("form").alias("len"), hashed(F.col("form")).alias("coded")))
    release(spark)
    members = cut(distinct.join(uniq.select("form", "form_id"), "form").select("form_id", F.col(key).alias("member")))
    delete(spark, told)
    release(spark)
    met, seen = _met(uniq, threshold), None
    count = _passes(uniq.agg(F.sum(2 * F.col("len") - 1)).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(count):  # the pieces of a pass meet where the texts are compared, so that candidates are never written
        one = cut(met.where((F.pmod("piece", F.lit(count)) == k) & near(F.col("cx"), F.col("cy"), threshold)).select("x", "y").distinct())
        seen = one if seen is None else seen.unionByName(one)
        release(spark)
    form = uniq.select(F.col("form_id"), F.col("form"))
    both = seen.distinct().join(form.toDF("x", "fx"), "x").join(form.toDF("y", "fy"), "y")
    found = cut(both.where(token_distance(F.col("fx"), F.col("fy")) <= F.floor(F.lit(float(threshold)) * F.greatest(F.size("fx"), F.size("fy")))).select("x", "y"))
    release(spark)
    delete(spark, path)
    return found, members


def least_key(form_id: Column) -> Column:
    """The least key of those that have a form."""
    return F.shiftright(form_id, FORMS.bit_length() - 1)


def similar_pairs(rows: DataFrame, threshold: float = 0.3, key: str = "pos", tokens: str = "form") -> DataFrame:
    """(i, j), i > j: keys of which two forms are within ``threshold`` of the longer one's tokens.

    Exact. Distinct forms are compared once; what is returned are all pairs of keys,
    members of one form included. For groups :func:`similar_links` is enough.
    """
    found, members = _similar_forms(rows, threshold, key, tokens)
    ids = members.select(F.col("form_id").alias("x"), F.col("form_id").alias("y")).distinct()
    pairs = found.unionByName(ids).join(members.toDF("x", "mx"), "x").join(members.toDF("y", "my"), "y")
    return pairs.where("mx <> my").select(F.greatest("mx", "my").alias("i"), F.least("mx", "my").alias("j")).distinct()


def similar_links(rows: DataFrame, threshold: float = 0.3, key: str = "pos", tokens: str = "form") -> DataFrame:
    """(src, dst) with the components of :func:`similar_pairs`: a link for each pair of similar forms, and one for each member of a form."""
    found, members = _similar_forms(rows, threshold, key, tokens)
    own = members.select(least_key(F.col("form_id")).alias("src"), F.col("member").alias("dst"))
    return found.select(least_key(F.col("x")).alias("src"), least_key(F.col("y")).alias("dst")).unionByName(own).where("src <> dst")


def group_labels(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds ``group``: the smallest ``pos`` of all rows joined by session or by similar forms.

    Needs pos, id, session, joins and tokens. A session is a star around its first
    row: only the closure matters.
    """
    star = rows.select(F.col("pos").alias("src"), F.min("pos").over(Window.partitionBy("session")).alias("dst"))
    found = connected_components(star.unionByName(cut(similar_links(forms(rows), threshold))))
    return rows.join(found.withColumnRenamed("node", "pos"), "pos", "left").withColumn("group", F.coalesce("component", "pos")).drop("component")


def exact_group_roots(edges: list[tuple[int, int]], n: int) -> list[int]:
    """Roots as unions in row-major order leave them; for small inputs that must repeat such ids."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted((max(e), min(e)) for e in edges):
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def label_groups(rows: DataFrame, threshold: float = 0.3, exact_rows: int = 2000) -> DataFrame:
    """:func:`group_labels`, whose ids up to ``exact_rows`` rows are places in the order of ``pos`` as unions in row-major order leave them."""
    places = [r[0] for r in rows.select("pos").orderBy("pos").limit(exact_rows + 1).collect()]
    if len(places) > exact_rows:
        return group_labels(rows, threshold)
    at = {p: i for i, p in enumerate(places)}
    together = rows.select("session", F.col("pos").alias("i")).join(rows.select("session", F.col("pos").alias("j")), "session").where("i > j").select("i", "j")
    edges = similar_pairs(forms(rows), threshold).unionByName(together).distinct().collect()  # of so few rows
    roots = exact_group_roots([(at[e["i"]], at[e["j"]]) for e in edges], len(places))
    named = rows.sparkSession.createDataFrame(list(zip(places, roots, strict=True)), "pos long, group long")
    return rows.join(F.broadcast(named), "pos")


def balanced_folds(rows: DataFrame, k: int, seed: int = 0, order: list | None = None) -> DataFrame:
    """Adds ``fold``: groups by falling seconds, each to the lightest fold (the first of equals).

    Each step needs the loads that the one before left, so one row a group, sorted
    by Spark, streams through one task that holds k loads; rows never do. Ties in
    seconds are broken by a hash of seed and group, or by ``order``, a list of
    groups, where a given order has to be repeated. Loads are summed as decimals,
    so their order does not matter.
    """
    from speechmill.functions.portable import order_key

    tie = order_key(seed, F.col("group")) if order is None else F.format_string("%010d", F.array_position(F.array(*map(F.lit, order)), F.col("group")))
    load = rows.groupBy("group").agg(F.sum(F.col("seconds").cast("decimal(28,9)")).cast("double").alias("load"))
    queue = load.select("group", F.coalesce("load", F.lit(0.0)).alias("load"), tie.alias("tie")).repartition(1).sortWithinPartitions(F.desc("load"), "tie", "group")

    def deal(batches):
        import pyarrow as pa

        loads = [0.0] * k
        for b in batches:
            folds = []
            for x in b.column(1).to_pylist():
                fold = loads.index(min(loads))
                loads[fold] += x
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(folds, pa.int32())], ["group", "fold"])

    dealt = queue.select("group", "load").mapInArrow(deal, T.StructType([load.schema["group"], T.StructField("fold", T.IntegerType())]))
    return rows.join(dealt, "group")


def fold_report(rows: DataFrame, k: int) -> DataFrame:
    """(fold, utterances, minutes, verified) for each of k folds, empty ones included."""
    found = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("utterances"), (F.sum("seconds") / 60).alias("minutes"), F.count_if(F.col("grade") == "A").alias("verified"))
    every = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    return every.join(found, "fold", "left").na.fill(0, ["utterances", "verified"]).na.fill(0.0, ["minutes"])
