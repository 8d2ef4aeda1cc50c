import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill.functions import distance
from speechmill.functions.text import score_tokens
from speechmill.operators import consensus, frontend, passes, resampling, runs, sampling, scoring, sessions, similarity, training
from speechmill.operators.components import connected_components
from speechmill.sources import shared

LOG = "seq long, v int, type string, id string, session string, audio string, seconds double, text string, dictated string, continues boolean"


def log(spark, *records):
    base = dict.fromkeys([c.split()[0] for c in LOG.split(", ")])
    return spark.createDataFrame([tuple((base | {"seq": i, "v": 1} | r).values()) for i, r in enumerate(records)], LOG)


def said(id_, session, text="hi", **more):
    return {"type": "utterance", "id": id_, "session": session, "audio": f"{id_}.wav", "seconds": 1.5, "text": text, "continues": False} | more


def field(session, dictated, text):
    return {"type": "field", "session": session, "dictated": dictated, "text": text}


def test_sessions(spark):
    rows = log(
        spark, said("a-00", "a"), field("a", "x", "x"), field("a", "x", "y"), said("b-00", "b"), {"type": "undone", "session": "b"}, field("b", "q", "q"), said("c-00", "c"), said("c-01", "c"),
        field("d", "k", "k"), said("d-00", "d"), {"type": "refined", "id": "a-00", "text": "first"}, {"type": "refined", "id": "a-00", "text": "last"}, {"type": "strange", "session": "e"},
    )
    kept, dropped = sessions.utterances(rows)
    got = {r.id: (r.status, r["index"], r.of, r.refined, r.field) for r in kept.collect()}
    assert got == {"a-00": ("corrected", 0, 1, "last", "y"), "b-00": ("undone", 0, 1, None, "q"), "c-00": ("unconfirmed", 0, 2, None, None), "c-01": ("unconfirmed", 1, 2, None, None), "d-00": ("accepted", 0, 1, None, "k")}
    assert sessions.session_states(rows).count() == 5  # one session has no utterance
    there = spark.createDataFrame([("c-01.wav",), ("a-00.wav",)], "audio string")
    kept, dropped = sessions.utterances(rows, there)
    assert {r.id: r["index"] for r in kept.collect()} == {"c-01": 1, "a-00": 0}  # places are counted before rows go
    assert {r.status: r.utterances for r in sessions.status_counts(kept, dropped).collect()} == {"unconfirmed": 1, "corrected": 1, "audio missing": 3}


def test_other_versions_are_refused(spark):
    with pytest.raises(Exception, match="unknown record version"):
        sessions.utterances(log(spark, said("a-00", "a", v=2)))[0].collect()
    with pytest.raises(Exception, match="unknown record version"):
        sessions.utterances(log(spark, said("a-00", "a", v=None)))[0].collect()


@pytest.mark.parametrize(("path", "fine"), [("a/b.wav", True), ("../a", False), ("/a", False), ("a//b", False), ("c:\\a", False), ("a\\..\\b", False), ("a\\b.wav", True), ("./a", False)])
def test_paths(spark, path, fine):
    assert spark.createDataFrame([(path,)], "p string").select(sessions.inside(F.col("p"))).first()[0] is fine


def test_chains(spark):
    rows = spark.createDataFrame([(i, f"s-{n:02d}", "s", c) for i, (n, c) in enumerate([(0, False), (1, True), (2, True), (4, True), (5, True), (6, False), (7, None)])], "pos long, id string, session string, continues boolean")
    got = {r.id: r.joins for r in sessions.chains(rows).collect()}
    assert got == {"s-00": [], "s-01": ["s-00"], "s-02": ["s-00", "s-01"], "s-04": [], "s-05": ["s-04"], "s-06": [], "s-07": []}


def test_consensus(spark):
    def graded(hyps, of=1, field_=None, status="accepted", refined=None, review=()):
        rows = spark.createDataFrame([("a", of, field_, status, refined)], "id string, of int, field string, status string, refined string")
        h = spark.createDataFrame([(s, "a", t) for s, t in hyps.items()], "system string, id string, hyp string")
        r = spark.createDataFrame(list(review), "id string, grade string, text string")
        out = consensus.graded(rows.join(consensus.hypothesis_lists(h), "id"), r).first()
        return out.outcome, out.text

    one, two = {"small": "Hello, you"}, {"small": "Hello, you", "other": "hello you"}
    assert graded(two) == ("A", "Hello, you")
    assert graded(one) == ("unreviewed", None)
    assert graded(one, field_="hello you!") == ("A", "Hello, you")
    assert graded(one, field_="hello you!", of=2) == ("unreviewed", None)
    assert graded(one, field_="hello you!", status="undone") == ("unreviewed", None)
    assert graded(two, refined="") == ("unreviewed", None)  # an empty refined text is an opinion
    assert graded({"small": "", "other": ""}) == ("unreviewed", None)
    assert graded(two, review=[("a", "X", "")]) == ("dropped", "")
    assert graded(one, review=[("a", "B", "yes")]) == ("B", "yes")


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_distance(a, b):
    from speechmill.operators.longform import distance

    return distance(a, b)


def test_similar_pairs_and_groups(spark):
    r = random.Random(2)
    base = [[r.choice("abcdefgh") for _ in range(r.randint(1, 14))] for _ in range(25)]
    lists = base + [[w if r.random() > 0.2 else "z" for w in b] for b in base] + [[], [], base[0]]
    rows = spark.createDataFrame([(i, str(i), f"s{i}", x, []) for i, x in enumerate(lists)], "pos long, id string, session string, tokens array<string>, joins array<string>")
    expected = {(i, j) for i in range(len(lists)) for j in range(i) if (n := max(len(lists[i]), len(lists[j]))) and brute_distance(lists[i], lists[j]) <= 0.3 * n}
    got = {(x.i, x.j) for x in similarity.similar_pairs(similarity.forms(rows)).collect()}
    assert got == expected
    groups = {x.pos: x.group for x in similarity.group_labels(rows).collect()}
    roots = similarity.exact_group_roots(sorted(expected), len(lists))
    assert len(groups) == len(lists)
    for i in range(len(lists)):
        for j in range(i):
            assert (groups[i] == groups[j]) == (roots[i] == roots[j])
    assert similarity.exact_group_roots([(3, 0), (3, 1)], 4)[3] == 1  # the last union decides the root


def spoken(n, r, common=1):
    """Sentences that all begin with the same tokens, near copies among them, some carried on by the next."""
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and r.random() < 0.3:
            tokens = [w if r.random() > 0.15 else r.choice(words) for w in r.choice(out)[2]]
            tokens = tokens[: r.randint(max(len(tokens) - 2, 1), len(tokens))]
        else:
            tokens = ["the"] * common + [r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 14, 22]))]
        out.append((i, f"s{i // 3}", tokens, [f"{i - 1}"] if i % 3 and r.random() < 0.4 else []))
    return [(i, str(i), s, t, j) for i, s, t, j in out]


ROWS = "pos long, id string, session string, tokens array<string>, joins array<string>"


def brute_pairs(rows, threshold=0.3):
    by = {r[1]: r[3] for r in rows}
    every = [[r[3], [w for j in r[4] for w in by[j]] + r[3]] for r in rows]
    return {(i, j) for i in range(len(rows)) for j in range(i) if any((n := max(len(a), len(b))) and abs(len(a) - len(b)) <= threshold * n and brute_distance(a, b) <= threshold * n for a in every[i] for b in every[j])}


@pytest.mark.parametrize(("common", "few"), [(1, True), (6, True), (2, False)])
def test_similar_sentences_with_joins_and_a_token_in_all_rows(spark, monkeypatch, common, few):
    rows = spoken(150, random.Random(common), common)
    if not few:
        monkeypatch.setattr(distance, "CHARACTERS", 64)  # the dictionary does not fit: pairs are interned by themselves
    df = spark.createDataFrame(rows, ROWS)
    real = similarity._met
    monkeypatch.setattr(similarity, "_met", lambda u, t: real(u, t, 20))  # pieces of a twentieth of all places are split
    expected = brute_pairs(rows)
    assert {(x.i, x.j) for x in similarity.similar_pairs(similarity.forms(df)).collect()} == expected and len(expected) > 30
    near_ = expected | {(i, j) for i in range(150) for j in range(i) if rows[i][2] == rows[j][2]}
    roots = similarity.exact_group_roots(sorted(near_), len(rows))
    assert [r.group for r in similarity.label_groups(df).orderBy("pos").collect()] == roots
    groups = [r.group for r in similarity.label_groups(df, exact_rows=10).orderBy("pos").collect()]
    least = {}
    for i, x in enumerate(roots):
        least.setdefault(x, i)
    assert groups == [least[x] for x in roots]


def test_pieces_meet_in_passes(spark, monkeypatch):
    """Many passes, texts of tokens whose characters often collide: the same pairs, and nothing is left in the shared folder."""
    monkeypatch.setattr(similarity, "PIECES", 100)
    monkeypatch.setattr(distance, "CHARACTERS", 64)
    rows = spoken(100, random.Random(3))
    uniq = spark.createDataFrame([(i, r[3], len(r[3])) for i, r in enumerate(rows)], "form_id long, form array<string>, len int")
    assert similarity._passes(uniq.agg(F.sum(2 * F.col("len") - 1)).first()[0], 4) > 2
    folder = shared.checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/tables-*"))
    assert {(x.i, x.j) for x in similarity.similar_pairs(similarity.forms(spark.createDataFrame(rows, ROWS))).collect()} == brute_pairs(rows)
    assert set(glob.glob(f"{folder}/tables-*")) == before


def test_no_task_gets_all_places_of_a_frequent_token(spark):
    """A token that all rows begin with, and many rows of nothing but frequent tokens."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    lists = [["the", "a"] + [r.choice(words) for _ in range(r.randint(2, 12))] for _ in range(3000)] + [["the"] * n for n in range(4, 40)]
    uniq = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lists)], "form_id long, form array<string>, len int")
    met = similarity._met(uniq, 0.3).groupBy("piece", "row", "col").agg(F.count(F.lit(1)).alias("n")).collect()
    pairs = sum(x.n for x in met)
    assert max(x.n for x in met) < 0.02 * max(pairs, 5000) and pairs < 3000 * 30  # of 4.6 million pairs


def test_joined_forms_group(spark):
    rows = spark.createDataFrame([(0, "a-00", "a", "one two".split(), []), (1, "a-01", "a", "three four".split(), ["a-00"]), (2, "b-00", "b", "one two three four".split(), []), (3, "c-00", "c", "quite other".split(), [])], "pos long, id string, session string, tokens array<string>, joins array<string>")
    assert {r.pos: r.group for r in similarity.group_labels(rows).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_folds(spark):
    rows = spark.createDataFrame([(i, i % 13, float(i % 5 + 1), "A") for i in range(60)], "pos long, group long, seconds double, grade string")
    out = similarity.balanced_folds(rows, 4).collect()
    assert len(out) == 60 and all(len({r.fold for r in out if r.group == g}) == 1 for g in range(13))
    loads = [sum(r.seconds for r in out if r.fold == k) for k in range(4)]
    biggest = max(sum(r.seconds for r in out if r.group == g) for g in range(13))
    assert max(loads) - min(loads) <= biggest
    report = similarity.fold_report(similarity.balanced_folds(rows.where("group < 2"), 4), 4).orderBy("fold").collect()
    assert [r.utterances > 0 for r in report] == [True, True, False, False]


def scored(spark):
    labels = spark.createDataFrame([(0, "a", "one two three", "g1", "A", "corrected"), (1, "b", "你好 吗", "g2", "A", "accepted"), (2, "c", "...", "g2", "A", "accepted")], "pos long, id string, text string, group string, grade string, status string")
    hyps = spark.createDataFrame([("x", "a", "one two"), ("x", "b", "你好吗"), ("x", "c", "."), ("y", "a", "one 2 three"), ("y", "b", "好吗")], "system string, id string, hyp string")
    return labels, hyps


def test_scores(spark):
    labels, hyps = scored(spark)
    with pytest.raises(ValueError, match="y lacks 1 of 3 .first: c."):
        scoring.require_complete(labels, hyps, ["x", "y"])
    common = scoring.complete(labels, hyps, ["x", "y"])
    cells = scoring.cells(common, hyps)
    rates = {(r.subset, r.system): (r.utterances, r.tokens, round(r.rate, 3), r.wrong) for r in scoring.subset_rates(cells).collect()}
    assert rates[("all", "x")] == (2, 6, 16.667, 1) and rates[("all", "y")] == (2, 6, 33.333, 2)
    assert rates[("corrected", "x")] == (1, 3, 33.333, 1) and rates[("latin", "y")] == (1, 3, 33.333, 1) and rates[("no latin", "x")] == (1, 3, 0.0, 0)
    d = {r.subset: round(r.difference, 3) for r in scoring.differences(scoring.subset_rates(cells), "x").collect()}
    assert d == {"all": 16.667, "corrected": 0.0, "latin": 0.0, "no latin": 33.333}
    assert [r.id for r in scoring.without_digits(labels, hyps).collect()] == ["b"]
    wrong = {r.id: [w.system for w in r.wrong] for r in scoring.wrong_cells(cells).collect()}
    assert wrong == {"a": ["x", "y"], "b": ["y"]}
    for exact in (False, True):
        b = scoring.bootstrap(cells, "x", rounds=200, exact=exact).first()
        assert b.low <= 16.667 <= b.high and b.low >= 0 and b.high <= 33.34


def test_exact_bootstrap_repeats_pythons_draws(spark):
    r = random.Random(4)
    rows = [(g, s, r.randint(0, 4), r.randint(1, 9)) for g in range(7) for s in ("x", "y")]
    tokens = {g: t for g, _, _, t in rows}
    cells = spark.createDataFrame([(g, s, e, tokens[g]) for g, s, e, _ in rows], "group int, system string, errors int, tokens int")
    rng, errors, diffs = random.Random(0), {(g, s): e for g, s, e, _ in rows}, []
    for _ in range(300):
        drawn = rng.choices(range(7), k=7)
        total = max(sum(tokens[g] for g in drawn), 1)
        diffs.append(100.0 * sum(errors[g, "y"] for g in drawn) / total - 100.0 * sum(errors[g, "x"] for g in drawn) / total)
    diffs.sort()
    got = scoring.bootstrap(cells, "x", rounds=300, exact=True).first()
    assert (got.low, got.high) == (diffs[7], diffs[291])


def test_a_label_without_an_utterance_is_refused(spark):
    labels = spark.createDataFrame([(i, f"u{i}", "t") for i in range(9)], "pos long, id string, text string")
    utterances = spark.createDataFrame([(f"u{i}", "accepted", "t") for i in range(12)], "id string, status string, text string")
    assert scoring.with_status(labels, utterances).columns == ["id", "pos", "text", "status"] and scoring.with_status(labels, utterances).count() == 9
    with pytest.raises(ValueError, match="u0, u2, u3$"):
        scoring.with_status(labels, utterances.where("id not in ('u0', 'u2', 'u3')"))
    with pytest.raises(ValueError, match="u0, u1, u2, u3, u4$"):
        scoring.with_status(labels, utterances.where("id = 'u11'"))


def many_groups(spark, n):
    """(subset, group, system, errors, tokens) of n groups, and of a third of them."""
    r = random.Random(9)
    rows = [(tag, g, s, r.randint(0, 5), r.randint(1, 30)) for g in range(n) for s in ("x", "y", "z") for tag in (("all", "third") if g % 3 == 0 else ("all",))]
    return spark.createDataFrame(rows, "subset string, group long, system string, errors int, tokens int").repartition(5)


def test_blocks_of_groups_give_the_same_intervals(spark, monkeypatch):
    """The two ways of drawing differ as two seeds do; neither depends on partitions, and all groups may be in one block."""
    tagged = many_groups(spark, 900)
    told = lambda rows: {(r.subset, r.system): (r.low, r.high) for r in rows.collect()}
    few = [told(resampling.intervals(tagged, "x", 2000, seed)) for seed in (0, 1)]
    monkeypatch.setattr(resampling, "FEW_GROUPS", 10)
    for block in (64, 1 << 16):
        monkeypatch.setattr(resampling, "BLOCK", block)
        many = told(resampling.intervals(tagged, "x", 2000, 0))
        assert many == told(resampling.intervals(tagged.repartition(2), "x", 2000, 0)) and many.keys() == few[0].keys()
        for k, (low, high) in many.items():
            width = few[0][k][1] - few[0][k][0]
            assert abs(low - few[0][k][0]) < 0.12 * width and abs(high - few[0][k][1]) < 0.12 * width
            assert abs(few[1][k][0] - few[0][k][0]) < 0.12 * width
    monkeypatch.setattr(resampling, "FEW_GROUPS", 700)  # 300 of "third" are few, 900 are not
    mixed = told(resampling.intervals(tagged, "x", 2000, 0))
    assert {k: v for k, v in mixed.items() if k[0] == "third"} == {k: v for k, v in few[0].items() if k[0] == "third"}
    with pytest.raises(ValueError, match="at most"):
        resampling.intervals(tagged, "x", 10, exact=True)


def test_draws_of_blocks_are_multinomial():
    n, size, rounds = 1000, 64, 4000
    counts = np.stack([resampling.falls(3, "all", n, rounds, b, size) for b in range(16)])
    assert (counts.sum(0) == n).all()
    for b in range(16):
        p = (min((b + 1) * size, n) - b * size) / n
        assert abs(counts[b].mean() - n * p) < 5 * (n * p * (1 - p) / rounds) ** 0.5
        assert abs(counts[b].var() / (n * p * (1 - p)) - 1) < 0.12
    assert (resampling.falls(3, "all", 5, 7, 0, 64) == 5).all()


def test_bootstrap_of_nothing(spark):
    none = many_groups(spark, 2).where("group > 5")
    assert resampling.intervals(none, "x").collect() == [] and scoring.bootstrap(none, "x").columns == ["system", "low", "high"]


def test_terms(spark):
    labels, hyps = scored(spark)
    terms = spark.createDataFrame([(0, "two"), (1, "好吗"), (2, "zz")], "pos long, term string")
    got = {r.term: (r.said, r.x, r.y) for r in scoring.term_hits(labels, hyps, terms, ["x", "y"]).collect()}
    assert got == {"two": (1, 1, 0), "好吗": (1, 1, 1), "zz": (0, 0, 0), None: (2, 2, 1)}


def test_sampling_does_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a, b = (sorted((r.k, r.split) for r in sampling.test_dev(rows.repartition(n), F.col("k"), test=30, dev=10).collect()) for n in (1, 8))
    assert a == b and len(a) == 40 and sum(s == "dev" for _, s in a) == 10
    got = sorted((r.k, r.pos) for r in sampling.dense(rows.where("k % 3 = 0").repartition(5), "k").collect())
    assert got == [(k, i) for i, k in enumerate(range(0, 500, 3))]
    assert sampling.corpus_names(["/x/a.parquet", "/y/a.parquet", "/y/b.parquet"]) == ["a", "y-a", "b"]
    with pytest.raises(ValueError, match="taken twice"):
        sampling.corpus_names(["/x/a.parquet", "/y/a.parquet", "/z/y/a.parquet"])


LABELS = "pos long, id string, session string, audio string, text string, seconds double, grade string, source string, joins array<string>, fold int"


def labels(spark):
    return spark.createDataFrame([
        (0, "a-00", "a", "a0", "It was late.", 1.0, "A", "agreed", [], 0), (1, "a-01", "a", "a1", "And dark", 2.0, "A", "reviewed", ["a-00"], 0), (2, "b-00", "b", "b0", "One.", 1.0, "A", "agreed", [], 1),
        (3, "b-01", "b", "b1", "Two.", 1.0, "A", "reviewed", ["b-00"], 1), (4, "c-01", "c", "c1", "Lost", 1.0, "A", "agreed", ["c-00"], 1), (5, "d-00", "d", "d0", "B row", 1.0, "B", "agreed", [], 0),
    ], LABELS)


def test_items(spark):
    got = {(r.split, tuple(r.ids)): (r.text, r.seconds, r.hard) for r in training.items(training.selected(labels(spark), "A", 0), 0).collect()}
    assert got == {("held", ("a-00",)): ("It was late.", 1.0, False), ("held", ("a-01",)): ("And dark", 2.0, True), ("train", ("b-00",)): ("One.", 1.0, False), ("train", ("b-01",)): ("Two.", 1.0, True), ("train", ("b-00", "b-01")): ("One two.", 2.0, False), ("train", ("c-01",)): ("Lost", 1.0, False)}
    assert training.items(labels(spark), -1).where("split = 'train'").count() == 8


def test_epoch(spark):
    train = spark.createDataFrame([(i, [f"u{i}"], [f"{i}.wav"], f"Text {i}.", 5.0, i % 4 == 0) for i in range(40)], "pos long, ids array<string>, audio array<string>, text string, seconds double, hard boolean")
    pool = spark.createDataFrame([(f"r{i}", "r.wav", "r", 1.0) for i in range(30)], "id string, audio string, text string, seconds double")
    a, b = (training.epoch(train.repartition(n), 1, 2, replay=pool, ratio=0.25).collect() for n in (1, 6))
    assert sorted(map(str, a)) == sorted(map(str, b))
    kinds = {k: sum(r.kind == k for r in a) for k in ("item", "repeat", "pair", "replay")}
    assert kinds["item"] == 40 and kinds["repeat"] == 20 and kinds["replay"] == round(0.25 * (60 + kinds["pair"]))
    assert all(len(set(r.ids)) == 2 for r in a if r.kind == "pair")
    assert sorted(map(str, a)) != sorted(map(str, training.epoch(train, 1, 3, replay=pool, ratio=0.25).collect()))


@pytest.mark.parametrize("shards", [1, 3])
def test_batches(spark, shards):
    r = random.Random(0)
    lengths = [r.randint(5, 300) for _ in range(200)] + [900]
    out = training.batches(spark.createDataFrame(list(enumerate(lengths)), "pos long, length long"), shards=shards).collect()
    assert sorted(r.pos for r in out) == list(range(201))
    by = {}
    for x in out:
        by.setdefault((x.shard, x.batch), []).append(x.length)
    assert all(len(b) <= 24 and (len(b) == 1 or max(b) * len(b) <= 480) for b in by.values())


@pytest.mark.parametrize(("n", "shards", "cells", "items"), [(10**6, 1, 480, 24), (5000, 3, 480, 24), (300, 1, 1, 1), (300, 1, 10**9, 7), (3, 1, 480, 24)])
def test_batches_equal_one_pass(spark, n, shards, cells, items):
    rows = spark.range(n).select(F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("length"))
    made = training.batches(rows, cells, items, shards=shards)
    got = made.withColumn("key", F.col("length") + training.uniform(0, F.col("pos"))).select("shard", "key", "pos", "length", "batch").toPandas().sort_values(["shard", "key", "pos"])
    now, want = None, []
    for s, length in zip(got["shard"], got["length"], strict=True):
        if s != now:
            now, number, held = s, 0, 0
        elif length * (held + 1) > cells or held >= items:
            number, held = number + 1, 0
        held += 1
        want.append(number)
    assert len(got) == n and got["batch"].tolist() == want


def test_batches_have_no_stage_of_one_task(spark):
    plan = training.batches(spark.range(1000).select(F.col("id").alias("pos"), F.col("id").alias("length")))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and training.batches(spark.range(0).select(F.col("id").alias("pos"), F.col("id").alias("length"))).collect() == []


def test_rich_targets_do_not_depend_on_batches(spark):
    class Wobble:
        """Scores that would betray what is beyond an item's length."""

        def scores(self, cells, lengths):
            inside = np.arange(cells.shape[1])[None, :, None] < lengths[:, None, None]
            return np.where(inside, np.sin(cells * 7), np.nan)

    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=(int(n), 5)).round(1).tolist()) for i, n in enumerate(r.integers(0, 40, 300))]
    padded = frontend.padded_batches(spark.createDataFrame(rows, "pos long, frames array<array<float>>"))
    got = {x.pos: (x.rich, x.labels) for x in passes.frame_labels(padded, Wobble).collect()}
    want = {}
    for i, frames in rows:
        if frames:
            path = np.sin(np.array(frames, np.float32) * 7).argmax(-1).tolist()
            rest = path[4:]
            want[i] = (path[:4], [v for k, v in enumerate(rest) if v != 0 and (k == 0 or v != rest[k - 1])])
    assert got == want


def test_training_plan(spark):
    train = spark.range(400).select(F.col("id").alias("pos"), F.array(F.col("id").cast("string")).alias("ids"), F.array(F.lit("a")).alias("audio"), F.col("id").cast("string").alias("text"), ((F.col("id") * 7) % 90 / 10.0).alias("seconds"), (F.col("id") % 10 == 0).alias("hard"))
    pool = spark.range(50).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.lit("r.wav").alias("audio"), F.lit("r").alias("text"), F.lit(3.0).alias("seconds"))
    plan = passes.training_plan(train, 2, replay=pool, ratio=0.1).collect()
    frames = lambda x: int(x.seconds * 1000 / 60)
    for e in (1, 2):
        mine = [x for x in plan if x.epoch == e]
        steps = sorted({x.step for x in mine})
        assert steps == list(range(len(steps)))
        whole = training.epoch(train, 0, e, replay=pool, ratio=0.1)
        assert sorted((x.kind, x.ids) for x in mine) == sorted((x.kind, x.ids) for x in whole.collect() if frames(x) > 0)
        sizes = []
        for step in steps:
            batch = [x for x in mine if x.step == step]
            longest = max(map(frames, batch))
            assert len(batch) <= 24 and (len(batch) == 1 or longest * len(batch) <= 480)
            p = (e - 1 + step / len(steps)) / 2
            factor = max(p / 0.1, 0.01) if p < 0.1 else 0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * (p - 0.1) / 0.9))
            assert all(abs(x.factor - factor) < 1e-12 for x in batch)
            sizes.append(longest)
        assert sizes != sorted(sizes)  # batches are shuffled


def test_evaluations_merge_late_transcripts(spark):
    r = random.Random(8)
    cell = lambda o: (r.randint(0, 3), r.choice(["dev", "test"]), r.choice("xy"), f"u{r.randint(0, 30)}", o, r.randint(0, 4), r.randint(0, 9))
    schema = "pass int, manifest string, system string, id string, ord int, errors int, tokens int"
    parts = [[cell(o) for _ in range(120)] for o in range(4)]
    parts = [list({x[:4]: x for x in p}.values()) for p in parts]
    made = [spark.createDataFrame(p, schema) for p in parts]
    sums, known = passes.evaluation_sums(passes.latest(made[0])), made[0]
    for late in made[1:]:
        sums, known = passes.merged_sums(sums, known, late), known.unionByName(late)
    want = {}
    for p in parts:
        want |= {x[:4]: x[5:] for x in p}
    told = {}
    for (n, m, s, _), (e, t) in want.items():
        held = told.setdefault((n, m, s), [0, 0, 0, 0])
        for k, v in enumerate((1, t, e, int(e > 0))):
            held[k] += v
    assert {(x["pass"], x.manifest, x.system): [x.utterances, x.tokens, x.errors, x.wrong] for x in sums.collect()} == told
    rates = {}
    for x in passes.running(sums).orderBy("pass").collect():
        mine = rates.setdefault((x.manifest, x.system), [])
        mine.append(100 * x.errors / max(x.tokens, 1))
        assert abs(x.rate - mine[-1]) < 1e-9 and abs(x.mean_rate - sum(mine) / len(mine)) < 1e-9 and x.best == (mine[-1] <= min(mine))
    losses = spark.createDataFrame([(1, 0, 4.0), (1, 1, 2.0), (2, 0, 1.0), (2, 1, None)], "pass int, batch int, loss double")
    assert [tuple(x) for x in passes.loss_means(losses).orderBy("pass").collect()] == [(1, 3.0, 2, 3.0), (2, 1.0, 1, 7 / 3)]


class EchoTrainer:
    """Writes down what it was given, and says texts back with a word missing in some."""

    def __init__(self, fail=()):
        self.fail, self.done = set(fail), []

    def _note(self, step, fold):
        if (step, fold) in self.fail:
            raise RuntimeError("killed")
        self.done.append((step, fold))

    def train(self, labels, fold, folder):
        self._note("train", fold)
        assert labels.where(F.col("fold") == fold).isEmpty()
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "fold"), "w") as f:
            f.write(str(fold))

    def export(self, folder, out):
        fold = int(open(os.path.join(folder, "fold")).read())
        self._note("export", fold)
        os.makedirs(out, exist_ok=True)
        with open(os.path.join(out, "fold"), "w") as f:
            f.write(str(fold))

    def transcribe(self, rows, folder):
        fold = int(open(os.path.join(folder, "fold")).read())
        self._note("transcribe", fold)
        return rows.select("id", F.regexp_replace("text", f"w{fold} ", "").alias("hyp"))


def test_fold_runs(spark, tmp_path):
    rows = [(i, f"u{i}", f"w0 w1 w2 end{i % 3}", i % 4, "A", "corrected" if i % 2 else "accepted") for i in range(40)]
    labels = spark.createDataFrame(rows, "pos long, id string, text string, fold int, grade string, status string")
    stock = labels.select("id", F.lit("w0 w1").alias("hyp"))
    told = lambda df: sorted(map(tuple, df.collect()))
    whole = runs.cross_validated(spark, labels, EchoTrainer(), str(tmp_path / "whole"), range(4))
    unbroken = told(runs.fold_score(spark, labels, stock, whole, 4))
    killed = EchoTrainer([("export", 2)])
    with pytest.raises(RuntimeError, match="killed"):
        runs.cross_validated(spark, labels, killed, str(tmp_path / "b"), range(4), 3600)
    state = {(r.fold, r.step): r.state for r in runs.FoldRuns(str(tmp_path / "b"), range(4)).table(spark).collect()}
    assert state[1, "transcribe"] == runs.DONE and state[2, "train"] == runs.DONE and state[2, "export"] == runs.CLAIMED and state[2, "transcribe"] == runs.WAITING and state[3, "train"] == runs.READY
    other = EchoTrainer()
    half = runs.cross_validated(spark, labels, other, str(tmp_path / "b"), range(4), 3600)  # the dead run's claim still holds
    assert other.done == [(s, 3) for s in runs.STEPS] and not half.complete()
    with pytest.raises(ValueError, match="not all folds"):
        runs.fold_score(spark, labels, stock, half, 4)
    os.utime(str(tmp_path / "b" / "fold2" / "export.claim"), (0, 0))
    last = EchoTrainer()
    resumed = runs.cross_validated(spark, labels, last, str(tmp_path / "b"), range(4), 3600)
    assert last.done == [("export", 2), ("transcribe", 2)]
    assert told(runs.fold_score(spark, labels, stock, resumed, 4)) == unbroken
    some = runs.FoldRuns(str(tmp_path / "b"), [1, 2])
    common = runs.fold_score(spark, labels, stock, some, 4).where("subset = 'all'").collect()
    assert {r.utterances for r in common} == {20} and len(common) == 2
    with pytest.raises(ValueError, match="incomplete"):
        runs.fold_score(spark, labels, stock.where("id <> 'u3'"), resumed, 4)


def test_a_step_has_one_owner(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    every = [runs.FoldRuns(str(tmp_path), range(3), stale) for stale in [3600.0] * 12]
    done = []
    with ThreadPoolExecutor(12) as pool:
        list(pool.map(lambda r: [r.run(lambda *a: done.append(a[:2])) for _ in range(4)], every))
    assert sorted(done) == sorted((k, s) for k in range(3) for s in runs.STEPS) and every[0].complete()
    old = [runs.FoldRuns(str(tmp_path / "x"), [0], 10.0) for _ in range(12)]
    assert old[0].claim(0, "train")
    os.utime(str(tmp_path / "x" / "fold0" / "train.claim"), (0, 0))
    with ThreadPoolExecutor(12) as pool:
        assert sum(pool.map(lambda r: r.claim(0, "train"), old)) == 1


def test_weights(spark):
    base = spark.createDataFrame([("w", True, [1.0, 2.0]), ("n", False, [5.0]), ("only", True, [1.0])], "name string, is_float boolean, values array<double>")
    tuned = spark.createDataFrame([("w", [3.0, 2.0]), ("n", [9.0]), ("new", [0.0])], "name string, values array<double>")
    assert {r.name: r["values"] for r in training.mixed(base, tuned, 0.5).collect()} == {"w": [2.0, 2.0], "n": [5.0], "only": [1.0]}
    assert training.foreign_weights(base, tuned) == ["new"]
    every = ["encoder.encoders0.0.w", *[f"encoder.encoders.{i}.w" for i in range(49)], *[f"encoder.tp_encoders.{i}.w" for i in range(20)]]
    always = ["ctc.w", "encoder.tp_norm.w"]
    names = spark.createDataFrame([(x,) for x in [*every, *always, "encoder.after_norm.w", "embed.w"]], "name string")
    for n in (0, 2, 20, 21, 69, 70):
        wanted = every[len(every) - n :] + always + (["encoder.after_norm.w"] if n > 20 else [])
        assert sorted(r.name for r in training.top_blocks(names, n).collect()) == sorted(wanted)


def test_agreement(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "q")], "id int, hyp string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "q")], "id int, hyp string")
    r = scoring.identical(a, b, ["id"]).first()
    assert (r.same, r.total) == (2, 4)
    assert score_tokens is not None
