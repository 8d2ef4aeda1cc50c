"""Every query of the engine against its DuckDB SQL, on the smallest tables."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill.functions.text import score_tokens
from speechmill.operators import sessions
from speechmill.plans import adapters
from speechmill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def told(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(mine.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted(tuple(told(r[c]) for c in order) for r in mine.collect())
    b = sorted(tuple(told(r[cols.index(c)]) for c in order) for r in rel.fetchall())
    assert a == b


def test_queries_without_an_oracle_are_known():
    assert set(QUERIES) - set(ORACLES) == {"error_rate_documents", "utterance_groups", "wave_features"}


def test_utterance_groups_against_all_pairs(spark):
    """Every utterance of the smallest tables with every other, by the textbook's recurrence over tokens."""
    from test_operators import brute_distance

    rows = sessions.chains(adapters.utterances(spark, SF)).select("pos", "id", "session", "joins", score_tokens(F.col("text")).alias("tokens")).orderBy("pos").collect()
    by = {r.id: r.tokens for r in rows}
    root = {r.pos: r.pos for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    said, first = {}, {}
    for r in rows:
        for f in {tuple(r.tokens), tuple(w for j in r.joins for w in by[j]) + tuple(r.tokens)} - {()}:
            said.setdefault(f, []).append(r.pos)
        first.setdefault(r.session, r.pos)
    links = [(p, first[r.session]) for r in rows for p in [r.pos]] + [(p, v[0]) for v in said.values() for p in v]
    every = sorted(said, key=len)
    for i, a in enumerate(every):
        bag = collections.Counter(a)
        for b in every[:i]:  # shorter
            if len(b) >= 0.7 * len(a) and sum((bag & collections.Counter(b)).values()) >= 0.7 * len(a) and brute_distance(a, b) <= 0.3 * len(a):
                links.append((said[a][0], said[b][0]))
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.pos: r.group for r in QUERIES["utterance_groups"](spark, SF).collect()} == {r.pos: find(r.pos) for r in rows}


def test_wave_features_against_a_direct_transform(spark):
    """Each file's samples by a windowed sinc sum, each frame's power by the sum over its samples."""
    rows = {r.vec_id: r for r in QUERIES["wave_features"](spark, SF).collect()}
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert rows.keys() == vectors.keys()
    k = np.arange(-20, 21)  # ten lobes at half the new rate
    kernel = np.sinc(k / 2) * np.kaiser(41, 5.0)
    kernel *= 2 / kernel.sum()
    hz = np.arange(257) * 16000 / 512
    mel = lambda f: 1127.0 * np.log(1 + f / 700.0)
    edges = np.linspace(mel(20.0), mel(8000.0), 82)
    weights = np.array([[max(0.0, min((mel(f) - a) / (m - a), (b - mel(f)) / (b - m))) for f in hz] for a, m, b in zip(edges, edges[1:], edges[2:], strict=False)])
    dft = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(400)) / 512)
    for i in sorted(vectors)[:6]:
        said = np.tile(np.clip(np.rint(vectors[i] * 32768), -32768, 32767) / 32768, 60)
        long = np.zeros(2 * len(said) + 40)
        long[20 : 20 + 2 * len(said) : 2] = said
        x = np.array([np.dot(long[j : j + 41], kernel[::-1]) for j in range(2 * len(said))]) * 32768
        frames = []
        for a in range(0, len(x) - 399, 160):
            f = x[a : a + 400] - x[a : a + 400].mean()
            f = f - 0.97 * np.r_[f[0], f[:-1]]
            frames.append(np.log(np.maximum(weights @ np.abs(dft @ (f * np.hamming(400))) ** 2, np.finfo(np.float32).eps)))
        frames = np.array(frames)
        r = rows[i]
        assert (r.frames, r.seconds) == (len(frames), 0.48)
        j = np.arange(1, 561)
        total = sum(((frames[t : t + 7].ravel() + j / 560) * (j / 1120)).sum() for t in range(0, 6 * r.stacked, 6))
        assert r.stacked == (len(frames) - 7) // 6 + 1 and abs(total - r.total) < 1e-4 * abs(total) + 1


def test_epoch_batches(spark):
    rows = QUERIES["epoch_batches"](spark, SF).orderBy("epoch").collect()
    n = adapters.labels(spark, SF).agg(F.count_if(F.floor(F.col("seconds") * 1000 / 60) > 0) + 2 * F.count_if((F.col("source") == "reviewed") & (F.floor(F.col("seconds") * 1000 / 60) > 0))).first()[0]
    assert [r.epoch for r in rows] == [1, 2, 3] and all(r["items"] == n and r.steps == r["last"] + 1 for r in rows)
    assert len({r.seconds for r in rows}) == 1 and rows[0].least == 0.01 and rows[0].most > rows[1].most > rows[2].most >= rows[2].least >= 0.1


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["subset", "system", "utterances", "tokens", "rate", "wrong"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
