import random

import pytest
from pyspark.sql import functions as F

from speechmill.functions import distance as ds
from speechmill.functions import signal, text as tx
from speechmill.operators.longform import distance


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(("raw", "shown"), [
    ("  hello there  ", "hello there"), ("   ", ""), ("你 好", "你好"), ("你好 , 世界", "你好，世界"), ("one  two", "one two"), ("a, b", "a, b"), ("好:ok", "好：ok"), ("真的?!", "真的？!"), ("去 New York 吧", "去New York吧"), ("ok 你", "ok你"), (None, None),
])
def test_app_normalize(spark, raw, shown):
    assert column(spark, [raw], tx.app_normalize) == [shown]


def test_score_tokens(spark):
    assert column(spark, ["Wi-Fi 很好, don't", "<b>Bold</b>１é2", "", None], tx.score_tokens) == [["wi", "fi", "很", "好", "don't"], ["bold", "2"], [], None]
    assert column(spark, ["後來 a"], tx.score_tokens) == [["后", "来", "a"]]
    assert column(spark, ["後來"], lambda c: tx.score_tokens(c, script=False)) == [["後", "來"]]


def test_small_functions(spark):
    assert column(spark, ["A\u3000b\tC "], tx.squash) == ["abc"]
    assert column(spark, ["你好。 ", "ok...", "a,b"], tx.strip_trailing) == ["你好", "ok", "a,b"]
    assert column(spark, ["s-01", "s-123", "s", "a-b"], tx.id_number) == [1, 123, None, None]
    assert column(spark, ["３", "3", "x", "②"], tx.has_digit) == [True, True, False, False]


@pytest.mark.parametrize(("parts", "continued", "whole"), [
    (["我们走。", "好"], True, "我们走好"), (["I went home.", "And slept"], True, "I went home and slept"), (["I went home.", "I slept"], True, "I went home I slept"), (["go home.", "NASA is"], True, "go home NASA is"),
    (["One.", "Two."], False, "One. Two."), (["你好。", "再见。"], False, "你好。再见。"), (["ok?", "好"], False, "ok?好"), (["a "], True, "a "), (["我 ", "x", "y"], True, "我x y"),
])
def test_join_texts(spark, parts, continued, whole):
    assert column(spark, [parts], lambda c: tx.join_texts(c, continued), "array<string>") == [whole]


def test_corpus_columns(spark):
    rows = spark.createDataFrame([("", "t", None, "TEST_NET_Y1_-Kk_S0_S00012", "p_1_2"), ("a", None, "7", "x", None), (None, None, None, "", "s_9"), (None, "", None, None, "plain")], "answer string, text string, client_id string, sid string, ID string")
    got = rows.select(tx.corpus_text(rows.columns), tx.speaker(rows.columns)).collect()
    assert [tuple(r) for r in got] == [("t", "TEST_NET_Y1_-Kk_S0"), ("a", "7"), (None, "s"), (None, None)]


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_distance(spark):
    r = random.Random(3)
    pairs = [([r.choice("ab c é 你 xyz q".split()) for _ in range(r.randint(0, 12))], [r.choice("ab c é 你 xyz q".split()) for _ in range(r.randint(0, 12))]) for _ in range(80)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [x[0] for x in rows.orderBy("i").select(ds.token_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [brute(a, b) for a, b in pairs] == [distance(a, b) for a, b in pairs]
    coded = ds.intern_tokens(rows.select("i", F.col("a").alias("t")), "i", "t").orderBy("i").collect()
    assert [len(x.coded) for x in coded] == [len(a) for a, _ in pairs]


def test_ctc(spark):
    assert column(spark, [[0, 3, 3, 0, 3, 5, 5, 0], [], [1, 1]], signal.greedy_ctc, "array<int>") == [[3, 3, 5], [], [1]]
    out = column(spark, [[9, 8, 7, 6, 0, 4, 4]], signal.rich_and_text, "array<int>")[0]
    assert (out.rich, out.text) == ([9, 8, 7, 6], [4])


def test_arrays(spark):
    frames = [[float(t)] for t in range(20)]
    stacked = column(spark, [frames, frames[:6]], signal.lfr_stack, "array<array<double>>")
    assert [f[0] for f in stacked[0]] == [0.0, 6.0, 12.0] and len(stacked[0][0]) == 7 and stacked[1] is None
    assert column(spark, [[0.5, -1.0, 0.0]], lambda c: signal.gain_clip(c, 20), "array<double>") == [[1.0, -1.0, 0.0]]
    assert column(spark, [[0.5, -0.25], [0.0]], lambda c: signal.peak_normalize(c, 0.1), "array<double>") == [[0.1, -0.05], [0.0]]
    assert column(spark, [[0.5, -0.5, 0.0]], signal.step_from_zero, "array<double>") == [[0.5 + 1 / 32768, -0.5 - 1 / 32768, 0.0]]
    factors = [r[0] for r in spark.range(101).select(signal.lr_schedule(F.col("id") / 100.0)).collect()]
    assert factors[0] == 0.01 and abs(max(factors) - 1) < 1e-9 and abs(factors[-1] - 0.1) < 1e-9
    assert all(a >= b for a, b in zip(factors[10:], factors[11:]))
    assert column(spark, [[1, 0, 2]], lambda c: tx.decode_pieces(c, F.array(F.lit("▁b"), F.lit("▁a"), F.lit("c"))), "array<int>") == ["a bc"]
