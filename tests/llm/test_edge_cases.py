"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechmill.llm import bpe, exact_dedup, jaccard, packing, pii, pitman_yor, quality, secrets, suffix_dedup, token_counts

WORDS = "the cat of a house and the dog in some town went to see what that was for it is on with by".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 97) for i in range(30000))
ROWS = [(1, None), (2, ""), (3, "  \n\t "), (None, "a text without an id"), (5, LONG), (6, "x"), (7, "tied text here"), (8, "tied text here"), (9, "same row"), (9, "same row"), (10, "é漢字🙂 \x00 end"), (None, None)]

OPS = {
    "op1": lambda d: suffix_dedup.suffix_dedup(d),
    "op2": lambda d: quality.quality(d),
    "op3": lambda d: pii.pii(d, sample=100, epochs=1),
    "op4": lambda d: packing.pack(d, P.path("byte_bpe_50k.json")),
    "op5": lambda d: exact_dedup.exact_dedup(d),
    "op6": lambda d: bpe.bpe_round_trip(d, P.path("word_bpe_49k.json")),
    "op6_ids": lambda d: bpe.bpe_encode(d, P.path("word_bpe_49k.json")),
    "op7": lambda d: secrets.secrets(d, sample=100, epochs=1),
    "op8": lambda d: token_counts.token_counts(d, P.path("byte_bpe_50k.json")),
    "op9": lambda d: pitman_yor.lm_scores(d),
    "op10": lambda d: jaccard.jaccard_components(d),
}
NAMES = ["row", "key", "name", "part", "p", "words", "lines", "kept", "entity", "place", "_place", "block"]


@pytest.mark.parametrize("op", OPS)
def test_rows_stay_one_to_one(docs, op):
    d = docs(ROWS)
    for n in NAMES:
        d = d.withColumn(n, F.lit("other"))
    out = OPS[op](d).select("doc_id").collect()
    ids = sorted((r[0] is None, r[0] or 0) for r in out)
    wanted = sorted((i is None, i or 0) for i, _ in ROWS)
    assert (sorted(set(ids)) == sorted(set(wanted))) if op == "op4" else (ids == wanted)


@pytest.mark.parametrize("op", OPS)
def test_empty_table(docs, op):
    assert OPS[op](docs([(1, "a")]).where("doc_id < 0")).collect() == []


def test_only_nulls(docs):
    for op in OPS.values():
        assert {r[0] for r in op(docs([(None, None), (None, None)])).select("doc_id").collect()} == {None}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    d = docs(ROWS)
    for n in ["row", "place", "_place", "key", "_id", "component_id", "entity", "id", "kept", "words", "lines"]:
        d = d.withColumn(n, F.lit(n))
    out = stage(spark, d, "")
    if stage is not corpus_pipeline.sequences:
        assert out.columns == d.columns and all(r._place == "_place" and r.place == "place" and r.row == "row" for r in out.collect())
        kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        every = sorted((i is None, i or 0) for i, _ in ROWS)
        assert all(kept.count(x) <= every.count(x) for x in kept)
        if stage is corpus_pipeline.quality_rules:
            assert (True, 0) not in kept and (False, 1) not in kept and (False, 2) not in kept  # too few words
        elif stage is corpus_pipeline.exact_copies:
            assert kept.count((False, 9)) == 1 and (False, 8) not in kept and (False, 3) in kept and (False, 5) in kept
        elif stage is corpus_pipeline.near_copies:
            assert kept.count((False, 9)) == 1 and (False, 8) not in kept and {(False, 1), (False, 2), (False, 3), (False, 5)} <= set(kept)
        else:
            assert kept == every
    else:
        by: dict = {}
        for p in out.collect():
            by.setdefault(p.doc_id, []).append(p.length)
        assert set(by) == {i for i, _ in ROWS} and by[1] == by[2] == [1]  # the end id alone
    assert stage(spark, docs([(1, "a")]).where("doc_id < 0"), "").count() == 0


def test_repeated_rows_and_ties(spark, docs):
    out = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(ROWS)).collect()}
    assert {(7, 7, 2), (8, 7, 2), (9, 9, 2), (1, 1, 4), (2, 3, 4)} - {(1, 1, 4), (2, 3, 4)} <= out
    assert {k for i, k, _ in out if i in (1, 2, 3)} == {3}  # white space alone: the longest original stays
    kept = exact_dedup.deduplicated(docs(ROWS)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (7, 8, 9)) == [7, 9]
    near = jaccard.representatives(docs(ROWS)).collect()
    assert sorted(r.doc_id for r in near if r.doc_id in (7, 8, 9)) == [7, 9]
    assert sum(r.text is None or not r.text.strip() for r in near) == 4  # no shingles: linked with nothing
