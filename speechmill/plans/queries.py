"""The engine's own queries: every operator over the test tables, read through the adapters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.functions import signal, text as tx
from speechmill.functions.portable import draw
from speechmill.operators import consensus, frontend, passes, phrases, sampling, scoring, sessions, similarity, training
from speechmill.plans import adapters as ad
from speechmill.sources import audio, files, zipped
from speechmill.sources.shared import checkpoint_dir

FIRST = "small"
ROUND = 6


def _r(c) -> F.Column:
    return F.round(c, ROUND)


def _scored(spark: SparkSession, d: str, grades: str = "A") -> tuple[DataFrame, DataFrame]:
    rows = ad.utterances(spark, d)
    hyps = ad.hypotheses(rows)
    return scoring.complete(rows.where(F.instr(F.lit(grades), F.col("grade")) > 0), hyps, list(ad.SYSTEMS)), hyps


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cells(*_scored(spark, d))


# text

def score_tokens_profile(spark: SparkSession, d: str) -> DataFrame:
    tokens = ad.table(spark, d, "documents").select("lang", tx.score_tokens(F.col("text")).alias("t"))
    return tokens.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("t")).cast("bigint").alias("tokens"), F.sum(F.size(F.array_distinct("t"))).cast("bigint").alias("kinds"), F.max(F.size("t")).cast("bigint").alias("longest"))


def squashed_lengths(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "documents").select("doc_id", F.length(tx.squash(F.col("text"))).cast("bigint").alias("n"), F.md5(tx.squash(F.col("text"))).alias("digest"))


def markup_strip(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "pages").select("page_id", F.size(tx.score_tokens(F.col("html"))).cast("bigint").alias("tokens"), F.md5(F.array_join(tx.score_tokens(F.col("html")), " ")).alias("digest"))


CASES = ("你 好 , 世界", " 我们 去 Wi-Fi 吧 ", "真的?!", "hello  world", "価格: 5", "a  你", "好,很 好;ok")


def cjk_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(len(CASES)).select("id", F.get(F.array(*map(F.lit, CASES)), F.col("id").cast("int")).alias("raw"))
    return rows.select("id", tx.app_normalize(F.col("raw")).alias("shown"))


def text_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("answer"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("transcription"), F.col("text").alias("sentence"))
    return rows.select("doc_id", F.md5(tx.corpus_text(rows.columns)).alias("digest"))


def speaker_key(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.col("page_id")).alias("client_id"), F.when(F.col("page_id") % 2 == 0, F.concat(F.col("url"), F.lit("_S"), F.col("page_id"), F.lit("_S1"))).alias("sid"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("k"), F.col("page_id"), F.lit("_7_8"))).otherwise("plain").alias("ID"))
    return rows.select("page_id", tx.speaker(rows.columns).alias("speaker"))


def joined_turns(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations as one transcript, sentences told apart."""
    rows = ad.utterances(spark, d).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]).alias("parts"))
    return rows.select("session", F.size("parts").cast("bigint").alias("parts"), F.md5(tx.join_texts(F.col("parts"), False)).alias("separate"), F.md5(tx.join_texts(F.col("parts"), True)).alias("continued"))


def normalized_documents(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "documents").select("doc_id", F.md5(tx.app_normalize(F.concat(F.lit("  "), F.col("text"), F.lit(" \n")))).alias("digest"))


def phrase_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which the first word, two and three words of every benchmark text are put in brackets, the longest where several fit."""
    first = F.split("text", " ")
    heads = ad.table(spark, d, "benchmark").select(F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.array_join(F.slice(first, F.lit(1), k), " "))).alias("phrase"))
    table = heads.select("phrase", F.concat(F.lit("["), "phrase", F.lit("]")).alias("replacement"))
    done = phrases.converted(ad.table(spark, d, "documents").select("doc_id", "text"), table)
    return done.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


# scoring

def script_rates(spark: SparkSession, d: str) -> DataFrame:
    """Labels in traditional characters, transcripts in simplified ones: only the words that differ count."""
    rows = ad.utterances(spark, d)
    hyps = ad.hypotheses(rows, lossy=False).withColumn("hyp", F.regexp_replace("hyp", "th", "台湾说话"))
    c = scoring.cells(rows.withColumn("text", F.regexp_replace("text", "th", "臺灣說話")), hyps)
    return c.groupBy("system").agg(F.sum("tokens").alias("tokens"), F.sum("errors").cast("bigint").alias("errors"))


def subset_intervals(spark: SparkSession, d: str) -> DataFrame:
    return scoring.subset_intervals(_cells(spark, d), FIRST).select("subset", "system", _r("low").alias("low"), _r("high").alias("high"))


def error_rate_by_subset(spark: SparkSession, d: str) -> DataFrame:
    r = scoring.subset_rates(_cells(spark, d))
    return r.select("subset", "system", F.col("utterances").cast("bigint").alias("utterances"), F.col("tokens").cast("bigint").alias("tokens"), _r("rate").alias("rate"), F.col("wrong").cast("bigint").alias("wrong"))


def error_rate_diff(spark: SparkSession, d: str) -> DataFrame:
    return scoring.differences(scoring.subset_rates(_cells(spark, d)), FIRST).select("subset", "system", _r("difference").alias("difference"))


def error_rate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rates over whole documents; a document is a long utterance of its source."""
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.col("text"), "source")
    hyps = docs.select(F.lit("large").alias("system"), "id", ad.corrupted("large").alias("hyp"))
    from speechmill.operators.longform import token_distances

    pairs = docs.join(hyps, "id").select("id", "source", tx.score_tokens(F.col("text")).alias("ref"), tx.score_tokens(F.col("hyp")).alias("hyp"))
    counted = token_distances(pairs, "ref", "hyp")
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("errors").cast("bigint").alias("errors"), _r(scoring.rate(F.col("errors"), F.col("tokens"))).alias("rate"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bootstrap(_cells(spark, d), FIRST).select("system", _r("low").alias("low"), _r("high").alias("high"))


def wrong_utterances(spark: SparkSession, d: str) -> DataFrame:
    w = scoring.wrong_cells(_cells(spark, d))
    return w.select("id", "grade", "text", F.array_join(F.transform("wrong", lambda x: F.concat_ws(": ", x["system"], x["hyp"])), " | ").alias("wrong"))


def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d)
    return scoring.missing(rows, ad.hypotheses(rows), list(ad.SYSTEMS)).select("system", F.col("missing").cast("bigint").alias("missing"), F.col("total").cast("bigint").alias("total"), "example")


def common_only(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d)
    return scoring.complete(rows, ad.hypotheses(rows), list(ad.SYSTEMS)).groupBy("grade").agg(F.count(F.lit(1)).alias("utterances"), F.sum("seconds").alias("seconds"))


def no_digits_rate(spark: SparkSession, d: str) -> DataFrame:
    rows, hyps = _scored(spark, d)
    c = scoring.cells(scoring.without_digits(rows, hyps), hyps)
    r = scoring.subset_rates(c, with_status=False)
    return r.select("subset", "system", F.col("utterances").cast("bigint").alias("utterances"), F.col("tokens").cast("bigint").alias("tokens"), _r("rate").alias("rate"))


def term_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d)
    terms = spark.range(len(ad.TERMS)).select(F.col("id").alias("pos"), tx.squash(F.get(F.array(*map(F.lit, ad.TERMS)), F.col("id").cast("int"))).alias("term"))
    return scoring.term_hits(rows, ad.hypotheses(rows), terms, list(ad.SYSTEMS)).select("pos", "term", *[F.col(c).cast("bigint").alias(c) for c in ("said", *ad.SYSTEMS)])


def merged_systems(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d)
    first = ad.hypotheses(rows).withColumn("ord", F.lit(0))
    later = rows.where(F.col("continues")).select(F.lit("large").alias("system"), "id", F.lower("text").alias("hyp"), F.lit(1).alias("ord"))
    return scoring.merged_systems(first.unionByName(later)).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("hyp")).cast("bigint").alias("chars"), F.max("hyp").alias("last"))


def agreement_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d).where(~F.col("continues"))
    heard = rows.select("id", F.concat(F.col("text"), F.lit(" ,。")).alias("phone"), ad.corrupted("large").alias("hyp"))
    return scoring.agreement(heard)


def export_identity(spark: SparkSession, d: str) -> DataFrame:
    hyps = ad.hypotheses(ad.utterances(spark, d))
    return scoring.identical(hyps.where("system = 'small'"), hyps.where("system = 'other'"), ["id"])


# sessions and labels

def session_status(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_states(ad.log(spark, d)).select("session", "status", "dictated", "field")


def session_positions(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = sessions.utterances(ad.log(spark, d))
    return kept.select("id", "session", F.col("index").cast("bigint").alias("index"), F.col("of").cast("bigint").alias("of"), "phone", "refined", "status", "dictated", "field")


def status_counts_minutes(spark: SparkSession, d: str) -> DataFrame:
    log = ad.log(spark, d)
    files = log.where("seconds >= 1").select("audio").distinct()
    kept, dropped = sessions.utterances(log.withColumn("audio", F.when(F.col("seq") % 7 == 0, F.lit("gone")).otherwise(F.col("audio"))), files)
    return sessions.status_counts(kept, dropped).select("status", F.col("utterances").cast("bigint").alias("utterances"), _r("minutes").alias("minutes"))


def continuation_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.chains(ad.utterances(spark, d).where("grade = 'A'"))
    return rows.select("id", F.array_join("joins", ",").alias("joins"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.evidence(spark, d).drop("text")
    texts = ad.evidence(spark, d).select("id", "text")
    hyps = consensus.hypothesis_lists(ad.hypotheses(rows.join(texts, "id"), lossy=False))
    joined = rows.drop("grade").join(hyps, "id")
    return consensus.graded(joined, ad.reviewed(texts))


def consensus_grade(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("id", "outcome", "source", "text")


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return consensus.outcome_counts(_judged(spark, d))


def review_report(spark: SparkSession, d: str) -> DataFrame:
    return consensus.review_blocks(_judged(spark, d)).select("pos", F.md5("block").alias("digest"), F.length("block").cast("bigint").alias("n"))


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.variants(spark, d).withColumn("form", tx.score_tokens(F.col("text")))
    return similarity.similar_pairs(rows)


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.variants(spark, d).withColumn("tokens", tx.score_tokens(F.col("text")))
    return similarity.group_labels(rows).select("pos", "group")


def utterance_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of all utterances, by session or by what was said, alone or with the parts that it carries on."""
    rows = sessions.chains(ad.utterances(spark, d)).withColumn("tokens", tx.score_tokens(F.col("text")))
    return similarity.group_labels(rows.select("pos", "id", "session", "joins", "tokens")).select("pos", "group")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return similarity.balanced_folds(ad.utterances(spark, d), 5)


def balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).groupBy("group", "fold").agg(F.count(F.lit(1)).alias("utterances")).withColumn("fold", F.col("fold").cast("bigint"))


def fold_report(spark: SparkSession, d: str) -> DataFrame:
    r = similarity.fold_report(_folded(spark, d), 5)
    return r.select(F.col("fold").cast("bigint").alias("fold"), "utterances", _r("minutes").alias("minutes"), "verified")


def leak_check(spark: SparkSession, d: str) -> DataFrame:
    leaks = _folded(spark, d).groupBy("group").agg(F.count_distinct("fold").alias("n")).where("n > 1")
    return leaks.agg(F.count(F.lit(1)).alias("leaks"))


# sampling and training

def test_dev_split(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "documents").select("doc_id", "lang")
    return sampling.test_dev(rows, F.col("doc_id")).select("doc_id", "split", F.col("rank").cast("bigint").alias("rank"))


def replay_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").alias("key"), "text", (F.length("text") / F.lit(128.0)).alias("seconds"))
    return sampling.replay_pool(rows, 20).select("id", "key", "seconds")


def held_out_split(spark: SparkSession, d: str) -> DataFrame:
    rows = training.selected(ad.labels(spark, d), "A", 0).withColumn("split", training.split_of(0))
    return rows.where("split is not null").groupBy("split", "grade").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))


def training_items(spark: SparkSession, d: str) -> DataFrame:
    rows = training.items(training.selected(ad.labels(spark, d), "A", 0), 0)
    return rows.select("split", "pos", F.array_join("ids", ",").alias("ids"), "text", "seconds", "hard")


def epoch_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.labels(spark, d)
    train = sampling.dense(rows.select(F.col("pos").alias("at"), F.array("id").alias("ids"), F.array("audio").alias("audio"), "text", "seconds", (F.col("source") == "reviewed").alias("hard")), "at").drop("at")
    pool = ad.table(spark, d, "documents").select(F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.lit("r.wav").alias("audio"), "text", (F.length("text") / F.lit(16.0)).alias("seconds"))
    e = training.epoch(train, 0, 1, replay=pool, ratio=0.1)
    return e.select("kind", "pos", F.array_join("ids", ",").alias("ids"), F.md5("text").alias("digest"), "seconds")


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d).select("pos", F.greatest(F.size(F.split("text", " ")), F.lit(1)).cast("bigint").alias("length"))
    b = training.batches(rows)
    return b.select("pos", F.col("batch").cast("bigint").alias("batch"), "turn", "length")


def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    """What a trainer of three epochs reads: size, longest item and factor of each batch."""
    rows = ad.labels(spark, d)
    train = sampling.dense(rows.select(F.col("pos").alias("at"), F.array("id").alias("ids"), F.array("audio").alias("audio"), "text", "seconds", (F.col("source") == "reviewed").alias("hard")), "at").drop("at")
    plan = passes.training_plan(train, 3, pairs=0.0)
    return plan.groupBy("epoch").agg(F.count(F.lit(1)).alias("items"), F.sum("seconds").alias("seconds"), F.count_distinct("step").alias("steps"), F.max("step").alias("last"), _r(F.min("factor")).alias("least"), _r(F.max("factor")).alias("most"))


def rich_targets(spark: SparkSession, d: str) -> DataFrame:
    """Frames of different lengths in padded batches, read by a provider; each item's leading symbols and labels."""
    rows = ad.frames(spark, d).select("vec_id", F.slice("frames", F.lit(1), (F.col("vec_id") % 12 + 5).cast("int")).alias("frames"))
    heard = passes.frame_labels(frontend.padded_batches(rows, key="vec_id"), passes.Identity)
    return heard.select(F.col("pos").alias("vec_id"), F.array_join("rich", ",").alias("rich"), F.array_join("labels", ",").alias("text"))


def passes_report(spark: SparkSession, d: str) -> DataFrame:
    """Three passes of one system; a fiftieth of the transcripts comes late, and some come again."""
    rows = ad.utterances(spark, d)
    hyps = ad.hypotheses(rows, lossy=False)
    lost, again = draw(50, "lost", F.col("id")) == 0, F.col("pos") % 11 == 0
    marked = hyps.join(rows.select("id", lost.alias("lost"), again.alias("again"), F.col("text").alias("said")), "id")
    first = marked.where("not lost").select("system", "id", "hyp")
    late = marked.where("lost or again").select("system", "id", F.when(F.col("again"), F.col("said")).otherwise(F.col("hyp")).alias("hyp"))
    number = F.array_position(F.array(*map(F.lit, ad.SYSTEMS)), F.col("system")).cast("int")

    def told(hyps_: DataFrame, order: int) -> DataFrame:
        c = scoring.cells(rows.select("id", "text", "grade"), hyps_)
        return c.select(number.alias("pass"), F.concat(F.lit("grade "), "grade").alias("manifest"), F.lit("mine").alias("system"), "id", F.lit(order).alias("ord"), "errors", "tokens")

    known = told(first, 0)
    merged = passes.running(passes.merged_sums(passes.evaluation_sums(known), known, told(late, 1)))
    return merged.select("pass", "manifest", "utterances", "tokens", "errors", "wrong", _r("rate").alias("rate"), _r("mean_rate").alias("mean_rate"), "best")


# files: what a query writes into the shared folder and reads back

def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/queries-{uuid.uuid4().hex}"


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, path = ad.utterances(spark, d), _folder(spark)
    files.write_jsonl(rows.select("pos", "id", "text", F.when(F.col("continues"), F.col("grade")).alias("grade")), path, "pos")
    back = files.numbered(spark, path, "id STRING, text STRING, grade STRING")
    return sampling.dense(back, "seq", name="place").select("place", "id", F.md5("text").alias("digest"), "grade")


def map_files(spark: SparkSession, d: str) -> DataFrame:
    """A system of two map files, the second of which overrides the first."""
    rows, path = ad.utterances(spark, d), _folder(spark)
    heard = ad.hypotheses(rows, lossy=False).where("system = 'small'")
    files.write_map(heard, f"{path}/a", single=False)
    files.write_map(heard.join(rows.where("continues").select("id"), "id", "left_semi").withColumn("hyp", F.lower("hyp")), f"{path}/b", single=False)
    merged = scoring.merged_systems(files.read_system(spark, f"mine={path}/a,{path}/b"))
    return merged.select("system", "id", F.md5("hyp").alias("digest"))


def review_file(spark: SparkSession, d: str) -> DataFrame:
    rows, path = ad.reviewed(ad.utterances(spark, d)), _folder(spark)
    rows.select(F.concat_ws("\t", "id", "grade", F.when(F.col("grade") != "X", F.concat(F.lit("  "), F.col("text"), F.lit(" "))).otherwise("")).alias("value")).write.text(path)
    return files.read_reviewed(spark, path).select("id", "grade", "text")


def term_file(spark: SparkSession, d: str) -> DataFrame:
    lines, path = ["# terms", *ad.TERMS, "", " Mixed Case "], _folder(spark)
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    return files.read_terms(spark, path)


def manifest_grades(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a manifest; some rows name a group or a grade of their own."""
    path, own = _folder(spark), lambda k, c: F.when(F.col("doc_id") % k == 0, F.col(c))
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("a.wav").alias("audio"), "text", own(3, "source").alias("group"), own(5, "lang").alias("grade"))
    docs.write.json(path)
    return files.manifest(spark, path).select("id", "group", "grade")


def wave_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as 16-bit waves and read again: sums of their steps."""
    rows, path = ad.waves(spark, d).select(F.col("vec_id").cast("string").alias("name"), "wave"), _folder(spark)
    written = audio.write_waves(rows, path).agg(F.count(F.lit(1))).first()[0]
    read = audio.read_waves(spark, path)
    steps = F.transform("wave", lambda v: F.round(v.cast("double") * 32768).cast("bigint"))
    return read.select(F.regexp_extract("path", "([^/]+)[.]wav$", 1).cast("bigint").alias("vec_id"), _r(F.col("seconds") * audio.RATE).alias("samples"), F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max(steps).alias("top"), F.lit(written).cast("bigint").alias("files"))


def zip_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed into archives of up to 500 texts and read back, entry by entry."""
    docs, path = ad.table(spark, d, "documents"), _folder(spark)
    rows = docs.select(F.expr("doc_id div 500").alias("archive"), F.concat(F.lit("texts/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    zipped.write_archives(rows, path).agg(F.count(F.lit(1))).collect()
    read = zipped.read_entries(spark, path)
    return read.select(F.regexp_extract("archive", "([0-9]+)[.]zip$", 1).cast("bigint").alias("archive"), "name", "bytes", F.md5("content").alias("digest"))


def wave_features(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as stereo files of 8 kHz, resampled, turned into log-mel frames, stacked and normalised: sums of all frames."""
    rows, path = ad.waves(spark, d).select(F.col("vec_id").cast("string").alias("name"), F.flatten(F.array_repeat("wave", 60)).alias("wave")), _folder(spark)
    audio.write_waves(rows, path, rate=8000, channels=2).agg(F.count(F.lit(1))).collect()
    read = audio.read_waves(spark, path, convert=True).select(F.regexp_extract("path", "([^/]+)[.]wav$", 1).cast("bigint").alias("vec_id"), "seconds", "wave")
    made = frontend.log_mel(read, "wave", "mel")
    shift, scale = (F.transform(F.sequence(F.lit(1), F.lit(560)), lambda i: i / F.lit(x)) for x in (560.0, 1120.0))
    stacked = made.select("vec_id", F.col("seconds"), F.size("mel").cast("bigint").alias("frames"), F.explode(signal.lfr_stack(F.col("mel"))).alias("f"))
    summed = stacked.select("vec_id", "seconds", "frames", F.aggregate(signal.cmvn(F.col("f"), shift, scale), F.lit(0.0), lambda a, x: a + x).alias("s"))
    return summed.groupBy("vec_id", "frames").agg(F.round(F.max("seconds"), 3).alias("seconds"), F.count(F.lit(1)).alias("stacked"), F.round(F.sum("s"), 1).alias("total"))


# arrays

def span_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.frames(spark, d).select("vec_id", signal.mask_spans(F.col("frames"), (F.col("vec_id") % 7).cast("int"), (F.col("vec_id") % 5).cast("int")).alias("f"))
    return rows.select("vec_id", F.flatten("f").alias("w")).select("vec_id", *_ends("w"))


def piece_texts(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.array(*map(F.lit, ["▁so", "und", "▁", "s"]))
    rows = ad.frames(spark, d).select("vec_id", F.transform("frames", signal.best_symbol).alias("path"))
    return rows.select("vec_id", tx.decode_pieces(F.col("path"), pieces).alias("text"))


def trainable_items(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.utterances(spark, d).select("id", tx.score_tokens(F.col("text")).alias("labels"), F.floor(F.col("seconds") * 3).cast("int").alias("frames"))
    return rows.select("id", training.trainable(F.col("labels"), F.col("frames")).alias("usable"))


def block_choice(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of all families, and what is trained of them for two sizes."""
    kind, k = F.col("vec_id") % 6, (F.col("vec_id") % 50).cast("string")
    prefixes = [F.lit("encoder.encoders0.0."), F.concat(F.lit("encoder.encoders."), k, F.lit(".")), F.concat(F.lit("encoder.tp_encoders."), k, F.lit(".")), F.lit("ctc."), F.lit("encoder.tp_norm."), F.lit("encoder.after_norm.")]
    names = ad.table(spark, d, "embeddings").select(F.concat(F.get(F.array(*prefixes), kind.cast("int")), F.col("vec_id").cast("string")).alias("name"))
    return training.top_blocks(names, 20).withColumn("n", F.lit(20)).unionByName(training.top_blocks(names, 35).withColumn("n", F.lit(35)))


def ctc_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.frames(spark, d).select("vec_id", F.transform("frames", signal.best_symbol).alias("path"))
    both = rows.select("vec_id", signal.rich_and_text(F.col("path")).alias("r"))
    return both.select("vec_id", F.array_join("r.rich", ",").alias("rich"), F.array_join("r.text", ",").alias("text"))


def lfr_stack(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.frames(spark, d, 2).select("vec_id", F.posexplode(signal.lfr_stack(F.col("frames"))).alias("t", "f"))
    return rows.select("vec_id", F.col("t").cast("bigint").alias("t"), F.size("f").cast("bigint").alias("n"), _r(F.aggregate("f", F.lit(0.0), lambda a, x: a + x)).alias("total"), _r(F.element_at("f", 1)).alias("first"), _r(F.element_at("f", -1)).alias("last"))


def cmvn(spark: SparkSession, d: str) -> DataFrame:
    mean = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / F.lit(128.0))
    std = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(1.0) + i / F.lit(64.0))
    rows = ad.waves(spark, d).select("vec_id", signal.cmvn(F.col("wave"), mean, std).alias("f"))
    return rows.select("vec_id", *_ends("f"))


def _ends(c: str) -> list:
    return [_r(F.element_at(c, 1)).alias("first"), _r(F.element_at(c, -1)).alias("last"), _r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).alias("total")]


def gain_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.waves(spark, d).withColumn("db", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30))))
    return rows.select("vec_id", F.col("db").cast("bigint").alias("db"), signal.gain_clip(F.col("wave"), F.col("db")).alias("w")).select("vec_id", "db", *_ends("w"))


def peak_norm(spark: SparkSession, d: str) -> DataFrame:
    parts = [ad.waves(spark, d).select("vec_id", F.lit(p).alias("peak"), signal.peak_normalize(F.col("wave"), p).alias("w")) for p in (0.1, 0.3, 0.9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("vec_id", "peak", *_ends("w"))


def step_shift(spark: SparkSession, d: str) -> DataFrame:
    return ad.waves(spark, d).select("vec_id", signal.step_from_zero(F.col("wave")).alias("w")).select("vec_id", *_ends("w"))


def feature_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.waves(spark, d).select("vec_id", signal.mask_band(F.col("wave"), (F.col("vec_id") % 5).cast("int"), (F.col("vec_id") % 4).cast("int"), 8).alias("w"))
    return rows.select("vec_id", *_ends("w"))


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(101).select("id", _r(signal.lr_schedule(F.col("id") / 100.0)).alias("factor"))


def weight_mix(spark: SparkSession, d: str) -> DataFrame:
    w = ad.waves(spark, d).select(F.col("vec_id").cast("string").alias("name"), (F.col("vec_id") % 4 > 0).alias("is_float"), F.col("wave").alias("values"))
    tuned = w.select("name", F.transform("values", lambda v: v * 2 + 1).alias("values"))
    return training.mixed(w, tuned, 0.6).select("name", *_ends("values"))


def lora_merge(spark: SparkSession, d: str) -> DataFrame:
    cells = ad.waves(spark, d).select(F.col("vec_id").alias("i"), F.posexplode("wave").alias("j", "value")).withColumn("j", F.col("j").cast("bigint"))
    b = cells.where("j < 8").select("i", F.col("j").alias("r"), "value")
    a = cells.where("i < 8").select(F.col("i").alias("r"), "j", "value")
    return training.lora_merge(cells, a, b, 0.5).groupBy("i").agg(_r(F.sum("value")).alias("total"), _r(F.max("value")).alias("top"))


QUERIES = {
    f.__name__: f
    for f in (
        error_rate_by_subset, score_tokens_profile, squashed_lengths, markup_strip, cjk_normalize, text_fallback, speaker_key, joined_turns, error_rate_diff, error_rate_documents,
        bootstrap_ci, wrong_utterances, completeness_report, common_only, no_digits_rate, term_hits, merged_systems, agreement_counts, export_identity, session_status, session_positions,
        status_counts_minutes, continuation_chain, consensus_grade, label_counts, review_report, near_duplicate_pairs, duplicate_groups, balanced_folds, fold_report, leak_check,
        test_dev_split, replay_sample, held_out_split, training_items, epoch_plan, batch_plan, ctc_greedy, lfr_stack, cmvn, gain_clip, peak_norm, step_shift, feature_mask, lr_schedule,
        weight_mix, lora_merge, normalized_documents, script_rates, subset_intervals, jsonl_round_trip, map_files, review_file, term_file, manifest_grades, wave_files, span_mask, piece_texts,
        trainable_items, block_choice, utterance_groups, zip_files, wave_features, phrase_texts, epoch_batches, rich_targets, passes_report,
    )
}
