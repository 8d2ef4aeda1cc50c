"""Commands over the API: ``python -m speechmill <command> ...``."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill import schemas
from speechmill.functions.text import score_tokens
from speechmill.operators import consensus, passes, sampling, scoring, sessions, similarity, training
from speechmill.sources import archive, audio, files, fingerprint, zipped
from speechmill.sources.recognizers import FakeRecognizer, transcribed


def session() -> SparkSession:
    return SparkSession.builder.appName("speechmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _log(spark: SparkSession, path: str) -> DataFrame:
    return files.numbered(spark, path, schemas.LOG)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    root = os.path.realpath(a.source if os.path.isdir(a.source) else os.path.join(a.work, "export"))
    if not os.path.isdir(a.source):
        zipped.unpack(spark, a.source, root)
    log = _log(spark, os.path.join(root, "log.jsonl"))
    there = archive.listed(spark, root).where(sessions.inside(F.col("audio")))
    kept, dropped = sessions.utterances(log, there)
    rows = kept.withColumn("pos", F.struct("first_seq", "seq")).withColumn("audio", F.concat(F.lit(root + "/"), F.col("audio"))).drop("first_seq", "seq")
    files.write_jsonl(rows, os.path.join(a.work, "utterances.jsonl"), "pos")
    sessions.status_counts(kept, dropped).orderBy("status").show(truncate=False)


def _utterances(spark: SparkSession, work: str) -> DataFrame:
    return files.numbered(spark, os.path.join(work, "utterances.jsonl"), schemas.UTTERANCES).withColumnRenamed("seq", "pos")


def recognizer(a: argparse.Namespace):
    """A factory of the recognizer that ``--recognizer module:name`` names; else the fake one."""
    if not a.recognizer:
        return lambda: FakeRecognizer(a.seed, a.percent)
    module, _, name = a.recognizer.partition(":")
    return getattr(importlib.import_module(module), name)


def hypotheses(spark: SparkSession, a: argparse.Namespace) -> None:
    """Transcripts of a recognizer; without one of your own the fake one corrupts what the phone wrote."""
    rows = _utterances(spark, a.work)
    if a.recognizer:
        waves = audio.read_waves(spark, os.path.join(a.work, "export")).withColumn("audio", F.regexp_replace("path", "^[a-z]+:/+", "/"))
        heard = transcribed(rows.join(waves, "audio"), recognizer(a), "wave", length="seconds")
    else:
        heard = transcribed(rows, recognizer(a), "phone")
    files.write_map(heard, os.path.join(a.work, f"hyp_{a.name}.json"))
    scoring.agreement(rows.where("not continues").join(heard, "id")).show()


def transcribe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Transcripts of a manifest, or of one fold of labels."""
    rows = spark.read.json(a.manifest)
    if a.fold is not None:
        rows = rows.where(F.col("fold") == a.fold)
    heard = transcribed(rows, recognizer(a), a.column)
    files.write_map(heard, a.out)


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a corpus with ``wave`` and ``seconds``; what cannot be decoded is left out."""
    raw = spark.read.parquet(path).withColumn("_key", F.monotonically_increasing_id())
    column = "context" if "context" in raw.columns else "audio"
    clips = raw.select(F.col("_key").cast("string").alias("path"), F.col(f"{column}.bytes").alias("content")).where("content is not null")
    return raw.join(audio.waves(clips, convert=True).withColumnRenamed("path", "_k"), F.col("_key").cast("string") == F.col("_k")).drop("_k")


def public(spark: SparkSession, a: argparse.Namespace) -> None:
    """Test and dev manifests, with waves, of each corpus in a folder."""
    spark.conf.set("spark.sql.caseSensitive", "true")  # corpora have both text and Text
    paths = sorted(os.path.join(a.bench, n) for n in os.listdir(a.bench) if n.endswith(".parquet"))
    for path, name in zip(paths, sampling.corpus_names(paths), strict=True):
        rows = sampling.benchmark_rows(_decoded(spark, path), name.startswith("ascend"))
        split = sampling.test_dev(rows, F.col("_key")).withColumn("id", F.format_string(f"{name}-%03d", F.col("rank") - 1))
        saved = audio.write_waves(split.select("id", "wave"), os.path.join(a.out, name), "id").withColumnRenamed("name", "id")
        out = split.join(saved, "id").select("rank", "id", saved["audio"], F.col("said").alias("text"), F.when(F.col("who").isNotNull(), F.concat(F.lit(f"{name}-"), "who")).alias("group"), "split")
        out = out.persist()
        for part in ("test", "dev"):
            files.write_jsonl(out.where(F.col("split") == part).drop("split"), os.path.join(a.out, f"{part}_{name}.jsonl"), "rank")
        out.unpersist()


def replay(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rehearsal rows of corpora, ``path[:N]`` each, transcribed by the recognizer as it is."""
    specs = [c.rpartition(":") if c.rpartition(":")[2].isdigit() else (c, "", "400") for c in a.corpora]
    pools = None
    for (path, _, n), name in zip(specs, sampling.corpus_names([s[0] for s in specs]), strict=True):
        rows = _decoded(spark, path).select(F.lit(name).alias("corpus"), F.col("_key").alias("key"), "wave", "seconds").where(F.col("seconds").between(sampling.SHORTEST, sampling.LONGEST))
        texts = transcribed(rows, recognizer(a), "wave", "key", "seconds").select(F.col("id").cast("bigint").alias("key"), F.col("hyp").alias("text"))
        one = sampling.replay_pool(rows.join(texts, "key"), int(n))
        saved = audio.write_waves(one.select("id", "wave"), os.path.join(a.out, name), "id").withColumnRenamed("name", "id")
        out = one.join(saved, "id").select("corpus", "rank", "id", "audio", "text", "seconds")
        pools = out if pools is None else pools.unionByName(out)
    files.write_jsonl(pools.withColumn("o", F.struct("corpus", "rank")).drop("corpus", "rank"), os.path.join(a.out, "replay.jsonl"), "o")


def mix(spark: SparkSession, a: argparse.Namespace) -> None:
    """Weights between two tables of (name, is_float, values)."""
    base, tuned = spark.read.parquet(a.base), spark.read.parquet(a.tuned)
    foreign = training.foreign_weights(base, tuned)
    if foreign:
        raise SystemExit(f"the tuned weights have names that the base lacks: {foreign}")
    training.mixed(base, tuned, a.weight).write.mode("overwrite").parquet(a.out)


def check_export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compares transcripts of two exports, pair by pair of map files; any difference is an exit code of 1."""
    wrong = 0
    if a.tokens and not fingerprint.same_bytes(*a.tokens.split(",")):
        print(f"{a.tokens}: the token files differ")
        wrong += 1
    for pair in a.pairs:
        first, second = pair.split(",")
        r = scoring.identical(files.read_system(spark, f"a={first}"), files.read_system(spark, f"a={second}"), ["id"]).first()
        print(f"{first}: {r['same']} of {r['total']} the same")
        wrong += r["total"] - r["same"]
    if wrong:
        raise SystemExit(1)


def check_phone(spark: SparkSession, a: argparse.Namespace) -> None:
    """Error rates against the field under seven loudness conditions."""
    from speechmill.functions import signal
    from speechmill.functions.distance import error_counts

    rows = _utterances(spark, a.work).where("of = 1 and field is not null and status <> 'undone'")
    waves = audio.read_waves(spark, os.path.join(a.work, "export")).withColumn("audio", F.regexp_replace("path", "^[a-z]+:/+", "/")).drop("seconds")
    heard = rows.join(waves, "audio").withColumn("wave", F.transform("wave", lambda v: v.cast("double")))
    conditions = {"as recorded": F.col("wave")} | {f"+{db} dB": signal.gain_clip(F.col("wave"), db) for db in (10, 20, 30)} | {f"peak at {p}": signal.peak_normalize(F.col("wave"), p) for p in (0.1, 0.3, 0.9)}
    every = heard.select("id", "field", F.explode(F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*conditions.values()))).alias("condition", "wave"))
    keyed = every.withColumn("key", F.concat_ws("/", "condition", "id"))
    texts = transcribed(keyed, recognizer(a), "wave", "key").withColumnRenamed("id", "key")
    counted = keyed.join(texts, "key").withColumn("c", error_counts(score_tokens(F.col("field")), score_tokens(F.col("hyp"))))
    counted.groupBy("condition").agg(scoring.rate(F.col("c.errors"), F.col("c.tokens")).alias("rate"), F.count(F.lit(1)).alias("utterances")).orderBy("condition").show(truncate=False)


def cross_validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Transcribes each fold that is not done yet, into a folder that belongs to these inputs; then merges the folds."""
    labels_path = os.path.join(a.work, "labels.jsonl")
    inputs = [os.path.join(d, n) for d, _, names in os.walk(labels_path) for n in names if n.startswith("part-")] or [labels_path]
    fingerprint.claim(a.out, fingerprint.digest(spark, inputs, {"recognizer": a.recognizer, "seed": a.seed, "percent": a.percent, "column": a.column}))
    labels = files.read_jsonl(spark, labels_path, schemas.LABELS)
    folds = sorted({int(k) for k in a.only.split(",")}) if a.only else list(range(a.folds))
    for fold in fingerprint.pending(a.out, folds):
        files.write_object(transcribed(labels.where(F.col("fold") == fold), recognizer(a), a.column), os.path.join(a.out, f"fold{fold}.json"))
    paths = [os.path.join(a.out, f"fold{fold}.json") for fold in folds]
    print(f"{files.read_system(spark, 'all=' + ','.join(paths)).count()} transcripts of {len(folds)} folds")
    if a.stock:
        rows = files.numbered(spark, labels_path, schemas.LABELS).withColumnRenamed("seq", "pos").where(F.col("grade") == "A")
        hyps = scoring.merged_systems(files.read_system(spark, f"stock={a.stock}").unionByName(files.read_system(spark, f"fine-tuned={','.join(paths)}")))
        if a.only:  # with some folds only their ids were transcribed, on purpose
            rows = scoring.complete(rows, hyps, ["stock", "fine-tuned"])
        else:
            scoring.require_complete(rows, hyps, ["stock", "fine-tuned"])
        scoring.subset_rates(scoring.cells(rows, hyps), with_status=False).orderBy("subset", "system").show(truncate=False)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """The plan of a training: all epochs, batch by batch with their learning rates, and the options; ``--trainer`` is then given both."""
    training.train_spec(a.train)
    labels = files.numbered(spark, os.path.join(a.work, "labels.jsonl"), schemas.LABELS).withColumnRenamed("seq", "pos")
    made = training.items(training.selected(labels, a.grades, a.holdout), a.holdout).persist()
    rows = made.where("split = 'train'").withColumn("first", F.element_at("ids", 1)).withColumn("n", F.size("ids")).withColumnRenamed("pos", "at")
    rows = sampling.dense(rows, "at", "n", "first").drop("at", "n", "first", "split")
    pool = spark.read.schema(schemas.REPLAY).json(a.replay) if a.replay else None
    plan = passes.training_plan(rows, a.epochs, a.seed, a.hard, a.pairs, pool, a.replay_ratio, a.max_cells).withColumn("lr", F.col("factor") * a.lr)
    plan.write.mode("overwrite").partitionBy("epoch").parquet(os.path.join(a.out, "plan"))
    made.where("split = 'held'").write.mode("overwrite").parquet(os.path.join(a.out, "held"))
    counts = {r["split"]: r for r in made.groupBy("split").agg(F.count(F.lit(1)).alias("n"), (F.sum("seconds") / 60).alias("minutes")).collect()}
    made.unpersist()
    known, held = (counts.get(k) for k in ("train", "held"))
    print(f"{known['n'] if known else 0} items to train on ({known['minutes'] if known else 0:.1f} min), {held['n'] if held else 0} held out, {pool.count() if pool is not None else 0} to rehearse")
    evaluated = sorted({int(e) for e in a.eval_epochs.split(",") if e} | {a.epochs})
    options = {k: v for k, v in vars(a).items() if k not in ("run", "command")} | {"items": known["n"] if known else 0, "evaluated": evaluated}
    with open(os.path.join(a.out, "train.json"), "w", encoding="utf-8") as f:
        json.dump(options, f, indent=1, ensure_ascii=False)
    if a.trainer:
        module, _, name = a.trainer.partition(":")
        getattr(importlib.import_module(module), name)(spark, plan, options)


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _utterances(spark, a.work)
    names = sorted(n for n in os.listdir(a.work) if n.startswith("hyp_") and n.endswith(".json"))
    if f"hyp_{consensus.PRIMARY}.json" not in names:
        raise SystemExit(f"no transcripts of {consensus.PRIMARY!r} in {a.work}: the command hypotheses makes them")
    hyps = None
    for n in names:
        one = files.read_system(spark, f"{n[4:-5]}={os.path.join(a.work, n)}").drop("ord")
        hyps = one if hyps is None else hyps.unionByName(one)
    review = files.read_reviewed(spark, a.manual) if a.manual else spark.createDataFrame([], schemas.REVIEWED)
    unknown = consensus.unknown_ids(review, rows)
    if unknown:
        raise SystemExit(f"the review names utterances that are not in the export: {unknown}")
    judged = consensus.graded(rows.join(consensus.hypothesis_lists(hyps), "id"), review)
    labels = sessions.chains(judged.where("outcome in ('A', 'B')")).withColumn("tokens", score_tokens(F.col("text")))
    grouped = similarity.balanced_folds(similarity.label_groups(labels), a.folds, a.seed)
    out = grouped.select("pos", "id", "session", "audio", "seconds", "text", "grade", "source", "joins", F.col("group").cast("int").alias("group"), "fold")
    files.write_jsonl(out, os.path.join(a.work, "labels.jsonl"), "pos")
    files.write_report(consensus.review_blocks(judged), os.path.join(a.work, "review.txt"))
    consensus.outcome_counts(judged).show()
    similarity.fold_report(grouped, a.folds).orderBy("fold").show()


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.manifest:
        rows, specs = files.manifest(spark, a.manifest), a.args
    else:
        work, specs = a.args[0], a.args[1:]
        labels = files.numbered(spark, os.path.join(work, "labels.jsonl"), schemas.LABELS).withColumnRenamed("seq", "pos")
        rows = scoring.with_status(labels.where(F.instr(F.lit(a.grade), F.col("grade")) > 0), _utterances(spark, work))
    systems = [s.partition("=")[0] for s in specs]
    hyps = None
    for s in specs:
        one = files.read_system(spark, s)
        hyps = one if hyps is None else hyps.unionByName(one)
    hyps = scoring.merged_systems(hyps)
    if a.common:
        scoring.missing(rows, hyps, systems).orderBy("system").show(truncate=False)
        rows = scoring.complete(rows, hyps, systems)
    else:
        scoring.require_complete(rows, hyps, systems)
    if a.no_digits:
        rows = scoring.without_digits(rows, hyps)
    cells = scoring.cells(rows, hyps).persist()
    rates = scoring.subset_rates(cells, with_status=not a.manifest)
    rates.orderBy("subset", "system").show(100, truncate=False)
    if len(systems) > 1:
        scoring.differences(rates, systems[0]).join(scoring.subset_intervals(cells, systems[0], with_status=not a.manifest), ["subset", "system"], "left").orderBy("subset", "system").show(100, truncate=False)
    if a.errors:
        files.write_report(files.error_blocks(scoring.wrong_cells(cells)), a.errors)
    cells.unpersist()


def terms(spark: SparkSession, a: argparse.Namespace) -> None:
    labels = files.numbered(spark, os.path.join(a.work, "labels.jsonl"), schemas.LABELS).withColumnRenamed("seq", "pos")
    hyps = None
    for s in a.specs:
        one = files.read_system(spark, s)
        hyps = one if hyps is None else hyps.unionByName(one)
    names = [s.partition("=")[0] for s in a.specs]
    scoring.term_hits(labels, scoring.merged_systems(hyps), files.read_terms(spark, a.terms), names).orderBy(F.col("pos").asc_nulls_last()).show(200, truncate=False)


def items(spark: SparkSession, a: argparse.Namespace) -> None:
    labels = files.numbered(spark, os.path.join(a.work, "labels.jsonl"), schemas.LABELS).withColumnRenamed("seq", "pos")
    made = training.items(training.selected(labels, a.grades, a.holdout), a.holdout)
    made.write.mode("overwrite").parquet(os.path.join(a.work, "items.parquet"))
    made.groupBy("split", "hard").agg(F.count(F.lit(1)).alias("items"), F.sum("seconds").alias("seconds")).show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="speechmill", description="Analytics for spoken-language corpora")
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *arguments: tuple) -> None:
        c = sub.add_parser(run.__name__.replace("_", "-"))
        c.set_defaults(run=run)
        for names, options in arguments:
            c.add_argument(*names, **options)
        if any(n == ("--recognizer",) for n, _ in arguments):
            c.add_argument("--seed", type=int, default=0)
            c.add_argument("--percent", type=int, default=10)

    word = lambda n, **o: ((n,), o)
    number = lambda n, d: ((n,), {"type": int, "default": d})
    command(prepare, word("source"), word("work"))
    model = word("--recognizer", help="module:name of a factory; without it the fake recognizer")
    command(hypotheses, word("work"), word("name", nargs="?", default=consensus.PRIMARY), model)
    command(transcribe, word("manifest"), word("out"), ((("--fold",), {"type": int})), word("--column", default="text"), model)
    command(public, word("bench"), word("out"))
    command(replay, word("out"), word("corpora", nargs="+"), model)
    command(mix, word("base"), word("tuned"), (("weight",), {"type": float}), word("out"))
    command(check_export, word("pairs", nargs="+"), word("--tokens", help="two token files that have to be the same, joined by a comma"))
    command(check_phone, word("work"), model)
    real = lambda n, d: ((n,), {"type": float, "default": d})
    flag = lambda n: ((n,), {"action": "store_true"})
    command(
        train, word("work"), word("out"), number("--holdout", -1), number("--epochs", 8), real("--lr", 2e-4), word("--train", default="lora:16"), flag("--no-augment"), real("--pairs", 0.15), number("--hard", 3),
        word("--replay"), real("--replay-ratio", 2.0), word("--eval-epochs", default=""), flag("--save"), word("--extra-eval", nargs="*", default=[]), word("--grades", default="AB"), number("--max-cells", 480),
        number("--seed", 0), word("--trainer", help="module:name of a function of session, plan and options"),
    )
    command(cross_validate, word("work"), word("out"), number("--folds", 5), word("--only", help="folds, joined by commas"), word("--stock", help="transcripts to score against"), word("--column", default="text"), model)
    command(label, word("work"), word("--manual"), number("--folds", 5), number("--seed", 0))
    command(score, word("args", nargs="+"), word("--manifest"), word("--grade", default="A"), word("--errors"), word("--no-digits", action="store_true"), word("--common", action="store_true"))
    command(terms, word("work"), word("terms"), word("specs", nargs="+"))
    command(items, word("work"), word("--grades", default="AB"), number("--holdout", -1))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
