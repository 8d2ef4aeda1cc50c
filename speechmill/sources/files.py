"""Readers and writers of the engine's files: logs, transcript maps, reviews, terms, statistics, reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechmill import schemas
from speechmill.functions import text as tx
from speechmill.sources import store
from speechmill.sources.objects import read_objects


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines with a declared schema; blank lines are skipped, a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines): a quarantine instead of an abort."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where("r._corrupt is null").select("r.*").drop("_corrupt")
    return good, parsed.where("r._corrupt is not null").select("value")


#: Rows that one task can number; a split's number is above.
LINES = 1 << 33


def numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with ``seq``, which grows with the order of lines: by file name, then by the place in the file.

    Spark scans splits by falling size, so a row's number is that of its split in
    the order of names and offsets, and then its place in its task.
    """
    rows = read_jsonl(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    splits = rows.select("_file", "_start").distinct().withColumn("_split", F.row_number().over(Window.orderBy("_file", "_start")) - 1)  # a row for each split
    placed = rows.withColumn("_row", F.monotonically_increasing_id() % LINES).join(F.broadcast(splits), ["_file", "_start"])
    return placed.withColumn("seq", F.col("_split") * F.lit(LINES) + F.col("_row")).drop("_file", "_start", "_split", "_row")


def write_jsonl(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One object a line, nulls written out; ``order`` sorts a result that has to be read in order."""
    out = rows.orderBy(order).drop(order) if order else rows
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_maps(spark: SparkSession, paths: str | list[str], prefix: str = "hyp_") -> DataFrame:
    """(system, id, hyp) of files that hold one JSON object each, id to transcript; the file's name tells the system."""
    found = read_objects(spark, [paths] if isinstance(paths, str) else paths)
    stem = F.regexp_extract(F.regexp_extract("path", f"{re.escape(prefix)}[^/]*\\.json", 0), f"^{re.escape(prefix)}(.*)\\.json$", 1)
    return found.select(stem.alias("system"), F.col("key").alias("id"), F.col("value").alias("hyp"))


def read_system(spark: SparkSession, spec: str) -> DataFrame:
    """(system, ord, id, hyp) of ``name=path[,path...]``; a later file overrides equal ids once merged."""
    name, _, paths = spec.partition("=")
    if not name or not paths:
        raise ValueError(f"not a system: {spec!r}; it takes name=path[,path...]")
    parts = None
    for k, path in enumerate(paths.split(",")):
        one = read_objects(spark, [path]).select(F.lit(name).alias("system"), F.lit(k).alias("ord"), F.col("key").alias("id"), F.col("value").alias("hyp"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def write_object(rows: DataFrame, path: str, id_: str = "id", text: str = "hyp") -> int:
    """Writes one file with a JSON object, id to transcript, in the order of the ids; one task streams it, line by line. Returns its entries."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = 0
        with store.created(path) as out:
            out.write(b"{")
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    out.write(f"{',' if n else ''}\n{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}".encode())
                    n += 1
            out.write(b"\n}\n")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    told = rows.select(F.col(id_).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("id is not null")
    return told.repartition(1).sortWithinPartitions("id").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def write_map(rows: DataFrame, path: str, id_: str = "id", text: str = "hyp", pos: str | None = None, single: bool = True) -> None:
    """A JSON object, id to transcript, with an entry a line; ids have to be distinct.

    With ``single`` one task writes all lines, in the order of the ids (of ``pos``, if
    given), as one file; else each file of the folder has a range of them, and all of
    them, one after another, are the object. No task holds more than a line.
    """
    key = F.col(pos or id_)
    quoted = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)  # noqa: E731 - of an array of one text
    told = rows.select(key.alias("o"), F.to_json(F.array(F.col(id_).cast("string"))).alias("k"), F.to_json(F.array(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("v"))
    told = told.select("o", F.concat(quoted(F.col("k")), F.lit(": "), quoted(F.col("v"))).alias("value"))
    spark, n = rows.sparkSession, 1 if single else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = told.agg(F.min("o").alias("least"))
    lines = told.crossJoin(F.broadcast(least)).select(F.lit(1).alias("part"), "o", F.concat(F.when(F.col("o") == F.col("least"), "").otherwise(","), "value").alias("value"))  # one row
    ends = spark.createDataFrame([(0, "{"), (2, "}")], "part int, value string").select("part", F.lit(None).cast(told.schema["o"].dataType).alias("o"), "value")
    every = lines.unionByName(ends)
    dealt = every.coalesce(1).sortWithinPartitions("part", "o") if single else every.repartitionByRange(n, "part", "o").sortWithinPartitions("part", "o")
    dealt.select("value").write.mode("overwrite").text(path)


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """(id, grade, text) of a tab-separated review; raises on a bad grade, a missing text or an id that comes twice."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (tx.unicode_trim(F.col("value")) != ""))
    cells = F.split("value", "\t")
    rows = lines.select(F.get(cells, F.lit(0)).alias("id"), F.get(cells, F.lit(1)).alias("grade"), tx.unicode_trim(F.coalesce(F.get(cells, F.lit(2)), F.lit(""))).alias("text"))
    bad = rows.where(~F.coalesce(F.col("grade").isin("A", "B", "X"), F.lit(False)) | ((F.col("grade") != "X") & (F.col("text") == ""))).select("id").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: grade or text of {bad[0][0]} cannot be used")
    twice = rows.groupBy("id").count().where("count > 1").select("id").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: more than one verdict on {twice[0][0]}")
    return rows


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(pos, term): squashed lines that are no comments, in file order, repeats kept."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return lines.where(~F.col("line").startswith("#") & (tx.unicode_trim(F.col("line")) != "")).select(F.col("pos").cast("bigint").alias("pos"), tx.squash(F.col("line")).alias("term"))


def read_cmvn(spark: SparkSession, path: str) -> DataFrame:
    """(k, values): the vectors of a normalisation file, the shift first and then the scale."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    rows = whole.where(F.trim("value").startswith("<LearnRateCoef>")).select("line", F.split(F.trim("value"), r"\s+").alias("c"))
    values = F.transform(F.slice("c", 4, F.size("c") - 4), lambda v: v.cast("double"))
    return rows.select((F.row_number().over(Window.orderBy("line")) - 1).alias("k"), values.alias("values"))  # two lines


def write_report(blocks: DataFrame, path: str, order: str = "pos") -> None:
    """Text blocks in order, as text files whose names keep the order."""
    blocks.orderBy(order).select("block").write.mode("overwrite").text(path)


def error_blocks(wrong: DataFrame) -> DataFrame:
    """(pos, block) of labels that systems got wrong, from ``scoring.wrong_cells``."""
    line = lambda name, text: F.format_string("  %-22s %s", name, text)
    heard = F.array_join(F.transform("wrong", lambda x: line(x["system"], x["hyp"])), "\n")
    return wrong.select("pos", F.concat_ws("\n", F.format_string("## %s  %s", "id", "grade"), line(F.lit("label"), F.col("text")), heard).alias("block"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest in file order; where a row has none, ``group`` is the id and ``grade`` is "-"."""
    rows = numbered(spark, path, schemas.MANIFEST).withColumnRenamed("seq", "pos")
    return rows.withColumn("group", F.coalesce("group", "id")).withColumn("grade", F.coalesce("grade", F.lit("-")))


def token_table(pieces: list[str]) -> str:
    """The text of a token file: a piece and its number a line."""
    return "".join(f"{p} {i}\n" for i, p in enumerate(pieces))


def graph_metadata(pairs: dict[str, object]) -> str:
    """Key and value pairs that go into an exported graph, as JSON."""
    return json.dumps({k: str(v) for k, v in pairs.items()}, ensure_ascii=False, sort_keys=True)
