import json
import os
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill import cli, schemas
from speechmill.operators import frontend, phrases
from speechmill.sources import archive, audio, features, files, fingerprint, objects, store, zipped
from speechmill.sources.recognizers import FakeRecognizer, transcribed
from speechmill.streaming.status import live_states, log_stream


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "é", "text": null}\n\n{"id": "b", "text": "x"}\n', encoding="utf-8")
    assert [tuple(r) for r in files.numbered(spark, str(path), "id string, text string").orderBy("seq").select("id", "text").collect()] == [("é", None), ("b", "x")]
    files.write_jsonl(spark.read.json(str(path)), str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert '"text":null' in text and "é" in text
    path.write_text('{"id": "a"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|JSON"):
        files.read_jsonl(spark, str(path), "id string").collect()
    good, bad = files.read_jsonl_lenient(spark, str(path), "id STRING")
    assert [r.id for r in good.collect()] == ["a"] and [r.value for r in bad.collect()] == ["not json"]


def test_lines_are_numbered_by_file_and_offset_not_by_size(spark, tmp_path):
    """The later files are the larger ones, which Spark scans first; the largest is cut into splits, the last of which is small."""
    want = []
    for k, n in enumerate((3, 40, 500, 20_000)):
        rows = [(f"{k}-{i}", "x" * (i % 50)) for i in range(n)]
        (tmp_path / f"part-{k:05d}.json").write_text("".join(json.dumps({"id": a, "text": b}) + "\n" for a, b in rows))
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = files.numbered(spark, str(tmp_path), "id string, text string").orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.id, r.text) for r in got] == want and len({r.seq for r in got}) == len(want)


def test_maps(spark, tmp_path):
    (tmp_path / "hyp_x.json").write_text('{"a": "one", "b": "two"}')
    (tmp_path / "later.json").write_text('{"b": "new"}')
    assert {(r.system, r.id, r.hyp) for r in files.read_maps(spark, str(tmp_path / "hyp_x.json")).collect()} == {("x", "a", "one"), ("x", "b", "two")}
    from speechmill.operators.scoring import merged_systems

    got = merged_systems(files.read_system(spark, f"s={tmp_path}/hyp_x.json,{tmp_path}/later.json"))
    assert {r.id: r.hyp for r in got.collect()} == {"a": "one", "b": "new"}
    files.write_map(got, str(tmp_path / "m.json"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "m.json").glob("part-*"))) == {"a": "one", "b": "new"}
    with pytest.raises(ValueError, match="not a system"):
        files.read_system(spark, "nothing")


def test_reviews_and_terms(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text('# note\na\tA\t "x" \n\nb\tX\n')
    assert {tuple(r) for r in files.read_reviewed(spark, str(path)).collect()} == {("a", "A", '"x"'), ("b", "X", "")}
    for bad, why in (("a\tC\tx\n", "cannot be used"), ("a\tA\t \n", "cannot be used"), ("a\tA\tx\na\tB\ty\n", "more than one verdict on a")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=why):
            files.read_reviewed(spark, str(path))
    path.write_text("# c\nWi Fi\n\nx\nx\n")
    assert [r.term for r in files.read_terms(spark, str(path)).orderBy("pos").collect()] == ["wifi", "x", "x"]
    path.write_text("<Nnet>\n<LearnRateCoef> 0 [ 1.5 2 ]\nother\n<LearnRateCoef> 0 [ -1 3 ]\n")
    assert [r["values"] for r in files.read_cmvn(spark, str(path)).orderBy("k").collect()] == [[1.5, 2.0], [-1.0, 3.0]]


def test_archive(tmp_path):
    def pack(*names, data=b"x"):
        path = tmp_path / "a.zip"
        with zipfile.ZipFile(path, "w") as z:
            for n in names:
                z.writestr(n, data)
        return str(path)

    for name in ("../x", "/x", "a/../../x", "c:/x", "a//b"):
        with pytest.raises(ValueError, match="no relative paths"):
            archive.extract(pack("fine", name), str(tmp_path / "out"))
        assert not (tmp_path / "out" / "fine").exists()  # all is checked before the first is written
    with pytest.raises(ValueError, match="allowed"):
        archive.extract(pack("a", "b"), str(tmp_path / "out"), most_files=1)
    with pytest.raises(ValueError, match="allowed"):
        archive.extract(pack("a", data=b"12345"), str(tmp_path / "out"), most_bytes=4)
    os.symlink(str(tmp_path), str(tmp_path / "out" / "link"))
    with pytest.raises(ValueError, match="link"):
        archive.extract(pack("link/x"), str(tmp_path / "out"))
    root = archive.extract(pack("d/e.txt", "f"), str(tmp_path / "good"))
    assert (tmp_path / "good" / "d" / "e.txt").read_bytes() == b"x" and root.endswith("good")


def test_archives_are_read_where_tasks_run(spark, tmp_path):
    rows = [(a, f"d/{k:03d}.txt", bytes([a]) * k) for a in (1, 2) for k in range(200)] + [(3, "only.bin", None), (None, "lost", b"x")]
    made = zipped.write_archives(spark.createDataFrame(rows, "archive int, name string, content binary"), str(tmp_path / "z"))
    assert {(r.archive, r.entries) for r in made.collect()} == {("1", 200), ("2", 200), ("3", 1)}
    read = zipped.read_entries(spark, str(tmp_path / "z"), limit=60)
    assert read.rdd.getNumPartitions() > 20
    got = {(int(r.archive[-5]), r.name, bytes(r.content), r.bytes) for r in read.collect()}
    assert got == {(a, n, c or b"", len(c or b"")) for a, n, c in rows if a}
    listing = zipped.read_entries(spark, str(tmp_path / "z" / "2.zip"), content=False).collect()
    assert len(listing) == 200 and all(r.content is None and r.bytes == int(r.name[2:5]) for r in listing)
    whole = spark.createDataFrame([("x/1.zip", (tmp_path / "z" / "1.zip").read_bytes())], "path string, content binary").mapInArrow(zipped._whole(True, (1000, 10**6)), zipped.SCHEMA)
    assert {(r.name, bytes(r.content)) for r in whole.collect()} == {(n, c) for a, n, c in rows if a == 1}
    assert zipped.unpack(spark, str(tmp_path / "z" / "1.zip"), str(tmp_path / "out")) == 200
    assert (tmp_path / "out" / "d" / "007.txt").read_bytes() == b"\x01" * 7
    assert not store.reaches("nosuch://host/a.zip") and store.reaches(f"file:{tmp_path}/z")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert zipped.read_entries(spark, str(tmp_path / "none.zip")).collect() == []


def test_archives_that_are_refused(spark, tmp_path):
    def pack(*names):
        with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
            for n in names:
                z.writestr(n, b"12345")
        return str(tmp_path / "a.zip")

    for names, limits in ((("fine", "../x"), {}), (("/x",), {}), (("a", "b"), {"most_files": 1}), (("a", "b"), {"most_bytes": 9})):
        with pytest.raises(Exception, match="not an export"):
            zipped.unpack(spark, pack(*names), str(tmp_path / "out"), **limits)
        assert not (tmp_path / "out").exists()  # all is judged before the first is written
    (tmp_path / "out").mkdir()
    os.symlink(str(tmp_path), str(tmp_path / "out" / "link"))
    with pytest.raises(Exception, match="links lead out"):
        zipped.unpack(spark, pack("link/x"), str(tmp_path / "out"))
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"12345")] = 0x39
    (tmp_path / "a.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="CRC|checksum"):
        zipped.read_entries(spark, str(tmp_path / "a.zip")).collect()


TEXT = ["a", '"', "\\", ",", ":", "{", "}", " ", "é", "🙂", "\n", '", "', '": "', "null", ']:[', "[x]"]


def test_objects_in_ranges_of_any_size():
    r = random.Random(1)
    some = lambda: "".join(r.choice(TEXT) for _ in range(r.randint(0, 12)))
    for _ in range(600):
        d = {some() + str(i): r.choice([some(), some(), None]) for i in range(r.randint(0, 6))}
        text = json.dumps(d, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 0, 2]), separators=r.choice([None, (",", ":")])).encode()
        for limit in (1, 3, 7, 1000):
            got, state = [], objects.PLAIN
            for a in range(0, len(text), limit):
                step = r.choice([1, 2, 5, 100])
                got += objects.entries(iter([text[x : x + step] for x in range(a, len(text), step)]), state, min(limit, len(text) - a))
                state = objects.ends_in(text[a : a + limit], state)
            assert got == list(d.items()) and state == objects.PLAIN
    for bad in (b'{"a": 1, "b": "c"}', b'["a", "b"]', b'{"a": {"b": "c"}}', b'{"a": "b'):
        with pytest.raises(ValueError):
            list(objects.entries(iter([bad]), objects.PLAIN, len(bad)))


def test_large_maps_without_a_row_that_holds_them(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(f"{r.choice(TEXT)}{i}", None if i % 50 == 0 else r.choice(TEXT) + r.choice(TEXT), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, hyp string, pos long").repartition(7)
    for single in (False, True):
        path = str(tmp_path / f"hyp_m{single}.json")
        files.write_map(df, path, pos="pos", single=single)
        parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
        assert (len(parts) == 1) == single
        text = "".join(open(os.path.join(path, p), encoding="utf-8").read() for p in parts)
        assert list(json.loads(text).items()) == [(i, h or "") for i, h, _ in rows]
        assert {(x.system, x.id, x.hyp) for x in files.read_maps(spark, path).collect()} == {(f"m{single}", i, h or "") for i, h, _ in rows}
    (tmp_path / "one.json").write_text(text, encoding="utf-8")
    got = objects.read_objects(spark, [str(tmp_path / "one.json")], 1000)
    assert got.rdd.getNumPartitions() > 20 and {(x.key, x.value) for x in got.collect()} == {(i, h or "") for i, h, _ in rows}
    monkeypatch.setattr(objects.store, "reaches", lambda path: False)
    assert {(x.id, x.hyp) for x in files.read_system(spark, f"s={tmp_path}/one.json").collect()} == {(i, h or "") for i, h, _ in rows}
    files.write_map(df.where("pos < 0"), str(tmp_path / "none.json"), single=False)
    assert files.read_system(spark, f"s={tmp_path}/none.json").collect() == []


def riff(tag, channels, rate, bits, data, extended=False):
    head = struct.pack("<HHIIHH", 0xFFFE if extended else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    head += struct.pack("<HHIH14s", 22, bits, 0, tag, b"\0" * 14) if extended else b""
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"odd\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_waves_of_any_width_and_rate(spark, tmp_path):
    x = np.round(np.sin(np.arange(800) / 9) * 100) / 128
    forms = {
        "u8": riff(1, 1, 8000, 8, (x * 128 + 128).astype(np.uint8).tobytes()), "i16": riff(1, 2, 8000, 16, np.repeat((x * 32768).astype("<i2"), 2).tobytes()),
        "i24": riff(1, 1, 8000, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x), True), "i32": riff(1, 1, 8000, 32, (x * 2**31).astype("<i4").tobytes()),
        "f32": riff(3, 1, 8000, 32, x.astype("<f4").tobytes()), "f64": riff(3, 1, 8000, 64, x.astype("<f8").tobytes(), True),
    }
    for name, data in forms.items():
        got, rate = audio.decode_any(data)
        assert rate == 8000 and np.allclose(got, x, atol=1e-6), name
        (tmp_path / f"{name}.wav").write_bytes(data)
    for bad in (b"", b"RIFF", riff(7, 1, 8000, 8, b"x"), riff(1, 1, 8000, 12, b"xxxx"), riff(1, 0, 8000, 16, b""), b"RIFF\0\0\0\0WAVEdata\0\0\0\0"):
        with pytest.raises(ValueError):
            audio.decode_any(bad)
    read = audio.read_waves(spark, str(tmp_path), convert=True).collect()
    assert len(read) == 6 and all(len(r.wave) == 1600 and r.seconds == 0.1 for r in read)
    assert np.ptp([r.wave for r in read], axis=0).max() < 1e-5  # all forms of one wave
    with pytest.raises(Exception, match="8000 Hz"):
        audio.read_waves(spark, str(tmp_path)).collect()


def test_front_end_in_the_plan(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.1, int(n)).tolist(), [0.9, 1.0, 1.1][i % 3]) for i, n in enumerate(r.integers(100, 9000, 40))] + [(99, None, 1.0)]
    df = spark.createDataFrame(rows, "pos long, wave array<float>, factor double")
    made = {x.pos: x.mel for x in frontend.log_mel(df).collect()}
    for i, x, _ in rows:
        want = None if x is None else features.log_mel(np.array(x, np.float32))
        assert (made[i] is None) == (want is None) and (want is None or (len(made[i]) == len(want) and (not len(want) or np.allclose(made[i], want))))
    fast = {x.pos: x.wave for x in frontend.at_speed(df.where("pos < 99"), "factor").collect()}
    assert all(np.allclose(fast[i], features.speed(np.array(x, np.float32), f)) for i, x, f in rows if x)
    prompt = np.full((4, 80), 2.0, np.float32)
    seen = []
    for b in frontend.padded_batches(frontend.log_mel(df), prompt, frames="mel").collect():
        cells = np.frombuffer(b.data, "<f4").reshape(len(b.keys), -1, b.width)
        assert len(b.keys) <= 24 and (len(b.keys) == 1 or len(b.keys) * (cells.shape[1] - 4) <= 480) and cells.shape[1] == max(b.lengths)
        for k, n, m in zip(b.keys, b.lengths, cells, strict=True):
            seen.append(k)
            assert n == len(made[k]) + 4 and np.allclose(m[:4], 2.0) and np.allclose(m[4:n], made[k]) and not m[n:].any()
    assert sorted(seen) == sorted(i for i, m in made.items() if m)


def test_phrases_against_a_plain_longest_match(spark):
    r = random.Random(4)
    table = {"".join(r.choice("abc軟體") for _ in range(r.randint(1, 5))): "".join(r.choice("xyz软件") for _ in range(r.randint(0, 3))) for _ in range(40)}
    texts = ["".join(r.choice("abc軟體 d") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", "計程車"]

    def plain(t):
        out, at = "", 0
        while at < len(t):
            n = next((n for n in range(len(t) - at, 0, -1) if t[at : at + n] in table), 0)
            out += table[t[at : at + n]] if n else t[at]
            at += n or 1
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("more", F.lit(1))
    given = spark.createDataFrame([*table.items(), *list(table.items())[:3], (None, "x"), ("", "y")], "phrase string, replacement string")
    got = phrases.converted(rows, given)
    assert got.columns == ["id", "text", "more"]
    assert {x.id: x.text for x in got.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="more than one replacement"):
        phrases.converted(rows, given.unionByName(spark.createDataFrame([(next(iter(table)), "other")], "phrase string, replacement string")))
    assert phrases.converted(rows, given.where("false")).where("id = 302").first().text == "計程車"


def test_waves(spark, tmp_path):
    x = np.round(np.sin(np.arange(16000) / 9) * 8000) / 32768
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(x))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = audio.read_waves(spark, str(tmp_path / "*.wav"), strict=False).collect()
    assert len(got) == 1 and got[0].seconds == 1.0 and np.allclose(got[0].wave, x)
    with pytest.raises(Exception):
        audio.read_waves(spark, str(tmp_path / "b.wav")).collect()
    with pytest.raises(ValueError, match="8000 Hz"):
        audio.decode_wav(audio.encode_wav(x, 8000))
    out = audio.write_waves(spark.createDataFrame([("n", [0.5, -0.5])], "name string, wave array<double>"), str(tmp_path / "w")).collect()
    assert np.allclose(audio.decode_wav(open(out[0].audio, "rb").read()), [0.5, -0.5])


def test_recognizers(spark):
    rows = spark.createDataFrame([(str(i), "a b c d e", i) for i in range(40)], "id string, text string, n int")
    got = {r.id: r.hyp for r in transcribed(rows, lambda: FakeRecognizer(1, 0), "text", length="n").collect()}
    assert got == {str(i): "a b c d e" for i in range(40)}


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    one = fingerprint.digest(spark, [str(tmp_path / "a")], {"k": 1})
    assert one == fingerprint.digest(spark, [str(tmp_path / "a")], {"k": 1}) != fingerprint.digest(spark, [str(tmp_path / "a")], {"k": 2})
    fingerprint.claim(str(tmp_path / "run"), one)
    fingerprint.claim(str(tmp_path / "run"), one)
    with pytest.raises(ValueError, match="other inputs"):
        fingerprint.claim(str(tmp_path / "run"), "else")
    fingerprint.finish(str(tmp_path / "run"), 1, "{}")
    assert fingerprint.pending(str(tmp_path / "run"), range(3)) == [0, 2]


def test_stream_follows_the_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = [{"seq": 0, "v": 1, "type": "utterance", "session": "a"}, {"seq": 1, "v": 1, "type": "field", "session": "a", "dictated": "x", "text": "x"}, {"seq": 2, "v": 1, "type": "field", "session": "a", "dictated": "x", "text": "y"}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows[:2])))
    q = live_states(log_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert [r.status for r in spark.table("states").collect()] == ["accepted"]
        (folder / "2.json").write_text(json.dumps(rows[2]))
        q.processAllAvailable()
        assert [r.status for r in spark.table("states").collect()] == ["corrected"]
    finally:
        q.stop()


def test_commands(spark, tmp_path, capsys):
    export = tmp_path / "export"
    export.mkdir()
    texts = ["the first thing", "and another one", "the first thing again", "something else here"]
    lines = []
    for i, t in enumerate(texts):
        (export / f"{i}.wav").write_bytes(audio.encode_wav(np.zeros(160)))
        lines.append({"v": 1, "type": "utterance", "id": f"s{i}-00", "session": f"s{i}", "audio": f"{i}.wav", "seconds": 2.0, "text": t, "continues": False})
        lines.append({"v": 1, "type": "refined", "id": f"s{i}-00", "text": t})
    lines.append(lines[0] | {"id": "s9-00", "session": "s9", "audio": "gone.wav"})
    (export / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    work = str(tmp_path / "work")
    os.makedirs(work)
    cli.main(["prepare", str(export), work])
    rows = files.read_jsonl(spark, f"{work}/utterances.jsonl", schemas.UTTERANCES).collect()
    assert sorted(r.id for r in rows) == [f"s{i}-00" for i in range(4)]
    with pytest.raises(SystemExit, match="no transcripts"):
        cli.main(["label", work])
    cli.main(["hypotheses", work, "--percent", "0"])
    cli.main(["label", work, "--folds", "2"])
    labels = files.read_jsonl(spark, f"{work}/labels.jsonl", schemas.LABELS).collect()
    assert len(labels) == 4 and {r.grade for r in labels} == {"A"} and {r.fold for r in labels} == {0, 1}
    part = tmp_path / "part.json"
    part.write_text(json.dumps({f"s{i}-00": texts[i] for i in range(3)}))
    with pytest.raises(ValueError, match="lacks 1 of 4"):
        cli.main(["score", work, f"x={work}/hyp_small.json", f"y={part}"])
    cli.main(["score", work, f"x={work}/hyp_small.json", f"y={part}", "--common", "--errors", str(tmp_path / "errors")])
    (tmp_path / "terms").write_text("thing\n")
    cli.main(["terms", work, str(tmp_path / "terms"), f"x={work}/hyp_small.json"])
    cli.main(["items", work])
    assert "thing" in capsys.readouterr().out
    assert spark.read.parquet(f"{work}/items.parquet").agg(F.count(F.lit(1))).first()[0] == 4


def test_corpora(spark, tmp_path):
    def clip(level, seconds=1.5):
        return (audio.encode_wav(np.full(int(16000 * seconds), level)),)

    bench, out = tmp_path / "bench", str(tmp_path / "out")
    rows = [(clip(0.9), "a", "s1"), (clip(0.1), "b", None), ((b"broken",), "c", "s2"), (clip(0.1, 0.5), "d", "s3")]
    spark.createDataFrame(rows, "audio struct<bytes:binary>, sentence string, client_id string").coalesce(1).write.parquet(str(bench / "cv.parquet"))
    cli.main(["public", str(bench), out])
    got = files.read_jsonl(spark, f"{out}/test_cv.jsonl", schemas.MANIFEST).collect()
    assert sorted((r.text, r.group) for r in got) == [("a", "cv-s1"), ("b", None)] and all(os.path.exists(r.audio) for r in got)
    cli.main(["replay", str(tmp_path / "pool"), f"{bench}/cv.parquet:5", "--recognizer", "speechmill.sources.recognizers:LoudnessRecognizer"])
    pool = files.read_jsonl(spark, f"{tmp_path}/pool/replay.jsonl", schemas.REPLAY).collect()
    assert sorted(r.text for r in pool) == ["loud", "quiet"] and {r.seconds for r in pool} == {1.5}
    spark.conf.unset("spark.sql.caseSensitive")


def test_weights_exports_and_folds(spark, tmp_path):
    w = spark.createDataFrame([("a", True, [0.0, 2.0])], schemas.WEIGHTS)
    w.write.parquet(str(tmp_path / "w"))
    spark.createDataFrame([("a", True, [1.0, 4.0])], schemas.WEIGHTS).write.parquet(str(tmp_path / "t"))
    cli.main(["mix", str(tmp_path / "w"), str(tmp_path / "t"), "0.5", str(tmp_path / "m")])
    assert spark.read.parquet(str(tmp_path / "m")).first()["values"] == [0.5, 3.0]
    (tmp_path / "x.json").write_text('{"a": "1"}')
    (tmp_path / "y.json").write_text('{"a": "2"}')
    cli.main(["check-export", f"{tmp_path}/x.json,{tmp_path}/x.json", "--tokens", f"{tmp_path}/x.json,{tmp_path}/x.json"])
    assert not fingerprint.same_bytes(str(tmp_path / "x.json"), str(tmp_path / "y.json"))
    with pytest.raises(SystemExit):
        cli.main(["check-export", f"{tmp_path}/x.json,{tmp_path}/y.json"])
    work = tmp_path / "work"
    work.mkdir()
    (work / "labels.jsonl").write_text("\n".join(json.dumps({"id": f"i{i}", "text": "one two", "fold": i % 2}) for i in range(5)))
    for _ in range(2):
        cli.main(["cross-validate", str(work), str(tmp_path / "cv"), "--folds", "2", "--percent", "0"])
    assert json.loads((tmp_path / "cv" / "fold1.json").read_text()) == {"i1": "one two", "i3": "one two"}
    with pytest.raises(ValueError, match="other inputs"):
        cli.main(["cross-validate", str(work), str(tmp_path / "cv"), "--folds", "2", "--percent", "5"])
    cli.main(["transcribe", str(work / "labels.jsonl"), str(tmp_path / "hyp.json"), "--fold", "0", "--percent", "0"])
    assert set(json.loads("".join(p.read_text() for p in (tmp_path / "hyp.json").glob("part-*")))) == {"i0", "i2", "i4"}


def test_training_and_scored_folds(spark, tmp_path, capsys):
    work = tmp_path / "work"
    work.mkdir()
    said = "one two three four five six seven eight nine ten".split()
    rows = [{"id": f"s-{i:02d}", "session": "s", "audio": f"{i}.wav", "seconds": 2.0 + i, "text": " ".join(said[: i + 1]), "grade": "A", "source": "reviewed" if i == 3 else "agreed", "joins": [f"s-{i - 1:02d}"] if i == 5 else [], "group": i, "fold": i % 3} for i in range(9)]
    (work / "labels.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (work / "replay.jsonl").write_text("\n".join(json.dumps({"id": f"r{i}", "audio": "r.wav", "text": "re", "seconds": 3.0}) for i in range(40)))
    cli.main(["train", str(work), str(tmp_path / "run"), "--holdout", "0", "--epochs", "2", "--pairs", "0", "--replay", str(work / "replay.jsonl"), "--replay-ratio", "0.5", "--eval-epochs", "0,1", "--train", "top:20"])
    plan = spark.read.parquet(str(tmp_path / "run" / "plan")).collect()
    kinds = {e: sorted(r.kind for r in plan if r.epoch == e) for e in (1, 2)}
    # six of the labels, a whole sentence whose parts are both in folds that train, and half as many to rehearse; the reviewed one is held out
    whole = [r for r in plan if r.epoch == 1 and r.kind == "item" and len(r.ids) == 2]
    assert [r.ids for r in whole] == [["s-04", "s-05"]] and kinds[1] == kinds[2] == ["item"] * 7 + ["replay"] * 4
    assert all(0 < r.lr <= 2e-4 for r in plan) and {r.epoch for r in plan} == {1, 2}
    told = json.loads((tmp_path / "run" / "train.json").read_text())
    assert told["evaluated"] == [0, 1, 2] and told["items"] == 7 and told["train"] == "top:20" and "7 items to train on" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "run" / "held")).count() == 3
    for bad in ("top", "lora:0", "lora:x", "half"):
        with pytest.raises(ValueError, match="what is trained"):
            cli.main(["train", str(work), str(tmp_path / "bad"), "--train", bad])
    (work / "stock.json").write_text(json.dumps({r["id"]: "one" for r in rows}))
    for only, n in (([], 9), (["--only", "0,2"], 6)):
        cli.main(["cross-validate", str(work), str(tmp_path / f"cv{n}"), "--folds", "3", "--percent", "0", "--stock", str(work / "stock.json"), *only])
        shown = [[c.strip() for c in line.split("|")[1:-1]] for line in capsys.readouterr().out.splitlines() if line.startswith("|")]
        got = {x[1]: (x[2], float(x[4])) for x in shown if x[0] == "all"}
        words = sum(i + 1 for i in range(9) if not only or i % 3 in (0, 2))
        assert got["fine-tuned"] == (str(n), 0.0) and got["stock"][0] == str(n) and abs(got["stock"][1] - 100 * (words - n) / words) < 1e-6


def test_phone_conditions(spark, tmp_path, capsys):
    export = tmp_path / "work" / "export"
    export.mkdir(parents=True)
    (export / "a.wav").write_bytes(audio.encode_wav(np.full(1600, 0.3)))
    row = {"id": "a", "session": "a", "audio": str(export / "a.wav"), "seconds": 0.1, "index": 0, "of": 1, "continues": False, "phone": "x", "status": "accepted", "dictated": "quiet", "field": "quiet"}
    (tmp_path / "work" / "utterances.jsonl").write_text(json.dumps(row))
    cli.main(["check-phone", str(tmp_path / "work"), "--recognizer", "speechmill.sources.recognizers:LoudnessRecognizer"])
    shown = [line.split("|") for line in capsys.readouterr().out.splitlines() if line.count("|") == 4]
    rates = {x[1].strip(): x[2].strip() for x in shown[1:]}
    assert rates == {"as recorded": "0.0", "+10 dB": "100.0", "+20 dB": "100.0", "+30 dB": "100.0", "peak at 0.1": "0.0", "peak at 0.3": "0.0", "peak at 0.9": "100.0"}


def test_features():
    from speechmill.sources import features as ft

    t = np.arange(32000) / 32000
    x = np.sin(2 * np.pi * 440 * t)
    y = ft.to_rate(x, 32000)
    assert len(y) == 16000 and np.abs(y[500:-500] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[500:-500]).max() < 0.02
    assert len(ft.speed(x, 1.1)) == -(-32000 * 10 // 11) and len(ft.speed(x, 1.0)) == 32000
    m = ft.log_mel(y)
    assert m.shape == (1 + (16000 - 400) // 160, 80)
    peak = int(m.mean(0).argmax())
    centres = np.linspace(ft._mel(20.0), ft._mel(8000.0), 82)[1:-1]
    assert abs(peak - int(np.abs(centres - ft._mel(440.0)).argmin())) <= 1
    batch, lengths = ft.padded([np.ones((3, 2)), np.ones((1, 2))])
    assert batch.shape == (2, 3, 2) and batch[1, 1:].sum() == 0 and lengths.tolist() == [3, 1]
    both, longer = ft.prompted(batch, lengths, np.zeros((4, 2), np.float32))
    assert both.shape == (2, 7, 2) and longer.tolist() == [7, 5]
