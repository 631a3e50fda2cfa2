"""Readers, sinks and rules that are a plan or two."""

import json

import numpy as np
from pyspark.sql import functions as F

from parley.functions import audio, display
from parley.operators import change, export, live, scoring
from parley.sources import files


def test_read_sentences(spark, tmp_path):
    rows = [("ал осы", {"bytes": b"2", "path": "x/b.mp3"}), ("ал осы", {"bytes": b"1", "path": "x/a.mp3"}), ("екі 2", {"bytes": b"3", "path": "c.mp3"}), ("бір", {"bytes": b"4", "path": "d.e.mp3"}), (None, {"bytes": b"5", "path": "z"})]
    spark.createDataFrame(rows, "sentence string, audio struct<bytes:binary,path:string>").write.parquet(f"{tmp_path}/cv")
    assert sorted((r.id, r.text, bytes(r.sound)) for r in files.read_sentences(spark, f"{tmp_path}/cv").collect()) == [("a", "ал осы", b"1"), ("d.e", "бір", b"4")]


def test_manifests_and_listings(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "duration": 1.5}\nbroken\n\n[1]\n{"id": "b", "duration": 2}\n')
    assert sorted((r.id, r.duration) for r in files.manifest(spark, f"{tmp_path}/m.jsonl").filter("id IS NOT NULL").collect()) == [("a", 1.5), ("b", 2.0)]
    assert sorted(r.value for r in files.broken_lines(spark, f"{tmp_path}/m.jsonl").collect()) == ["[1]", "broken"]
    (tmp_path / "t.tsv").write_text('7\tf.wav\tRaw "one"\traw one\tr a w\t16000\tFEMALE\n')
    assert [tuple(r) for r in files.sentences(spark, f"{tmp_path}/t.tsv").collect()] == [(7, "f.wav", 'Raw "one"', "raw one", 16000, "FEMALE")]


def test_results_are_written_and_read(spark, tmp_path):
    schema = "model string, sets map<string,struct<n:long,wer:double,cer:double,rtf:double>>"
    first = spark.createDataFrame([("m1", {"s": (3, 0.5, 0.25, None)}), ("m2", {})], schema)
    export.write_results(first, f"{tmp_path}/out")
    export.write_results(spark.createDataFrame([("m2", {"s": (1, 0.0, 0.0, 0.1)})], schema), f"{tmp_path}/out")
    found = {r.model: r.sets for r in spark.read.schema(schema).json(f"{tmp_path}/out").collect()}
    assert found["m1"]["s"].wer == 0.5 and found["m2"]["s"].n == 1 and len(found) == 2
    line = next(p for p in (tmp_path / "out").glob("folder=m1/*.json")).read_text()
    assert json.loads(line)["sets"]["s"]["rtf"] is None


def test_restricted_sets_and_totals(spark):
    items = spark.createDataFrame([(m, s, k, 30.0) for m in ("a", "b") for s in ("x", "y") for k in range(4)], "model string, dataset string, k int, seconds double")
    allowed = spark.createDataFrame([("a", "x")], "model string, dataset string")
    got = scoring.restricted(items, allowed, "model", "dataset", "k", 3).groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).collect()
    assert sorted(map(tuple, got)) == [("a", "x", 3, 2), ("b", "x", 3, 2), ("b", "y", 3, 2)]
    assert scoring.restricted(items, allowed, "model", "dataset", "k").count() == 12
    assert sorted(map(tuple, scoring.set_totals(items, "dataset", "seconds").collect())) == [("x", 8, 4.0), ("y", 8, 4.0)]


def test_rolling_summaries(spark):
    runs = [(1, 1, "done", "A"), (1, 2, "error", None), (1, 3, "streaming", "Б"), (1, 4, "done", "B"), (2, 1, "streaming", "c"), (2, 2, "error", None)]
    got = live.rolling_summaries(spark.createDataFrame(runs, "meeting_id int, n int, status string, text string")).orderBy("meeting_id", "n").collect()
    assert [(r.previous, r.shown) for r in got] == [(None, "A"), ("A", "A"), ("A", "A"), ("A", "B"), (None, "c"), (None, "")]


def test_enrollments(spark):
    rng = np.random.default_rng(1)
    quiet, loud = rng.normal(0, 0.0005, 32_000), rng.normal(0, 0.2, 64_480)
    rows = [("long", np.concatenate([quiet, loud]).tolist()), ("short", np.concatenate([quiet, loud[:30_000]]).tolist()), ("none", []), ("null", None)]
    got = {r.k: (r.speech_ms, r.ok) for r in live.enrollments(spark.createDataFrame(rows, "k string, samples array<float>")).collect()}
    assert got["long"] == (len(audio.voiced(np.array(rows[0][1], np.float32))) // 16, True) and got["long"][0] >= 4000
    assert got["short"][1] is False and got["none"] == (0, False) and got["null"][1] is None


def test_cuts_are_moved_to_quiet_places(spark):
    length, hop = 24_000, 8_000
    total = 8 * 16_000
    starts = [*range(0, total - length + 1, hop)]
    change_at = 4 * 16_000
    share = [min(max(change_at - s, 0), length) / length for s in starts]
    embeddings = [[a, 1 - a] for a in share]
    samples = np.random.default_rng(2).normal(0, 0.1, total)
    samples[change_at + 3000 : change_at + 3600] = 0
    rows = [(1, "u", starts, embeddings, total, samples.tolist())]
    sound = spark.createDataFrame(rows, "meeting_id int, segment_id string, starts array<int>, embeddings array<array<double>>, total int, samples array<double>")
    plain = sound.drop("samples")
    assert change.cuts_of(plain, length, hop).first().cuts == [change_at]
    cut = change.cuts_of(sound, length, hop).first().cuts
    assert len(cut) == 1 and change_at + 3000 <= cut[0] <= change_at + 3600


def test_names_in_label_order_and_array_functions(spark):
    df = spark.createDataFrame([(["x", "mic:1", "sys:10", "sys:2", "me"], list("abcde"), [0.0, 0.5, 0.01], [True, False, False])], "l array<string>, n array<string>, p array<double>, b array<boolean>")
    r = df.select(F.map_entries(display.names_snapshot(F.col("l"), F.col("n"))).alias("m"), audio.noise_floor_column(F.col("p")).alias("f"), audio.gains_column(F.col("p")).alias("g"), audio.hangover_column(F.col("b")).alias("h")).first()
    assert [tuple(x) for x in r.m] == [("me", "e"), ("sys:2", "d"), ("sys:10", "c"), ("mic:1", "b"), ("x", "a")]
    assert r.g == audio.gains(np.array([0.0, 0.5, 0.01])).tolist() and r.h == [True, True, True] and len(r.f) == 3


# Published log mel energies of two sines, by bin and frame.
GOLDEN_MEL = {(0, 0): -9.823614, (7, 0): -3.986469, (7, 4): -4.014165, (10, 3): 5.460522, (63, 8): -20.723266}


def test_log_mel_has_the_published_values():
    t = np.arange(1600) / 16_000
    mel = audio.log_mel((0.5 * np.sin(2 * np.pi * 440 * t) + 0.1 * np.sin(2 * np.pi * 3000 * t)).astype(np.float32))
    assert mel.shape == (64, 9)
    assert all(abs(mel[at] - v) < 1e-4 for at, v in GOLDEN_MEL.items())
