"""Streams with named state against plain replays, whatever the batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import live, turns
from parley.streaming import flows, named

FAR = 10_000_000


def fed(spark, tmp_path, rows, schema, batches, order):
    """``rows`` as a stream of ``batches`` files by ``order``, and a last batch that moves the clock on."""
    rows = sorted(rows, key=order)
    size = -(-len(rows) // batches)
    for k, part in enumerate([rows[i : i + size] for i in range(0, len(rows), size)]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
        for n in os.listdir(f"{tmp_path}/in/{k:03}"):
            os.utime(f"{tmp_path}/in/{k:03}/{n}", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


EVENTS = f"meeting_id long, {named.EVENT}"
CALL = ["мы обсудим план выпуска и сроки", "нужно проверить отчёт до пятницы", "кто возьмёт эту задачу на себя"]


def logs(rng, meetings=3, seconds=60):
    """Audio of the call, its finals, and a microphone that repeats them or speaks for itself."""
    rows = []
    for m in range(1, meetings + 1):
        n = 0
        for t in range(0, seconds * 1000, 4000):
            text, start = rng.choice(CALL), t + rng.randrange(500)
            end = start + 2500
            rows += [(m, start + k * 100, "audio", "", "system", start + k * 100 - 100, start + k * 100, "", True, rng.choice([0.1, 0.1, 0.0001])) for k in range(25)]
            if rng.random() < 0.8:
                rows.append((m, end + rng.randrange(100, 4000), "segment", f"system-{n}", "system", start, end, text, True, 0.0))
            if rng.random() < 0.5:
                rows.append((m, start + 900, "segment", f"mic-{n}", "mic", start, start + 800, text[:9], False, 0.0))
            said = text if rng.random() < 0.6 else "я думаю совсем о другом"
            rows.append((m, end + rng.randrange(50, 900), "segment", f"mic-{n}", "mic", start + 50, end, said, True, 0.0))
            n += 1
    return rows


def wanted(rows):
    out = []
    for m in {r[0] for r in rows}:
        out += [(m, *x) for x in named.replayed([dict(zip(EVENTS.replace(" long", "").replace(" string", "").replace(" boolean", "").replace(" double", "").split(", "), r)) for r in rows if r[0] == m])]
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 9])
def test_hold_back(spark, tmp_path, batches):
    """Arrivals shuffled within 150 ms; deadlines come from timers, as nothing follows the last finals but the clock."""
    rng = random.Random(3)
    rows = logs(rng)
    late = {r: r[1] + rng.randrange(150) for r in rows}
    clock = (99, FAR, "audio", "", "system", FAR, FAR, "", True, 0.0)
    stream = fed(spark, tmp_path, [*rows, clock], EVENTS, batches, lambda r: late.get(r, FAR))
    got = flows.run_once(named.held_back(stream), f"named_{batches}", wait_s=240).filter("meeting_id < 99").collect()
    want = wanted(rows)
    assert sorted((r.meeting_id, r.id, r.text, r.emitted_ms) for r in got) == want
    finals = [w for w in want if w[1].startswith("mic")]
    assert any(not w[2] for w in finals) and len(finals) < sum(r[3].startswith("mic") for r in rows)


def test_state_stays_bounded(spark, tmp_path):
    """Ten minutes of a meeting: what is kept is its last minute's, and idle meetings keep a clock."""
    rng = random.Random(5)
    rows = logs(rng, 2, 600)
    clock = (99, FAR, "audio", "", "system", FAR, FAR, "", True, 0.0)
    stream = fed(spark, tmp_path, rows, EVENTS, 4, lambda r: r[1])
    checkpoint = f"{tmp_path}/checkpoint"
    query = named.held_back(stream).writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    finals = read("finals").select("key.*", "user_map_key.*") if "user_map_key" in read("finals").columns else read("finals")
    per_meeting = {r[0]: r[1] for r in finals.groupBy(finals.columns[0]).count().collect()}
    assert per_meeting and max(per_meeting.values()) <= 60_000 // 4000 + 3
    sizes = 0
    for name in ("finals", "sounds", "shown", "speaking", "held", "pending", "clock"):
        sizes += read(name).select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    assert sizes < 2 * 20_000


def test_hold_back_on_processing_time(spark, tmp_path):
    rows = [r for r in logs(random.Random(8), 2, 20)]
    stream = fed(spark, tmp_path, rows, EVENTS, 2, lambda r: r[1])
    got = flows.run_once(named.held_back(stream, processing_time=True), "named_live", wait_s=240).collect()
    want = wanted(rows)
    assert {(r.meeting_id, r.id, r.text) for r in got} <= {w[:3] for w in want}
    assert {(r.meeting_id, r.id) for r in got if r.id.startswith("system")} == {w[:2] for w in want if w[1].startswith("system")}


def test_silences(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for m in (1, 2):
        t = 0
        for k in range(40):
            t += rng.choice([100, 1000, 2500, 2600, 6000])
            rows.append((m, f"s-{k}", "sys:1", t, t + 800, rng.choice(["да", "да", " "]), True))
            t += 800
    schema = "meeting_id long, id string, speaker string, start_ms long, end_ms long, text string, is_final boolean"
    late = {r: r[4] + rng.randrange(2000) for r in rows}
    clock = (99, "x", "x", FAR, FAR, "x", True)
    stream = fed(spark, tmp_path, [*rows, clock], schema, 6, lambda r: late.get(r, FAR))
    got = flows.run_once(named.silences(stream), "silences", wait_s=240).filter("meeting_id < 99").collect()
    want = turns.unanswered(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.meeting_id, r.id) for r in got) == sorted((r.meeting_id, r.id) for r in want)
    assert all(r.fired_ms == r.end_ms + 2500 for r in got) and len(got) > 10


def test_debounced(spark, tmp_path):
    rng = random.Random(6)
    rows = [(m, at, rng.random() < 0.3) for m in (1, 2) for at in sorted(rng.sample(range(300_000), 40))]
    schema = "meeting_id long, at_ms long, skipped boolean"
    late = {r: r[1] + rng.randrange(900) for r in rows}
    stream = fed(spark, tmp_path, [*rows, (99, FAR, False)], schema, 5, lambda r: late.get(r, FAR))
    got = flows.run_once(named.debounced(stream), "debounced", wait_s=240).filter("meeting_id < 99").collect()
    batch = spark.createDataFrame(rows, schema).groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct(F.col("at_ms").alias("at"), "skipped"))).alias("a"))
    want = [(r.meeting_id, at) for r in batch.select("meeting_id", live.fired(F.col("a"), 20_000).alias("f")).collect() for at in r.f]
    assert sorted((r.meeting_id, r.at_ms) for r in got) == sorted(want)
