"""Two streams on one clock, the echo path and echo delays, against plain loops."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import delays, echo_path
from parley.streaming import alignment, flows

CHUNKS = "meeting_id long, source string, ts timestamp, samples array<float>"
START = datetime.datetime(2024, 5, 1, 9, 0, 0)


def at(samples):
    return START + datetime.timedelta(microseconds=samples * 62.5)


def recordings(rng, seconds):
    """Two meetings; the call stops, jumps and overlaps itself, the microphone loses a piece."""
    rows = []
    for m in (1, 2):
        for source, size in (("mic", 512), ("system", 320)):
            p = rng.randrange(0, 400, 2)
            while p < seconds * 16_000:
                rows.append((m, source, p, [float(rng.randrange(1, 9)) for _ in range(size)]))
                p += size
                if source == "system" and rng.random() < 0.1:
                    p += rng.choice([-100, 60, 2_000, 9_000])
                if source == "mic" and rng.random() < 0.03:
                    p += 1_000
    return rows


def brute_aligned(rows):
    samples = {}
    for m, source, p, values in sorted(rows, key=lambda r: r[2]):
        for i, v in enumerate(values):
            samples.setdefault((m, source), {}).setdefault(p + i, v)
    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp()) * 16_000
    out = {}
    for m in (1, 2):
        near, far = samples.get((m, "mic"), {}), samples.get((m, "system"), {})
        for g in {(p + base) // 160 for p in near}:
            here = range(g * 160 - base, g * 160 - base + 160)
            out[m, g] = ([near.get(p, 0.0) for p in here], [far.get(p, 0.0) for p in here], sum(p in near for p in here))
    return out


def got_aligned(rows):
    return {(r.meeting_id, r.frame): (r.samples, r.reference, r.n_real) for r in rows}


def test_frames_of_two_sources(spark):
    rows = recordings(random.Random(1), 2)
    odd = [(1, "other", START, [1.0]), (1, "mic", None, [1.0]), (2, "mic", START, []), (2, "mic", START, None)]
    chunks = spark.createDataFrame([(m, s, at(p), v) for m, s, p, v in rows] + odd, CHUNKS).repartition(4)
    found = alignment.aligned_chunks(chunks).collect()
    assert got_aligned(found) == brute_aligned(rows) and len(found) == len(got_aligned(found))
    assert alignment.aligned_chunks(chunks.filter("source = 'mic'")).filter(F.exists("reference", lambda x: x != 0)).count() == 0
    assert alignment.aligned_chunks(chunks.limit(0)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    """Arrivals are shuffled within 100 ms; the call lags by up to 100 ms and stops, and the microphone goes on."""
    rng = random.Random(7)
    rows = [r for r in recordings(rng, 3) if r[1] == "mic" or r[2] < 24_000]
    arrivals = sorted(rows, key=lambda r: r[2] + rng.randrange(1_600))
    end = max(r[2] for r in rows)
    later = [[(m, "mic", end + d, [1.0] * 512) for m in (1, 2)] for d in (30_000, 60_000)]  # moves the clock on; not compared
    size = 60
    for k, part in enumerate([arrivals[i : i + size] for i in range(0, len(arrivals), size)] + later):
        path = f"{tmp_path}/in/{k:03}"
        spark.createDataFrame([(m, s, at(p), v) for m, s, p, v in part], CHUNKS).coalesce(1).write.parquet(path)
        os.utime(path, (k, k))
    for d, _, names in os.walk(f"{tmp_path}/in"):
        for n in names:
            os.utime(f"{d}/{n}", (1_000_000 + int(os.path.basename(d) or 0), 1_000_000 + int(os.path.basename(d) or 0)))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = flows.run_once(alignment.aligned_chunks(stream), "aligned", wait_s=240).collect()
    want = brute_aligned(rows)
    got = got_aligned(found)
    assert len(got) == len(found)
    assert {k: v for k, v in got.items() if k in want} == want
    assert sum(any(v[1]) for v in got.values()) > 100


def test_outputs_go_back_to_their_inputs(spark):
    rng = np.random.default_rng(3)
    for latency in (0, 128, 160, 288):
        fed = [(1, k, g, f, n) for k, (g, f, n) in enumerate([(10, 40, 120), (11, 0, 160), (12, 0, 30), (40, 0, 160), (41, 0, 100)])]
        inputs = rng.normal(size=(len(fed), 160)).astype(np.float32)
        whole = np.concatenate([np.zeros(latency, np.float32), inputs.ravel(), np.zeros(2 * 160, np.float32)])
        outputs = [(1, k, whole[k * 160 : k * 160 + 160].tolist()) for k in range(len(whole) // 160)]
        got = alignment.restamped(
            spark.createDataFrame(fed, "m long, ordinal long, frame long, first int, n_real int"), spark.createDataFrame(outputs, "m long, ordinal long, samples array<float>"), ["m"], latency
        ).orderBy("ordinal").collect()
        assert [(r.position, r.samples) for r in got] == [(g * 160 + f, inputs[k, f : f + n].tolist()) for _, k, g, f, n in fed]


def brute_states(proofs, window, least, off_below, recent, on_above):
    seen, state, out = [], True, []
    for e in proofs:
        if e is not None:
            seen.append(e)
            last = seen[-window:]
            if state:
                state = not (len(last) >= least and sum(last) < off_below * len(last))
            else:
                state = sum(seen[-recent:]) >= on_above * recent
        out.append(state)
    return out


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
@pytest.mark.parametrize("rule", [(40, 10, 0.2, 8, 0.5), (10, 1, 0.9, 10, 0.1)])  # the second exchanges states
def test_echo_path_is_the_loop_for_every_block(spark, block, rule):
    rng = random.Random(9)
    rows, want = [], {}
    for m in (1, 2, None):
        proofs, p = [], 0.5
        for _ in range(400 if m == 1 else 60):
            p = rng.choice([0.02, 0.5, 0.95]) if rng.random() < 0.05 else p
            proofs.append(rng.choice([None, rng.random() < p]))
        frames = sorted(rng.sample(range(1000), len(proofs)))
        rows += [(m, f, e) for f, e in zip(frames, proofs)]
        want |= {(m, f): s for f, s in zip(frames, brute_states(proofs, *rule))}
    df = spark.createDataFrame(rows, "m long, frame long, e boolean").repartition(3)
    window, least, off_below, recent, on_above = rule
    found = echo_path.echo_paths(df, ["m"], "frame", F.col("e"), window, least, off_below, recent, on_above, block)
    got = {(r.m, r.frame): r.coupled for r in found.collect()}
    assert got == want and len(set(got.values())) == 2
    assert found.columns == ["m", "frame", "e", "coupled"]


def test_evidence(spark):
    rows = [(1e-3, 20e-6, 1e-6, 1e-6, True), (1e-3, 3e-6, 3e-6, 1e-6, False), (1e-5, 3e-6, 3e-6, 1e-6, None), (1e-3, 8e-6, 1e-6, 1e-6, None), (1e-3, 1e-9, 0.0, 1e-12, None), (1e-3, 1.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "far double, before double, after double, floor double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", echo_path.evidence(F.col("far"), F.col("before"), F.col("after"), F.col("floor"))).collect())


def levels(rng, n):
    return np.where(rng.random(n) < 0.6, rng.uniform(-45, -10, n), -75.0)


def echoed(far, lag_at):
    near = np.full(len(far), -75.0)
    for k in range(len(far)):
        lag = lag_at(k)
        if k >= lag:
            near[k] = max(-75.0, far[k - lag] - 12)
    return near


def brute_estimates(far, near, window=500, least=200, step=50, most=100):
    out = []
    for to in range(step, len(far) + 1, step):
        n = min(to, window, to - most)
        if n < least:
            continue
        history, y = far[max(0, to - window - most) : to], near[to - n : to]
        if 4 * (history > -55).sum() < n or y.var() < 1:
            continue
        scores = []
        for lag in range(most + 1):
            x = far[to - n - lag : to - lag]
            scores.append(((x - x.mean()) * (y - y.mean())).mean() / np.sqrt(x.var() * y.var()) if x.var() >= 1 else -np.inf)
        best = max(range(most + 1), key=lambda k: (scores[k], k))
        if scores[best] >= 0.4 and scores[best] - max(s for k, s in enumerate(scores) if abs(k - best) > 8) >= 0.08:
            out.append((to - 1, best))
    return out


def brute_confirmations(found):
    last, streak, confirmed, current, moved_at, out = None, 0, None, 0, None, []
    for frame, lag in found:
        streak = streak + 1 if last is not None and abs(last - lag) <= 3 else 1
        last = lag
        if streak >= 3 and (confirmed is None or abs(confirmed - lag) > 3):
            confirmed, ms, want = lag, lag * 10, None
            if ms >= current + 400:
                want = ms - 100
            elif current > 0 and ms < current + 30:
                want = max(0, ms - 250)
            moved = want is not None and want != current and (moved_at is None or frame >= moved_at + 500)
            if moved:
                current, moved_at = want, frame
            out.append((frame, ms, moved, current))
    return out


@pytest.mark.parametrize("name, lag_at", [("known", lambda k: 60), ("drifting", lambda k: 20 + k // 400), ("jumping", lambda k: 55 if k < 2500 else (5 if k < 2700 else 75)), ("none", lambda k: 10**9)])
@pytest.mark.parametrize("group", [50, 1000, 24_000])
def test_delays(spark, name, lag_at, group):
    rng = np.random.default_rng(len(name))
    far = levels(rng, 4000)
    near = np.maximum(echoed(far, lag_at), rng.uniform(-74, -60, 4000))
    frames = spark.createDataFrame([(1, k, float(f), float(n)) for k, (f, n) in enumerate(zip(far, near))] + [(None, k, None, -20.0) for k in range(900)], "m long, frame long, far_db double, near_db double").repartition(5)
    found = delays.estimates(frames, ["m"], group=group)
    rows = found.orderBy("frame").collect()
    assert [(r.frame, r.lag) for r in rows] == brute_estimates(far, near) and all(r.m == 1 for r in rows)
    sure = [(r.frame, r.delay_ms, r.realigned, r.reference_ms) for r in delays.confirmations(found, ["m"]).orderBy("frame").collect()]
    assert sure == brute_confirmations([(r.frame, r.lag) for r in rows])
    assert bool(sure) == (name != "none")
    if name == "known":
        assert sure == [(sure[0][0], 600, True, 500)]


def test_cooldown_and_wanted_delays(spark):
    assert delays.wanted_delay(399, 0) is None and delays.wanted_delay(400, 0) == 300
    assert delays.wanted_delay(329, 300) == 79 and delays.wanted_delay(330, 300) is None and delays.wanted_delay(10, 300) == 0
    lags = [*[60] * 3, *[10] * 3, *[60] * 3, *[11] * 14, *[16] * 3]
    found = spark.createDataFrame([(1, 50 * k, lag) for k, lag in enumerate(lags)], "m long, frame long, lag int")
    got = [(r.frame, r.delay_ms, r.realigned, r.reference_ms) for r in delays.confirmations(found, ["m"]).orderBy("frame").collect()]
    assert got == brute_confirmations([(50 * k, lag) for k, lag in enumerate(lags)])
    assert [g[2] for g in got] == [True, False, False, False, True]


def test_log_energy(spark):
    df = spark.createDataFrame([([0.0] * 160,), ([0.1] * 160,), ([],)], "s array<float>")
    assert [round(r[0], 3) for r in df.select(delays.log_energy(F.col("s"))).collect()] == [-75.0, -20.0, -75.0]
