"""Regrouping by joins against the kernel on one stream at a time."""

import numpy as np
import pytest

from parley.operators import clustering, regroup

ITEM = "meeting_id long, prefix string, segment_id string, pos long, embedding array<double>, duration_ms long, online_label string"


def tilted(rng, k, cosine, size=16):
    v = np.zeros(size)
    v[k] = cosine
    other = rng.normal(size=size)
    other[k] = 0
    return v + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def stream(rng, m, prefix, n, voices):
    rows = []
    for i in range(n):
        k = int(rng.integers(voices))
        e = tilted(rng, k, rng.choice([0.97, 0.9, 0.75])).tolist()
        kind = rng.random()
        if kind < 0.05:
            e = None
        elif kind < 0.08:
            e = [0.0] * 16
        elif kind < 0.1:
            e = [1.0, 0.0]
        label = None if rng.random() < 0.2 else f"{prefix}:{(k if rng.random() < 0.7 else int(rng.integers(voices))) + 1}"
        rows.append((m, prefix, f"{prefix}-{i}", i, e, int(rng.choice([300, 1500, 4000, 9000])), label))
    return rows


def by_kernel(rows, knobs=clustering.Knobs(), voice=None):
    out = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[3])
        new = clustering.recluster([r[4] for r in own], np.array([r[5] for r in own]), [r[6] for r in own], key[1], knobs, voice)
        out |= {(*key, r[2]): x for r, x in zip(own, new)}
    return out


def by_joins(spark, rows, knobs=clustering.Knobs(), voiceprints=None):
    found = regroup.regrouped(spark.createDataFrame(rows, ITEM).repartition(3), knobs, voiceprints)
    return {(r.meeting_id, r.prefix, r.segment_id): r.speaker for r in found.collect()}


@pytest.mark.parametrize("bucket", [5, 4096])
def test_streams_equal_the_kernel(spark, monkeypatch, bucket):
    monkeypatch.setattr(regroup, "BUCKET", bucket)
    rng = np.random.default_rng(7)
    rows = stream(rng, 1, "mic", 60, 4) + stream(rng, 1, "sys", 90, 6) + stream(rng, 2, "sys", 25, 2) + stream(rng, 3, "mic", 1, 1)
    rows += [(4, "mic", "mic-0", 0, None, 900, "mic:3"), (4, "mic", "mic-1", 1, [], 900, None)]
    rows += [(5, "mic", f"mic-{i}", i, tilted(rng, i % 2, 0.95).tolist(), 4000, None) for i in range(8)]
    assert by_joins(spark, rows) == by_kernel(rows)


def test_steps_that_streams_rarely_take(spark):
    """Splits, moves, absorbed clusters, limits on items and speakers, names by total overlap."""
    rng = np.random.default_rng(2)
    a, b, c, d = (tilted(rng, k, 0.99).tolist() for k in range(4))
    near = (0.6 * np.array(a) + 0.8 * np.array(b)).tolist()
    rows = [(1, "mic", f"s{i}", i, e, ms, label) for i, (e, ms, label) in enumerate([(a, 9000, "mic:1"), (b, 9000, "mic:1"), (a, 9000, "mic:1"), (b, 9000, "mic:1"), (c, 9000, "mic:2"), (a, 4000, "mic:2"), (d, 800, "mic:3"), (near, 800, "mic:4")])]
    rows += [(2, "sys", f"s{i}", i, e, 8000, label) for i, (e, label) in enumerate(zip([a, b, a, b, b], ["sys:7", "sys:3", "sys:7", "sys:3", "sys:3"]))]
    rows += [(3, "sys", f"s{i}", i, e, 8000, None) for i, e in enumerate([a, b, c, d, a, b])]
    for knobs in (clustering.Knobs(), clustering.Knobs(most_items=2), clustering.Knobs(most_speakers=2), clustering.Knobs(absorb=-1.0, move=0.0)):
        assert by_joins(spark, rows, knobs) == by_kernel(rows, knobs)
    got = by_joins(spark, rows)
    assert len({got[1, "mic", f"s{i}"] for i in (0, 1)}) == 2 and [got[2, "sys", f"s{i}"] for i in range(5)] == ["sys:7", "sys:3", "sys:7", "sys:3", "sys:3"]


def test_the_user_is_named_by_voice(spark):
    rng = np.random.default_rng(4)
    rows = stream(rng, 1, "mic", 30, 3)
    voice = tilted(rng, 1, 0.98).tolist()
    prints = spark.createDataFrame([(1, "mic", voice)], "meeting_id long, prefix string, voiceprint array<double>")
    got = by_joins(spark, rows, voiceprints=prints)
    assert got == by_kernel(rows, voice=voice) and "me" in got.values()


def test_changes_only_and_empty(spark):
    rng = np.random.default_rng(9)
    rows = stream(rng, 1, "sys", 40, 3)
    items = spark.createDataFrame(rows, ITEM)
    changed = {r.segment_id: r.speaker for r in regroup.relabelled(items).collect()}
    want = by_kernel(rows)
    assert changed == {r[2]: want[1, "sys", r[2]] for r in rows if want[1, "sys", r[2]] != r[6]} and changed
    assert regroup.regrouped(items.limit(0)).count() == 0
