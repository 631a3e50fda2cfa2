"""Delay estimates of groups: which reach Python, and odd rows against a plain loop over groups."""

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from parley.operators import delays

PARAMETERS = {"window": 60, "least": 30, "step": 20, "most_lag": 12, "group": 100}
REACH = PARAMETERS["window"] + PARAMETERS["most_lag"]


def brute(rows):
    """(frame, lag) of one meeting's (frame, far, near): each group ends at the last frame that it or its history has."""
    rows, out = [(f, -75.0 if a is None else max(a, -75.0), -75.0 if b is None else max(b, -75.0)) for f, a, b in rows if f is not None and f >= 0], []
    for part in range(max((f for f, _, _ in rows), default=0) // 100 + 2):
        begin, mine = max(0, part * 100 - REACH), [r for r in rows if r[0] // 100 <= part <= (r[0] + REACH) // 100]
        levels = np.full((2, part * 100 + 101 - begin), -75.0)
        for f, *both in mine:
            levels[:, f - begin] = np.maximum(levels[:, f - begin], both)
        for to in range(part * 100 + 20, min(max((f + 1 for f, _, _ in mine), default=0), part * 100 + 100) + 1, 20):
            n = min(to, 60, to - 12)
            far, near = levels[0, max(0, to - REACH) - begin : to - begin], levels[1, to - n - begin : to - begin]
            if n < 30 or 4 * (far > -55).sum() < n or near.var() < 1:
                continue
            x = [far[len(far) - n - lag : len(far) - lag] for lag in range(13)]
            scores = [((h - h.mean()) * (near - near.mean())).mean() / np.sqrt(h.var() * near.var()) if h.var() >= 1 else -np.inf for h in x]
            best = max(range(13), key=lambda k: (scores[k], k))
            if scores[best] >= 0.4 and scores[best] - max((s for k, s in enumerate(scores) if abs(k - best) > 8), default=-np.inf) >= 0.08:
                out.append((to - 1, best))
    return out


def meeting(rng, n, lag):
    far = np.where(rng.random(n) < 0.6, rng.uniform(-45, -10, n), -75.0)
    return [(k, float(far[k]), float(far[k - lag] - 12) if k >= lag else None) for k in range(n)]


def test_odd_meetings_equal_the_loop_over_groups(spark):
    rng = np.random.default_rng(5)
    at = lambda k: datetime.datetime(2024, 5, 1, 9, 0, k)
    gap = [r for r in meeting(rng, 700, 4) if r[0] < 130 or r[0] >= 520]  # groups with history only, and none at all
    twice = meeting(rng, 330, 7)
    twice += [(f, a + 1, None) for f, a, _ in twice[::3]]
    odd = [(None, -20.0, -20.0), (-5, -20.0, -20.0), *((f, None if f % 17 == 0 else a, b) for f, a, b in meeting(rng, 260, 2))]
    short, begun = meeting(rng, 61, 5), meeting(rng, 119, 5)
    given = {(at(1), "a"): gap, (at(2), "a"): twice, (None, "a"): odd, (at(1), None): short, (None, None): begun}
    df = spark.createDataFrame([(*k, *r) for k, rows in given.items() for r in rows], "at timestamp, of string, frame int, far_db double, near_db double").repartition(5)
    found = delays.estimates(df, ["at", "of"], **PARAMETERS)
    assert found.dtypes == [("at", "timestamp"), ("of", "string"), ("frame", "bigint"), ("lag", "int")]
    got = {k: [] for k in given}
    for r in sorted(found.collect(), key=lambda r: r.frame):
        got[r.at, r.of].append((r.frame, r.lag))
    assert got == {k: brute(rows) for k, rows in given.items()} and all(got.values())
    assert delays.estimates(df.limit(0), ["at", "of"], **PARAMETERS).count() == 0


def test_a_key_that_is_no_number_comes_back_as_null(spark):
    rows = [(float("nan"), *r) for r in meeting(np.random.default_rng(6), 100, 3)]
    found = delays.estimates(spark.createDataFrame(rows, "m double, frame long, far_db double, near_db double"), ["m"], **PARAMETERS).collect()
    assert found and all(r.m is None for r in found)


def test_groups_without_an_estimate_do_not_reach_python(spark):
    """Frames 28 to 59 or 66 are history of a second group that no meeting here has; the first ends before frame 59 in one of three."""
    frames = spark.range(3 * 67).select((F.col("id") % 3).alias("m"), F.floor(F.col("id") / 3).alias("frame"), F.lit(-20.0).alias("far_db"), F.lit(-20.0).alias("near_db"))
    found = delays.estimates(frames.filter("m <> 2 OR frame < 59"), ["m"], **PARAMETERS)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    while not re.match("FlatMapGroupsIn", plan.nodeName()):
        plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().head()
    while "Filter" not in plan.nodeName():
        plan = plan.children().head()
        assert "Window" not in plan.nodeName() and "Exchange" not in plan.nodeName()
    assert plan.metrics().apply("numOutputRows").value() == 2 * 67
