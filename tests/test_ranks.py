"""Places, percentiles, blocks of centres and searches against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import ranks, regroup, scoring, usage


def skewed(rng, n=600):
    """A key with most rows, a value that a third of them have, nulls in both."""
    return [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([1.5, round(rng.uniform(-5, 5), 1), None]) if rng.random() < 0.9 else 1.5, k) for k in range(n)]


def test_percentiles(spark):
    rows = skewed(random.Random(1))
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(5)
    wanted = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    near = {r.k: r for r in ranks.percentiles(df, ["k"], "v", wanted).collect()}
    between = {r.k: r for r in ranks.percentiles(df, ["k"], "v", wanted, between=True).collect()}
    for key in ("hot", "cold", None):
        values = sorted(v for k, v, _ in rows if k == key and v is not None)
        assert [near[key][n] for n in wanted] == [values[math.floor((len(values) - 1) * q + 0.5)] for q in wanted.values()]
        assert [between[key][n] for n in wanted] == pytest.approx([float(np.quantile(values, q)) for q in wanted.values()])
    whole = ranks.percentiles(df, [], "v", {"m": 0.5}).collect()
    values = sorted(v for _, v, _ in rows if v is not None)
    assert [r.m for r in whole] == [values[math.floor((len(values) - 1) / 2 + 0.5)]]
    assert ranks.percentiles(df.limit(0), ["k"], "v", wanted).count() == 0


def test_places(spark):
    rows = [(k, n % 50, n) for k, _, n in skewed(random.Random(2))]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, "k string, o long, n long").repartition(5)
    got = ranks.placed(df, ["k"], ["o"]).collect()
    for key in ("hot", "cold", None):
        own = sorted((r.place, r.o) for r in got if r.k == key)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [o for _, o in own] == sorted(o for k, o, _ in rows if k == key)
    assert sorted((str(r.k), r.o, r.n) for r in got) == sorted((str(k), o, n) for k, o, n in rows)


def test_matched_subset_of_ties(spark):
    rows = [(m, "s", 0) for m, n in (("a", 40), ("b", 7)) for _ in range(n)] + [("a", "t", k) for k in range(5)] + [("b", "t", k) for k in range(9)]
    got = scoring.matched_subset(spark.createDataFrame(rows, "m string, s string, o long"), "m", "s", "o").groupBy("m", "s").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("o")).collect()
    assert sorted(map(tuple, got)) == [("a", "s", 7, 0), ("a", "t", 5, 4), ("b", "s", 7, 0), ("b", "t", 5, 4)]


@pytest.mark.parametrize("most", [4096, 3])
def test_nearest_centres_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(regroup, "MOST_CENTRES", most)
    monkeypatch.setattr(regroup, "BUCKET", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 6))
    u = rng.normal(size=(11, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u[10] = u[4]  # a tie
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(98, None), (99, [0.0] * 6)], "id long, v array<double>")
    centres = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(u)], "label int, u array<double>")
    got = {r.id: (r.nearest, r.similarity) for r in regroup.nearest_centres(rows, "id", "v", centres).collect()}
    scores = np.round(v @ u.T / np.linalg.norm(v, axis=1, keepdims=True), 9)
    assert {k: got[k][0] for k in range(40)} == {k: int(s.argmax()) for k, s in enumerate(scores)}
    assert all(got[k][1] == pytest.approx(scores[k].max(), abs=1e-9) for k in range(40))
    assert got[98][1] is None and got[99][1] is None and len(got) == 42


def test_staged_search(spark):
    rng = random.Random(3)
    rows = [(k, rng.uniform(0, 1)) for k in ("a", "b", None) for _ in range(30)]
    df = spark.createDataFrame(rows, "k string, x double")
    coarse, finer = [0.0, 0.25, 0.5, 0.75, 1.0], 4
    found = {r.k: (r.t, r.mean) for r in scoring.staged_search(df, ["k"], "t", coarse, finer, -F.pow(F.col("x") - F.col("t"), F.lit(2))).collect()}
    for key in ("a", "b", None):
        xs = [x for k, x in rows if k == key]
        mean = lambda t: sum(-((x - t) ** 2) for x in xs) / len(xs)
        best = max(coarse, key=lambda t: (mean(t), -t))
        fine = [round(best + j * 0.05, 9) for j in range(-finer, finer + 1)]
        want = max(fine, key=lambda t: (round(mean(t), 12), -t))
        assert found[key][0] == want and found[key][1] == pytest.approx(mean(want))


def test_small_tables_are_checked(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_CONFIGS", 2)
    items = spark.createDataFrame([(1, 0.5)], "k int, x double")
    grid = spark.createDataFrame([(float(k),) for k in range(3)], "t double")
    with pytest.raises(ValueError, match="2 configurations"):
        scoring.grid_search(items, grid, ["k"], F.col("x"))
    assert scoring.grid_search(items, grid.limit(0), ["k"], F.col("x") + F.col("t")).count() == 0
    monkeypatch.setattr(usage, "MOST_PRICES", 1)
    prices = spark.createDataFrame([("a", 1.0, 1.0, 1.0)] * 2, "pattern string, input_price double, read_price double, output_price double")
    with pytest.raises(ValueError, match="1 rows"):
        usage.priced(items, prices)
