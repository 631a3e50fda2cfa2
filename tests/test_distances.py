"""Bit-parallel edit distances against the full table."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from parley.functions import distances
from parley.operators import scoring


def full_table(a, b):
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    return cost


def brute_split(a, b, boundary):
    """The walk back over the whole table: pair or replace, else drop, else insert."""
    cost, errors, i, j = full_table(a, b), [0, 0], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            errors[i - 1 >= boundary] += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            errors[i - 1 >= boundary] += 1
            i -= 1
        else:
            errors[i >= boundary and boundary < len(a)] += 1
            j -= 1
    return tuple(errors)


@pytest.mark.parametrize("held", [1, 3, 64])
def test_distances_and_splits(monkeypatch, held):
    monkeypatch.setattr(distances, "HELD", held)
    rng = random.Random(held)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a = [rng.choice(letters) for _ in range(rng.randrange(0, 30))]
        b = [rng.choice(letters) for _ in range(rng.randrange(0, 30))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        assert distances.distance(a, b) == distances.distance(b, a) == full_table(a, b)[-1][-1]
        boundary = rng.randrange(0, len(a) + 2)
        assert distances.split_errors(a, b, boundary) == brute_split(a, b, boundary)


def test_many_different_words_and_long_texts():
    """No limit on different words; memory for a few columns, not for a table."""
    n = 20_000
    a = [f"w{k}" for k in range(n)]
    b = [x if k % 100 else "other" for k, x in enumerate(a)]
    tracemalloc.start()
    began = time.time()
    assert distances.distance(a, b) == n // 100
    assert distances.split_errors(a, b, n // 2) == (n // 200, n // 200)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and time.time() - began < 60
    tracemalloc.stop()


def test_columns(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), (["é", "漢字"], []), (None, ["a"]), ([], []), (["a"], None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(distances.word_distance(F.col("a"), F.col("b")).alias("w"), distances.word_and_letter_distances(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.w for r in got] == [2, 2, None, 0, None]
    assert [tuple(r.e) for r in got] == [(2, 3), (2, 4), (None, None), (0, 0), (None, None)]


def test_part_error_rates(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(60):
        ref = [rng.choice("abcde") for _ in range(rng.randrange(1, 20))]
        hyp = [x for x in ref if rng.random() < 0.8] + ["z"] * rng.randrange(2) if k % 7 else None
        boundary, langs = rng.randrange(0, len(ref) + 1), rng.choice([["ru", "kk"], ["kk", "ru"]])
        rows.append((ref, hyp, boundary, langs))
        for part, (words, errors) in enumerate(zip((boundary, len(ref) - boundary), brute_split(ref, hyp or [], boundary))):
            sums = want.setdefault((langs[part], part), [0, 0])
            sums[0] += words
            sums[1] += errors
    got = scoring.part_error_rates(spark.createDataFrame(rows, "ref array<string>, hyp array<string>, boundary int, langs array<string>")).collect()
    assert {(r.lang, r.position): [r.words, r.errors] for r in got} == want
