"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import periodic, queries


def brute_runs(w, exponent=4, least=6):
    """Every stretch whose words q apart are equal, for every q, less those that a shorter period explains."""
    n, found, seen = len(w), [], []
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            start = k
            while k + q < n and w[k] == w[k + q]:
                k += 1
            length = k - start + q
            if length >= 2 * q and not any(s <= start and start + length <= s + m and q % p == 0 for s, m, p in seen):
                seen.append((start, length, q))
                if length >= max(least, exponent * q):
                    found.append((start, length, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_kept(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def repeated(rng, n):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 9]))) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, q = rng.randrange(n), rng.randrange(1, n + 1)
        b = rng.randrange(a, n + 1)
        w[a:b] = [w[a + (i - a) % q] for i in range(a, b)]
    return w


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 1), (5, 20)])
def test_runs_of_random_words(exponent, least):
    rng = random.Random(exponent)
    for n in [*range(1, 40), *[90] * 200, 300, 500]:
        w = repeated(rng, n)
        assert periodic.Words([x.encode() for x in w]).runs(exponent, least) == brute_runs(w, exponent, least)


def test_words_decide_where_hashes_collide(monkeypatch):
    """With hashes that call everything equal, results stay the same."""
    rng = random.Random(5)
    monkeypatch.setattr(periodic.Words, "_equal", lambda self, i, j, length: True)
    for n in [60] * 100 + [200] * 20:
        w = repeated(rng, n)
        assert periodic.Words([x.encode() for x in w]).runs(4, 6) == brute_runs(w)


def test_long_texts_take_linear_time():
    one = [b"a"] * 300_000
    assert periodic.Words(one).runs(4, 6) == [(0, 300_000, 1)]
    again = [b"x", *(b"%d" % (i % 7001) for i in range(300_000)), b"y"]
    assert periodic.Words(again).runs(4, 6) == [(1, 300_000, 7001)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a
    assert periodic.Words(b).runs(4, 6) == []  # no repeat of a Fibonacci word reaches four periods


def test_few_periods_are_refused(spark):
    with pytest.raises(ValueError, match="three"):
        periodic.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), least_exponent=2)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "é " * 9, "a\x0bb\x0ca b a b", *(" ".join(repeated(rng, rng.randrange(1, 150))) for _ in range(80)), " x  y \n" * 400]
    rows = [(i * 7 - 20, t, "k", "r") for i, t in enumerate(texts)] + [(8, texts[9], "k", "r")] * 2 + [(None, texts[7], "k", "r")]
    spark.createDataFrame(rows, "doc_id long, text string, k0 string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        words = brute_planted(words, i) if i is not None else words
        runs = brute_runs(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_kept(words, runs))).hexdigest()))
    got = queries.op11_periodic(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.n_runs > 0 for r in got) > 10
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).count() == 0


def test_spans_and_texts_come_out(spark):
    docs = spark.createDataFrame([(1, "go " * 6 + "now"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 6, 1)] and got[1].collapsed == "go now"
    assert got[2].runs == [] and got[2].collapsed == "a b c" and got[2].n_words == 3
    assert periodic.periodic_runs(docs.withColumn("k0", F.lit(1)), keep=("doc_id", "k0")).columns == ["doc_id", "k0", "n_words", "runs", "collapsed"]
