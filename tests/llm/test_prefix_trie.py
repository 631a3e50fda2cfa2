"""The prefix trie and values that run along keys, against brute force."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import common, prefix_trie, queries

MASK = (1 << 64) - 1


def brute_trie(paths):
    """``paths``: conversation -> tuple of (role, text)."""
    members = collections.defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    name = {p: (m[0], len(p)) for p, m in members.items()}
    children = collections.Counter(p[:-1] for p in members if p)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    leaves, tokens = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            tokens[p[:d]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        out.append((*name[p], name[p[:-1]][0] if p else None, len(m), children[p], leaves[p], tokens[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    return {c: tuple(own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + ts[h:]) for c, ts in own.items()}


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def table_of(spark, paths):
    rows = [(c, k, role, text) for c, path in paths.items() for k, (role, text) in enumerate(path)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame([(c,) for c in paths], "conv_id long")


def shapes():
    rng = random.Random(2)
    turn = lambda: (rng.choice("ua"), rng.choice(["", "x", "é", "long " * 9]))
    yield "random", {c: tuple(turn() for _ in range(rng.randrange(9))) for c in rng.sample(range(-50, 500), 150)}
    long = tuple(turn() for _ in range(300))
    yield "snapshots", {c: long[: 3 * c] for c in range(100)}
    yield "copies", {c: long[:4] if c % 3 else long[:2] + (("u", str(c)),) for c in range(120)}
    yield "comb", {c: long[:c] + (("u", "away"),) for c in range(60)}
    yield "turnless", {4: (), 9: ()}


@pytest.mark.parametrize("name, paths", list(shapes()))
def test_tries(spark, name, paths):
    turns, conversations = table_of(spark, paths)
    assert result(prefix_trie.prefix_trie(turns, conversations)) == brute_trie(paths)


def test_query_and_cases(spark, tmp_path):
    rng = random.Random(4)
    first = [("user", f"hello {k}") for k in range(9)]
    rows = [(c, t, *(first[t] if rng.random() < 0.7 else ("assistant", rng.choice(["ok", None, "é"])))) for c in rng.sample(range(200), 90) for t in range(rng.randrange(1, 9))]
    rows += [(3, None, None, "null first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 1, "user", "nobody's"), (7, 1, None, None)]
    rows += [(1000, t, "user", f"t{t}") for t in range(150)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, x int")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(queries.op12_trie(spark, str(tmp_path))) == brute_trie(brute_rebuilt(rows))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_equal_hashes_raise(spark):
    turns, _ = table_of(spark, {1: (("u", "a"),), 2: (("u", "b"),)})
    members = prefix_trie.memberships(turns, None, "conv_id", "turn", "role", "text")
    same = members.withColumns({"x": F.lit(1).cast("long") * F.col("depth"), "y": F.col("depth")})
    with pytest.raises(Exception, match="same hashes"):
        prefix_trie.nodes_of(same)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_values_run_over_partitions(spark, batch):
    """One key holds most rows, so it goes on over partitions and batches."""
    rng = random.Random(batch)
    rows = [(rng.choice([1, 5, 5, 5, 5, 9]), 0, k, rng.randrange(-(1 << 62), 1 << 62), rng.choice([None, None, rng.randrange(100)])) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, g2 long, k long, v long, w long").repartition(4)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(setting)
    spark.conf.set(setting, batch)
    try:
        got = common.runs_within(df, ["g", "g2"], ["k"], {"s": ("sum", "k"), "p": ("poly", "v"), "l": ("last", "w")}, {"p0": "p", "l0": "l", "s0": "s"}).collect()
    finally:
        spark.conf.set(setting, old)
    want, state = {}, {}
    for g, _, k, v, w in sorted(rows, key=lambda r: (r[0], r[2])):
        n, s, p, last = state.get(g, (0, 0, 0, None))
        state[g] = (n + 1, s + k, (p * common._BASE + v) & MASK, last if w is None else w)
        want[k] = (*state[g], p, last, s)
    assert {r.k: (r.count_, r.s, r.p & MASK, r.l, r.p0 & MASK, r.l0, r.s0) for r in got} == want


def test_digests_of_many_blocks(spark):
    rows = [(k % 3, k) for k in range(5000)]
    got = prefix_trie.digests_of(spark.createDataFrame(rows, "key long, v long").repartition(7), ["key"], "v").collect()
    assert {r.key: r.digest for r in got} == {g: hashlib.sha256(",".join(str(k) for k in range(5000) if k % 3 == g).encode()).hexdigest() for g in range(3)}
