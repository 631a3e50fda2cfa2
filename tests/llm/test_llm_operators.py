"""The ten operators against brute force, and on nulls, empty, long and repeated rows, and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import ann, bpe, katz, langid, linededup, media, mixing, resampling, sharding, simhash
from parley.llm.common import fold_of

WORDS = "the of and to in ring tion hand than with from onion stone river light".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, size string, tokens string, copies int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er", "s", "al"]) + rng.choice(["", "", "", "x", "y"]) for _ in range(n))


def corpus():
    """Texts of all awkward kinds; the further columns have names that operators use themselves."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (1, 3, 4, 5, 30, 80, 200)]
    near = base[5].replace("the", "thee", 1)
    lined = "\n".join([base[4], base[5][:120], "short", "", base[4]])
    texts = [*base, None, "", " \n\t ", "12 34 !!", base[5], base[5], near, lined, base[4].upper(), prose(rng, 6000), "Ω ж 漢字 é x \x1c", "<|endoftext|> a's", base[6] + " " + "z" * 5000]
    rows = [(i, t, None if i % 5 == 4 else ("aa" if i % 2 else "bb"), None if i % 6 == 5 else f"s{min(i % 4, 2)}", 0, 1.0, 7, "q", "q", 3) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[0], "aa", None, 0, 1.0, 7, "q", "q", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# 1 SimHash


def brute_fingerprint(text):
    w = words_of(text)
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_of_awkward_rows(docs, empty):
    rows = sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f, rows[c].doc_id) for r, f, c in zip(rows, fps, brute_components(fps, 4))}
    got = simhash.near_duplicates(docs.filter("doc_id is not null")).collect()
    assert {(r.doc_id, r.fp[0] % (1 << 64), r.component_id) for r in got} == want and len(got) == len(rows)
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("node_rows", [4, 2048])
def test_trie_join_finds_what_brute_force_finds(spark, node_rows):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for c in centres for _ in range(20)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([([signed(x)], i) for i, x in enumerate(fps)], "node array<long>, known long")
    found = simhash.links(nodes, 1, 5, 12, np.full(65, 4), node_rows=node_rows).collect()
    assert all(((r.a[0] ^ r.b[0]) % (1 << 64)).bit_count() <= 4 for r in found)
    root = {r.node[0]: r.root[0] for r in simhash.components(spark.createDataFrame([(r.a, r.b) for r in found], "a array<long>, b array<long>")).collect()}
    mine = [root.get(signed(x), signed(x)) for x in fps]
    brute = brute_components(fps, 4)
    assert len({*zip(mine, brute)}) == len({*mine}) == len({*brute})


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """The smallest number of each text's group at a Jaccard similarity of 0.8 of five-word shingles."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_one_of_each_group_stays_as_by_brute_force(spark):
    """Near copies around the threshold, some of which link only through others."""
    rng = random.Random(3)
    texts = []
    for n in (12, 40, 150, 400):
        base = prose(rng, n).split()
        for k in range(14):
            copy = list(base)
            for _ in range(rng.randrange(1 + n // 25)):
                copy[rng.randrange(n)] = f"new{rng.randrange(9)}"
            texts.append(" ".join(copy))
    texts += [prose(rng, 100) for _ in range(20)] + ["", " ", texts[3].upper()]
    want = brute_groups(texts)
    assert 20 < len(set(want)) < len(texts) - 10
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = simhash.one_of_each(table)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_sets_of_rows_are_compared_exactly():
    rng = np.random.default_rng(5)
    base = rng.choice(4000, 60, replace=False)
    members = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 1 << 32, rng.integers(0, 12))])).astype(np.uint64) for _ in range(60)] + [np.empty(0, np.uint64)] * 2
    sets = simhash.Sets([simhash.packed_set(m) for m in members])
    i, j = np.triu_indices(len(members), 1)
    want = [len(a & b) >= 0.8 * len(a | b) for a, b in ((set(members[x].tolist()), set(members[y].tolist())) for x, y in zip(i, j))]
    assert sets.similar(i, j, 0.8).tolist() == want and 10 < sum(want) < len(want) - 10


def test_one_of_each_of_awkward_rows(docs, empty):
    kept = simhash.one_of_each(docs)
    rows = kept.collect()
    ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 5 in ids and not {11, 12, 13} & set(ids) and {1, 2, 3, 6} <= set(ids)
    assert [r.text for r in rows if r.doc_id is None] == [docs.filter("doc_id = 0").first().text] and 0 not in ids  # null comes first
    assert simhash.one_of_each(empty).count() == 0


def test_rows_without_own_ids_stay(spark):
    """Null and repeated ids: each different text keeps a row, and copies keep one; names may clash."""
    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(i, t, 1, 2, 3, 4) for i, t in [(None, a), (None, b), (None, b), (None, e), (4, c), (4, d), (4, d), (5, e), (6, "x y z"), (6, "x y z")]]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, place int, hash int, kept int, word int"))
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted([(0, a), (0, b), (0, e), (4, c), (4, d), (6, "x y z")])
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3, 4)}


# 2 sharding


def test_shards_hold_the_mixture(spark, docs, empty):
    rows = [(i, f"t{i}", None, "hot" if i % 3 == 0 else f"s{i % 7}", 0, 0.0, 0, "", "", 0) for i in range(700)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=24).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 700 and sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    per = got.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert ((per.max() - per.min()) <= 3).all()
    small = sharding.shard(docs, shards=24).toPandas()
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert sorted(zip(small["size"], small.text_crc32)) == sorted((len(t) + 8, zlib.crc32(t)) for t in texts)
    assert sharding.shard(empty).count() == 0


# 3 resampling


def test_resampling_prefers_the_target(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) if i % 2 else "junk " * 50, None, "s", 0, 0.0, 0, "", "", 0) for i in range(200)]
    table = spark.createDataFrame(rows, SCHEMA)
    good = spark.createDataFrame([(i,) for i in range(1, 60, 2)], "doc_id long")
    got = resampling.resample(table, good, 0.5).collect()
    assert len(got) == 100 and sum(r.doc_id % 2 for r in got) >= 99
    assert sorted(r["rank"] for r in got) == list(range(100))
    keys = [r.gumbel_key for r in sorted(got, key=lambda r: r["rank"])]
    assert keys == sorted(keys, reverse=True)
    flat = resampling.log_ratios(docs, resampling.fit(docs, good.filter("false"))).collect()
    assert len(flat) == docs.count() and all(abs(r.log_ratio) < 1e-3 for r in flat)
    assert resampling.resample(empty, good, 0.5).count() == 0


# 4 media


def test_media_round_trip(docs, empty):
    got = media.media(docs, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (r.text or "").encode()
        payload = media.from_wav(bytes(r.media))
        assert payload == raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ") and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.times) == len(r.codes) and r.times == sorted(r.times)
    for text in {r.text for r in got}:
        assert len({r.feature for r in got if r.text == text}) == 1
    assert media.media(empty).count() == 0


def test_blocks_do_not_change_peaks(monkeypatch):
    samples = np.random.default_rng(0).integers(0, 256, 192 * 60).astype(np.uint8)
    whole = media.peaks(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.peaks(samples)))


# 5 nearest neighbours


def test_nearest_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)] + [(1000, None, 0, 1), (1001, [], 0, 1), (1002, [0.0] * 16, 0, 1), (1003, [float("nan")] * 16, 0, 1), (1004, [None] * 16, 0, 1), (1005, [1.0] * 8, 0, 1), (7, x[7].tolist(), 0, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, q int")
    monkeypatch.setattr(ann, "ROW_BYTES", 90 * 16 * 8)
    monkeypatch.setattr(ann, "QUERY_BYTES", 10 * 16 * 8)
    got = ann.nearest(table, F.col("vec_id") % 5 == 0, k=10).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.score, r.vec_id))
    ids = np.array([*range(400), 7])
    wide = np.concatenate([x, x[7:8]]).astype(float)
    assert set(by) == set(range(0, 400, 5))
    for q in by:
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        want = sorted((s, int(i)) for s, i in zip(d, ids) if i != q)[:10]
        assert [i for _, i in by[q]] == [i for _, i in want] and np.allclose([s for s, _ in by[q]], [s for s, _ in want], rtol=1e-12)
    assert ann.nearest(table.filter("false"), F.lit(True)).count() == 0


# 6 language ID


def test_languages_and_spans(spark, docs, empty):
    rng = random.Random(2)
    make = {"aa": lambda n: " ".join(rng.choice(["lumo", "valu", "mulo", "lavum"]) for _ in range(n)), "bb": lambda n: " ".join(rng.choice(["krist", "strik", "trisk", "skirt"]) for _ in range(n)), "ru": lambda n: " ".join(rng.choice(["дом", "мода"]) for _ in range(n))}
    rows = [(i, make[k](20), k, "s", 0, 0.0, 0, "", "", 0) for i, k in enumerate(["aa", "bb", "ru"] * 20)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["aa", "bb", "ru"]
    mixed = spark.createDataFrame([(1, make["aa"](30) + " " + make["bb"](12), "x", "s", 0, 0.0, 0, "", "", 0), (2, "мода 1 дом", "x", "s", 0, 0.0, 0, "", "", 0), (3, "1 2 ?", "x", "s", 0, 0.0, 0, "", "", 0), (4, None, "x", "s", 0, 0.0, 0, "", "", 0)], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert [(s["first"], s["words"], s["lang"]) for s in got[1].spans] == [(0, 30, "aa"), (30, 12, "bb")]
    assert got[1].lang_pred == "aa" and 0.6 < got[1].score < 0.8
    assert (got[2].lang_pred, got[2].score) == ("ru", 1.0)
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (3, 4)] == [("und", 0.0, [])] * 2
    every = langid.identify(docs, langid.fit(docs), keep=tuple(docs.columns), prefix="_p_").collect()
    assert len(every) == docs.count() and all(r._p_lang_pred in ("aa", "bb", "und") and 0 <= r._p_score <= 1 for r in every)
    assert all(r.lang_pred == "und" for r in langid.identify(docs, langid.fit(empty)).collect())
    assert langid.identify(empty, model).count() == 0


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    starts = np.array([0, 6, 6, 9, 14])
    scores = rng.normal(size=(14, 3)).astype(np.float32)
    got = langid.viterbi(scores, starts, switch=1.0)

    def value(labels, part):
        return sum(part[i, k] for i, k in enumerate(labels)) - sum(a != b for a, b in zip(labels, labels[1:]))

    for a, b in zip(starts[:-1], starts[1:]):
        best = max(value(list(np.unravel_index(m, (3,) * (b - a))), scores[a:b]) for m in range(3 ** (b - a)))
        assert math.isclose(value(got[a:b], scores[a:b]), best, rel_tol=1e-6)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0)
    got = langid.identify(docs.filter("held_out"), langid.fit(docs.filter("not held_out")), keep=("lang",), with_spans=False)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# 7 mixing


def brute_exponent(tokens, budget, most_repeats):
    """The smallest exponent within the limit, on a fine grid and then between two of its points."""
    shares = [t / sum(tokens) for t in tokens if t]

    def worst(e):
        z = sum(s**e for s in shares)
        return max(s**e / z * budget / (s * sum(tokens)) for s in shares)

    if worst(0.0) <= most_repeats:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = (low, (low + high) / 2) if worst((low + high) / 2) <= most_repeats else ((low + high) / 2, high)
    return high


def test_mixture_against_brute_force(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), None, "hot" if i < 600 else f"s{i % 5}" if i % 7 else None, 0, 0.0, 0, "", "", 0) for i in range(1200)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plan = mixing.plan(table, most_repeats=1.25)
    got = mixing.with_copies(table, plan, name="_c", with_places=True).withColumn("t", mixing.token_count(F.col("text"))).toPandas()
    tokens = got.groupby("source", dropna=False).t.sum()
    total = int(tokens.sum())
    exponent = brute_exponent(tokens.tolist(), total, 1.25)
    assert math.isclose(plan.exponent, exponent, rel_tol=1e-9)
    z = sum((t / total) ** exponent for t in tokens)
    for source, g in got.groupby("source", dropna=False):
        weight = (g.t.sum() / total) ** exponent / z
        assert g._c_weight.map(lambda w: math.isclose(w, weight, rel_tol=1e-9)).all()
        goal = math.floor(weight * total + 1e-6)
        epochs, left = divmod(goal, int(g.t.sum()))
        extra = g[g._c == epochs + 1]
        assert set(g._c) <= {epochs, epochs + 1} and extra.t.sum() <= left
        rest = g[g._c == epochs]
        assert left - extra.t.sum() < (rest.t.max() if len(rest) else 1) or epochs == 0 and left == 0
        assert all(len(b) == c for b, c in zip(g._c_blocks, g._c))
    out = mixing.mix(table, most_repeats=1.25, with_places=True).collect()
    assert len(out) == got._c.sum() and collections.Counter(r.doc_id for r in out) == {i: c for i, c in zip(got.doc_id, got._c) if c}
    assert {(r.doc_id, r.epoch, r.block, r.place) for r in out} == {(i, e, b, p) for i, bs, p in zip(got.doc_id, got._c_blocks, got._c_place) for e, b in enumerate(bs)}
    for source in {r.source for r in out}:  # one order of blocks an epoch, each epoch its own
        first = {r.doc_id: r.block for r in out if r.source == source and r.epoch == 0}
        second = {r.doc_id: r.block for r in out if r.source == source and r.epoch == 1}
        same = collections.defaultdict(set)
        for i, b in second.items():
            same[first[i]].add(b)
        assert all(len(v) == 1 for v in same.values()) and not set(first.values()) & set(second.values())


def test_mixture_meets_an_entropy(spark, docs, empty):
    table = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 100), ("b", 10), ("c", 1), ("d", 0)])], "doc_id long, text string, source string")
    plan = mixing.plan(table, target_entropy=1.0)
    w = [r.weight for r in plan.sources.collect()]
    assert math.isclose(sum(w), 1.0, rel_tol=1e-9) and math.isclose(-sum(x * math.log(x) for x in w if x), 1.0, rel_tol=1e-9)
    assert {r.epochs for r in plan.sources.collect() if r.source == "d"} == {1}
    clash = docs.withColumns({"mixture source": F.lit(1), "mixture rows": F.lit(2), "epoch": F.lit(3), "copies_blocks": F.lit(4), "_source": F.lit(5)})
    out = mixing.mix(clash, most_repeats=1.25)
    assert out.columns == clash.columns and {tuple(r)[-5:] for r in out.collect()} == {(1, 2, 3, 4, 5)}
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty, most_repeats=1.25, with_places=True).count() == 0


# 8 Katz


def brute_katz(texts):
    """Counts of the words and ends of texts, and the probability of a word after another (None: at the start)."""
    count = collections.Counter(w for t in texts for w in [*words_of(t), b"\n"])
    n, v = sum(count.values()), len(count)
    pair = collections.Counter((a, b) for x in texts for t in [[None, *words_of(x), b"\n"]] for a, b in zip(t, t[1:]))
    history = collections.Counter()
    for (a, _), c in pair.items():
        history[a] += c
    d1, d2 = katz.discounts(collections.Counter(count.values())), katz.discounts(collections.Counter(pair.values()))
    cut = lambda d, c: d[c] * c if c <= katz.GT_MOST else c
    uni = katz.Unigrams.of(n, v, dict(collections.Counter(count.values())))
    p1 = lambda w: float(uni.p(np.array([count[w]]))[0])
    assert math.isclose(sum(p1(w) for w in count) + uni.unknown, 1.0, rel_tol=1e-9) and (d1 <= 1).all()
    follow = collections.defaultdict(dict)
    for (a, b), c in pair.items():
        follow[a][b] = c

    def after(a, b):
        seen = follow.get(a, {})
        kept = sum(cut(d2, c) for c in seen.values())
        total = history[a] + (kept > history[a] * (1 - 1e-9)) if seen else 1
        if b in seen:
            return cut(d2, seen[b]) / total
        return p1(b) * (1 - kept / total) / (1 - sum(p1(w) for w in seen))

    return count, after


def test_scores_against_brute_force(docs, empty):
    train = docs.filter("doc_id % 10 != 3")
    model, unigrams = katz.fit(train)
    got = {r.doc_id: r for r in katz.score(docs, model, unigrams).collect() if r.doc_id is not None}
    tokens = {r.doc_id: [*words_of(r.text), b"\n"] for r in docs.collect() if r.doc_id is not None}
    count, after = brute_katz([r.text for r in train.collect()])
    n, v = sum(count.values()), len(count)
    base = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    assert math.isclose(sum(after(WORDS[0].encode(), w) for w in [*count, b"?"]), 1.0, rel_tol=1e-9)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(map(base, t)), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(after(a, b)) for a, b in zip([None, *t], t)), rel_tol=1e-9)
    none, counts = katz.fit(empty)
    assert all(r.score == 0 and r.n_known == 0 for r in katz.score(docs, none, counts).collect())
    assert katz.score(empty, model, unigrams).count() == 0


def test_scores_with_few_kept_words(docs):
    model, unigrams = katz.fit(docs, min_share=0.01)
    whole, counts = katz.fit(docs)
    a = {r.doc_id: r for r in katz.score(docs, model, unigrams).collect()}
    b = {r.doc_id: r for r in katz.score(docs, whole, counts).collect()}
    assert len(model.words) < len(whole.words)
    assert all((a[i].n_known, a[i].n_tokens) == (b[i].n_known, b[i].n_tokens) and math.isclose(a[i].base_score, b[i].base_score, rel_tol=1e-9) for i in a)


def test_scores_do_not_depend_on_the_share(docs):
    """Every bigram counts, also those of words that are not broadcast."""
    train = docs.filter("doc_id % 10 != 3")
    whole = {r.doc_id: r for r in katz.score(docs, *katz.fit(train)).collect()}
    for share in (0.01, 1.0):
        got = {r.doc_id: r for r in katz.score(docs, *katz.fit(train, min_share=share)).collect()}
        assert got.keys() == whole.keys() and all(got[i].n_known == r.n_known and math.isclose(got[i].score, r.score, rel_tol=1e-9) for i, r in whole.items())


# 9 lines


def test_short_lines_in_query_and_pipeline(spark, tmp_path):
    """Lines of one to four different words go too, also long ones and text without blanks."""
    import corpus_pipeline
    from parley.llm import queries

    texts = ["Les.\nAnd ornd.\n\nalpha beta gamma delta", "les.\nand ornd.\n\nalpha beta gamma delta omega\nda da da da da da", "\u6f22\u5b57\u8cc7\u6599\nda\nalpha beta gamma", "\u6f22\u5b57\u8cc7\u6599\nornd. and\nalpha beta zeta\nLes"]
    table = spark.createDataFrame([(i, t, None, "s", 0, 0.0, 0, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(table.collect(), min_words=1)
    want = {(i, k) for i, _, k in want}
    assert want == {(1, 0), (1, 1), (1, 3), (2, 1), (3, 0), (3, 1)}
    got = queries.QUERIES["op9_lines"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, k) for r in got for k in r.removed} == want
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, table, str(tmp_path)).collect()}
    assert left == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t in enumerate(texts)}


def brute_lines(rows, min_words=1):
    """(id, text, line) of all lines that go; texts of one id are ordered by their hash."""
    seen, out = [], set()
    texts = {(-math.inf if r.doc_id is None else r.doc_id, signed(xxhash.xxh64_intdigest(r.text.encode(), 42)), r.text) for r in rows if r.text is not None}
    for i, _, text in sorted(texts, key=lambda x: x[:2]):
        for k, line in enumerate(text.encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if len(s) >= min_words:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                    out.add((None if i == -math.inf else i, text, k))
                seen.append(s)
    return out


def brute_cleaned(rows, **how):
    gone = brute_lines(rows, **how)
    return collections.Counter((r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, r.text, k) not in gone)) for r in rows)


def edited_lines(seed, documents):
    rng = random.Random(seed)
    pool = [prose(rng, n).split() for n in (3, 4, 5, 6, 9, 20, 40, 90) for _ in range(3)]

    def edited(line):
        line = list(line)
        for _ in range(rng.randrange(1 + len(line) // 8)):
            line[rng.randrange(len(line))] = rng.choice(WORDS) + str(rng.randrange(3))
        return " ".join(line)

    return ["\n".join(edited(rng.choice(pool)) for _ in range(8)) for _ in range(documents)]


def test_lines_against_brute_force(spark, docs, empty):
    rows = [(i, t, None, "s", 0, 0.0, 0, "", "", 0) for i, t in enumerate(edited_lines(9, 60))]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for how in ({"tries": 1}, {"tries": 0, "hot_lines": 3}, {"min_words": 5}):  # without tries all meet as whole sets; few lines make a word hot
        want = brute_cleaned(table.collect(), min_words=how.get("min_words", 1))
        got = linededup.dedup_lines(table, **how)
        assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want, how
    gone = brute_lines(table.collect())
    assert len(gone) > 100
    found = linededup.removals(table).collect()
    assert {(r.doc_id, k) for r in found for k in r.removed} == {(i, k) for i, _, k in gone} and all(r.n_lines == 8 for r in found)
    cleaned = linededup.dedup_lines(docs)
    assert cleaned.columns == docs.columns and collections.Counter((r.doc_id, r.text) for r in cleaned.collect()) == brute_cleaned(docs.collect())
    assert linededup.dedup_lines(empty).count() == 0 and linededup.removals(empty).count() == 0


def test_lines_of_rows_without_or_with_shared_ids(spark):
    texts = edited_lines(4, 24)
    rows = [(None if i % 3 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1, texts[2]), (5, None), (None, None), (None, "same line here\nof one"), (None, "same line here\nof two"), (7, "of seven\nsame line here"), (7, "same line here\nelse of seven")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_cleaned(table.collect())
    assert collections.Counter((r.doc_id, r.text) for r in linededup.dedup_lines(table).collect()) == want
    assert any(t == "of two" or t == "of one" for _, t in want) and any(t == "of seven" for _, t in want)


def test_lines_with_string_ids_and_clashing_names(spark):
    table = spark.createDataFrame([("a", "one line\nother", 42, 1, 2, 3, 4), ("b", "one line\nthird", 43, 1, 2, 3, 4), (None, "x y", 44, 1, 2, 3, 4)], "name string, text string, place int, hash int, lines int, _id int, mark int")
    got = linededup.dedup_lines(table, id_col="name")
    assert got.columns == table.columns
    rows = sorted(got.collect(), key=lambda r: r.place)
    assert [tuple(r)[2:] for r in rows] == [(42, 1, 2, 3, 4), (43, 1, 2, 3, 4), (44, 1, 2, 3, 4)]
    assert sorted(r.text for r in rows if r.name) in (["one line\nother", "third"], ["one line\nthird", "other"]) and rows[2].text == "x y"


# 10 BPE


def test_bpe_equals_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    for lexicon in (None, bpe.build_lexicon(docs, file, lexicon_words=40)):
        got = bpe.encode(docs, file, lexicon, keep=("doc_id", "text", "tokens")).collect()
        assert len(got) == docs.count()
        for r in got:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = bpe.encode(docs, file, with_text=False)
    both = bpe.decode(encoded, file).filter("sha2(decoded, 256) != decoded_sha256")
    assert both.count() == 0 and bpe.encode(empty, file, bpe.build_lexicon(empty, file)).count() == 0


def test_lexicon_shares_suffixes():
    words = {w: [i, i + 1] for i, w in enumerate(["sing", "ring", "string", "strings", "ri", "é"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words.items()))
    assert all(lexicon.find(w.encode()) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in (b"", b"s", b"rings", b"strin", b"x"))
    assert len(lexicon.first) - 1 < sum(len(w.encode()) for w in words)


@pytest.mark.parametrize("rows", [0, 3_000_000])
def test_blocks_follow_the_number_of_documents(spark, rows):
    """Wider blocks for more documents find the same groups; pairs of the least similarity are found but for half a percent."""
    words, blocks, width = shape = simhash.blocks_for(rows, 0.8)
    assert 64 * words >= blocks * width and (1 - (1 - simhash.differing(0.8)) ** width) ** blocks <= 0.005
    rng = random.Random(rows)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [*base, *(t + " and so on" for t in base[:6]), *(t.upper() for t in base[3:8])]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = simhash.one_of_each(table, shape=shape).collect()
    group = brute_groups(texts)
    assert sorted(r.doc_id for r in kept) == sorted({min(i for i, g in enumerate(group) if g == x) for x in set(group)})
