"""Every query of the subpackage on a small folder, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_exponent, brute_fingerprint, brute_groups, brute_katz, brute_lines, prose, words_of

from parley.llm import langid, media, queries, resampling

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, tokens string, copies int"


def texts_and_langs():
    rng = random.Random(11)
    base = [prose(rng, n) for n in (1, 2, 4, 9, 40, 120, 300)]
    near = [base[5].replace("the", "thee", 2), base[6] + " end", base[4].upper()]
    lined = ["\n".join([base[4], base[5][:200], "short", "", base[4]]), "short\nSHORT\n" + base[3]]
    odd = [None, "", " \n ", "12 !!", "Ω ж 漢字 é", "дом мода дом"]
    return [(t, None if k % 4 == 3 else "ab"[k % 2] * 2) for k, t in enumerate([*base, *near, *lined, *odd, base[6], base[6], *(prose(rng, 50) for _ in range(12))])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, None if i % 9 == 8 else f"s{min(i % 5, 2)}", 0, "x", 3) for i, (t, lang) in enumerate(texts_and_langs())]
    rows += [rows[4], (None, rows[5][1], "aa", "s0", 0, "x", 3), (None, None, None, None, 0, "x", 3)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=4).round(1).tolist(), 0) for i in range(250)] + [(1000, None, 0), (1100, [0.0] * 4, 0), (1200, [1.0, float("nan"), 0.0, 0.0], 0), (1300, [1.0, None, 0.0, 0.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_op1(spark, folder, docs):
    rows = [r for r in docs if r.doc_id is not None]
    rows.sort(key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in rows]
    group = brute_components(fps, 4)
    want = collections.Counter((r.doc_id, f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, group))
    got = run(spark, folder, "op1_simhash")
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want and len(got) == len(docs)


def test_op2(spark, folder, docs):
    """Rows in seeded order within their source get the place (k + 1/2) / rows; all places are sorted and cut."""
    seeds = {r.doc_id: r.h for r in spark.createDataFrame([(r.doc_id,) for r in docs], "doc_id long").select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    raw = lambda r: (r.text or "").encode()
    null = lambda x: (x is not None, x if x is not None else 0)
    order = lambda r: (seeds[r.doc_id], null(r.doc_id), zlib.crc32(raw(r)), len(raw(r)))
    of = collections.defaultdict(list)
    for r in docs:
        of[r.source].append(r)
    placed = sorted(((k + 0.5) / len(rows), *order(r)) for rows in of.values() for k, r in enumerate(sorted(rows, key=order)))
    want = [(p * 24 // len(docs), x[2][1] if x[2][0] else None, x[3], x[4] + 8) for p, x in enumerate(placed)]
    got = run(spark, folder, "op2_shards")
    assert collections.Counter((r.shard, r.doc_id, r.text_crc32, r["size"]) for r in got) == collections.Counter(want)
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(docs) // 24, len(docs) // 24 + 1)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op3(spark, folder, docs):
    """Word and pair frequencies of the good documents over all, summed a document, with the Gumbel key of its id."""
    import pyarrow as pa

    grams = {r: resampling.grams(pa.array([r.text], pa.string()))[1] for r in set(docs)}
    good = {i for i in range(20) if i % 3 > 0 and i % 7}
    raw, target = collections.Counter(), collections.Counter()
    for r in docs:
        raw.update(grams[r].tolist())
        target.update(grams[r].tolist() if r.doc_id in good else [])
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: (target[b] + resampling.PRIOR) / (n * scale + resampling.PRIOR) for b, n in raw.items()}
    norm = sum(raw.values()) / sum(n * ratio[b] for b, n in raw.items())
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(r.doc_id,) for r in docs], "doc_id long").select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    scored = []
    for r in docs:
        score = sum(math.log(ratio[b] * norm) for b in grams[r].tolist())
        scored.append((score - math.log(-math.log(hashes[r.doc_id] / 2.0**64 + 0.5)), r.doc_id, score))
    scored.sort(key=lambda x: -x[0])
    want = scored[: round(len(good) / 20 * len(docs))]
    got = sorted(run(spark, folder, "op3_resample"), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(len(want))) and np.allclose([r.gumbel_key for r in got], [x[0] for x in want], atol=2e-3)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(x[1] for x in want)


def test_op4(spark, folder, docs):
    """Peaks by plain Fourier sums of each frame, cell by cell."""

    def feature(payload):
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        n = len(x) // 96 - 1
        k = np.arange(192)
        wave = np.exp(-2j * np.pi * np.outer(k, np.arange(97)) / 192)
        m = np.array([np.abs((x[96 * t : 96 * t + 192] * (0.5 - 0.5 * np.cos(2 * np.pi * k / 192))) @ wave) for t in range(n)])
        peaks = [(t, f) for t in range(n) for f in range(97) if m[t, f] > 2 * m[t].mean() and m[t, f] >= m[max(t - 1, 0) : t + 2, max(f - 4, 0) : f + 5].max()]
        return sorted((a, (f << 14) | (g << 6) | (b - a)) for i, (a, f) in enumerate(peaks) for b, g in peaks[i + 1 : i + 4] if b - a <= 32)

    got = run(spark, folder, "op4_media")
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in docs)
    by_sha, pairs, same = {hashlib.sha256(media.padded((r.text or "").encode())).hexdigest(): r.text for r in docs}, 0, 0
    for r in got:
        raw = (by_sha[r.payload_sha256] or "").encode()
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:])) and r.media_bytes == len(media.to_wav(payload))
        want = feature(payload)
        mine = list(zip(r.times, r.codes))
        assert mine == sorted(mine) and r.feature.startswith(f"{len(mine)}:")
        pairs, same = pairs + len(want), same + len(set(want) & set(mine))
    assert same >= 0.995 * pairs > 100  # equal neighbours may differ in the last bits of single precision


def test_op5(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op5_nearest"]).fetchall()
    got = run(spark, folder, "op5_nearest")
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == {(q, k, v, round(s, 9)) for q, k, v, s in want} and len(got) == len(want)


def best_language(model, text):
    """Language, score and spans by each language's best path so far: the share of letters in words that it gives the commonest one."""
    words = langid.words_of(text)
    scores, letters = model.scores(words)
    value, paths = [0.0] * len(model.languages), [()] * len(model.languages)
    for t, s in enumerate(scores):
        top = max(range(len(value)), key=lambda j: (value[j], -j))
        change = value[top] - (langid.SWITCH if t else 0.0)
        paths = [(paths[k] if value[k] >= change else paths[top]) + (k,) for k in range(len(value))]
        value = [max(value[k], change) + float(s[k]) for k in range(len(value))]
    path = paths[max(range(len(value)), key=lambda j: (value[j], -j))]
    share = np.bincount(path, letters, len(model.languages)) if len(words) else np.zeros(len(model.languages))
    if not share.sum():
        return "und", 0.0, []
    spans = []
    for t, k in enumerate(path):
        if spans and spans[-1][2] == model.languages[k]:
            spans[-1][1] += 1
        else:
            spans.append([t, 1, model.languages[k]])
    return model.languages[int(share.argmax())], share.max() / share.sum(), [tuple(s) for s in spans]


def test_op6(spark, folder, docs):
    """Every text's spans, and the language that most of its letters are in."""
    got = run(spark, folder, "op6_langid")
    assert len(got) == len(docs) and all(r.held_out == (r.doc_id is not None and crc(r.doc_id, 5) == 0) for r in got)
    train = [r for r in docs if r.doc_id is not None and crc(r.doc_id, 5)]
    model = langid.fit(spark.createDataFrame(train, DOCUMENTS))
    assert set(model.languages) == {r.lang for r in train if r.lang and r.text is not None}
    want, found = collections.defaultdict(list), collections.defaultdict(list)
    for r in docs:
        want[r.doc_id].append(best_language(model, r.text))
    for r in got:
        found[r.doc_id].append((r.lang_pred, r.score, [tuple(x) for x in r.spans]))
    for i, values in want.items():
        mine = sorted(found[i], key=lambda x: (x[0], x[2]))
        values = sorted(values, key=lambda x: (x[0], x[2]))
        assert [(x[0], x[2]) for x in mine] == [(x[0], x[2]) for x in values] and np.allclose([x[1] for x in mine], [x[1] for x in values])
    assert any(x[2] for xs in want.values() for x in xs)


def brute_copies(spark, docs, most_repeats, seed=42):
    """(id, text, source) -> (copies, blocks, place) of the mixture, source by source."""
    tokens = collections.Counter()
    for r in docs:
        tokens[r.source] += len(words_of(r.text))
    total = sum(tokens.values())
    exponent = brute_exponent(list(tokens.values()), total, most_repeats)
    z = sum((t / total) ** exponent for t in tokens.values() if t)
    out = {}
    for source, t in tokens.items():
        own = [r for r in docs if r.source == source]
        n = math.ceil(math.sqrt(len(own)))
        goal = math.floor((t / total) ** exponent / z * total + 1e-6)
        epochs, left = divmod(goal, t) if t else (1, 0)
        frame = spark.createDataFrame([(r.doc_id, r.text, source, len(words_of(r.text))) for r in own], "id long, text string, source string, tokens int")
        mark = F.when(F.col("id").isNull(), F.xxhash64("text"))
        frame = frame.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "id", mark), F.lit(n).cast("long"))).withColumn("place", F.xxhash64(F.lit(seed + 2), "id", mark))
        orders = [F.xxhash64(F.lit(seed + 1), F.lit(e).cast("long"), "source", "b").alias(f"e{e}") for e in range(epochs + 1)]
        rows = frame.select("*", *orders).collect()
        key = lambda r: (r.place, r.id is not None, r.id or 0)
        used, more = 0, set()
        for block in sorted({r[f"e{epochs}"] for r in rows}):
            inside = sorted((r for r in rows if r[f"e{epochs}"] == block), key=key)
            if used + sum(r.tokens for r in inside) <= left:
                used += sum(r.tokens for r in inside)
                more |= {(r.id, r.text) for r in inside}
                continue
            for k in sorted({key(r) for r in inside}):
                same = [r for r in inside if key(r) == k]
                if used + sum(r.tokens for r in same) > left:
                    break
                used += sum(r.tokens for r in same)
                more |= {(r.id, r.text) for r in same}
            break
        else:
            more = set() if not left else more
        for r in rows:
            copies = epochs + ((r.id, r.text) in more)
            out[r.id, r.text, source] = copies, [r[f"e{e}"] for e in range(copies)], r.place
    return out


def test_op7(spark, folder, docs):
    got = run(spark, folder, "op7_mixing")
    tokens = collections.Counter()
    for r in docs:
        tokens[r.source] += len(words_of(r.text))
    total = sum(tokens.values())
    exponent = brute_exponent(list(tokens.values()), total, 1.25)
    z = sum((t / total) ** exponent for t in tokens.values() if t)
    assert len(got) == len(docs) and all(math.isclose(r.weight, (tokens[r.source] / total) ** exponent / z, rel_tol=1e-6) for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(words_of(r.text)) for r in docs) and all(len(r.blocks) == r.copies for r in got)
    for source, t in tokens.items():
        goal = math.floor((t / total) ** exponent / z * total + 1e-6)
        mixed = sum(r.copies * r.n_tokens for r in got if r.source == source)
        longest = max(r.n_tokens for r in got if r.source == source)
        assert goal - longest <= mixed <= goal
    want = brute_copies(spark, docs, 1.25)
    assert sorted((str(r.doc_id), r.copies, r.blocks, r.place) for r in got) == sorted((str(r.doc_id), *want[r.doc_id, r.text, r.source]) for r in docs)


def test_op8(spark, folder, docs):
    got = run(spark, folder, "op8_katz")
    count, after = brute_katz([r.text for r in docs if r.doc_id is not None and crc(r.doc_id, 10)])
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    texts = collections.defaultdict(list)
    for r in docs:
        texts[r.doc_id].append([*words_of(r.text), b"\n"])
    for i, own in texts.items():
        rows = [r for r in got if r.doc_id == i]
        want = sorted((len(t), sum(count[w] > 0 for w in t), round(base(t), 6)) for t in own)
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
        assert all(r.train_tokens == n and r.held_out == (i is not None and crc(i, 10) == 0) for r in rows)
        assert np.allclose(sorted(r.score for r in rows), sorted(sum(math.log10(after(a, b)) for a, b in zip([None, *t], t)) for t in own))


def test_op9(spark, folder, docs):
    gone = collections.Counter((i, k) for i, _, k in brute_lines(docs))
    times = collections.Counter((r.doc_id, r.text) for r in docs)
    want = collections.Counter()
    for i, text, k in brute_lines(docs):
        want[i, k] += times[i, text]
    got = run(spark, folder, "op9_lines")
    assert collections.Counter((r.doc_id, k) for r in got for k in r.removed) == want and gone
    assert sorted(r.n_lines for r in got) == sorted((r.text.count("\n") + 1) if r.text is not None else 0 for r in docs) and all(r.n_removed == len(r.removed) for r in got)


def test_op10(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op10_bpe")) == want


def test_stages_of_the_pipeline(spark, folder, docs):
    """Stage by stage on rows with nulls, repeated rows, shared ids and clashing names; then all, and an empty table."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    frame = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"place": F.lit(1), "hash": F.lit(2), "lines": F.lit(3), "found lang_pred": F.lit(4), "kept": F.lit(5), "_source": F.lit(6), "epoch": F.lit(7)})
    names = frame.columns
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id, r.text)
    spoken = stages["language ID"](spark, frame, folder).cache()
    model = langid.fit(frame)
    told = {r.text: best_language(model, r.text) for r in docs}
    assert collections.Counter(map(key, spoken.collect())) == collections.Counter(key(r) for r in docs if told[r.text][0] != "und" and told[r.text][1] >= corpus_pipeline.LEAST_LANGUAGE_SHARE)
    assert spoken.columns == names and {tuple(r)[-7:] for r in spoken.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    cleaned = stages["line dedup"](spark, frame, folder).cache()
    gone = brute_lines(docs)
    want = collections.Counter((r.doc_id, r.text if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, r.text, k) not in gone)) for r in docs)
    assert cleaned.columns == names and collections.Counter(map(key, cleaned.collect())) == want
    rows = sorted({key(r) for r in docs}, key=lambda x: (x[0] is not None, x[0] or 0))
    single = stages["SimHash near-dedup"](spark, frame, folder).collect()
    group = brute_groups([t or "" for _, t in rows])
    assert len(single) == len(set(group)) and len({group[rows.index(key(r))] for r in single}) == len(single)
    mixture = stages["mixing"](spark, frame, folder)
    copies = brute_copies(spark, docs, corpus_pipeline.MOST_REPEATS)
    want = collections.Counter()
    for r in docs:
        want[key(r)] += copies[r.doc_id, r.text, r.source][0]
    assert mixture.columns == names and collections.Counter(map(key, mixture.collect())) == +want
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = collections.Counter((r.doc_id, r.source, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs)
    assert collections.Counter((r.doc_id, r.source, tuple(r.ids)) for r in stages["BPE encoding"](spark, frame, folder).collect()) == ids
    none = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "BPE encoding" or out.columns == names)
    ids = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
    assert ids and set(ids) <= {r.doc_id for r in docs}
