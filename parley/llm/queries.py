"""Queries of this subpackage for the driver: one ``opN_<name>`` per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 4 differing bits or fewer."""
    from parley.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    from parley.llm import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents sampled by quality; as many as there are good ones by share of the labels."""
    from parley.llm import resampling

    labels = table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0")
    share = good.count() / max(labels.count(), 1)
    return resampling.resample(table(spark, sf_dir, "documents"), good.select("doc_id"), share)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as WAV payloads, as digests, with their spectral-peak pairs as time-coded arrays."""
    from parley.llm import media

    return media.media(table(spark, sf_dir, "documents"), with_media=False)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose id is divisible by 100."""
    from parley.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents and the spans of their words in each; four fifths by id are learned from."""
    from parley.llm import langid
    from parley.llm.common import fold_of

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = langid.fit(docs.filter(~F.coalesce("held_out", F.lit(True))))
    found = langid.identify(docs, model, keep=("doc_id", "held_out"))
    return found.withColumn("held_out", F.coalesce("held_out", F.lit(False)))  # rows without id are neither held out nor learned from


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the mixture, at no more than 1.25 repeats of a source, and where in its source's order."""
    from parley.llm import mixing

    docs = table(spark, sf_dir, "documents")
    counted = mixing.with_copies(docs, mixing.plan(docs, most_repeats=1.25), with_places=True)
    return counted.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), "copies", F.col("copies_weight").alias("weight"), F.col("copies_blocks").alias("blocks"), F.col("copies_place").alias("place"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of all documents; nine tenths by id are learned from."""
    from parley.llm import katz
    from parley.llm.common import fold_of

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of(F.col("doc_id"), 10) == 0).alias("held_out"))
    model, buckets = katz.fit(docs.filter(~F.coalesce("held_out", F.lit(True))))
    scored = katz.score(docs, model, buckets, keep=("doc_id", "held_out"))
    return scored.withColumn("held_out", F.coalesce("held_out", F.lit(False)))  # rows without id are neither held out nor learned from


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, the numbers of the lines that repeat or resemble earlier ones."""
    from parley.llm import linededup

    found = linededup.removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decodings of all documents, as digests."""
    import public_tokenizers

    from parley.llm import bpe

    docs = table(spark, sf_dir, "documents")
    file = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, file, bpe.build_lexicon(docs, file), with_ids=False, with_text=False)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in all documents, of which a tenth repeat from a place on, and digests without the repeats."""
    from parley.llm import periodic

    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.digests(periodic.periodic_runs(docs))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with turns of another, with its subtrees' totals."""
    from parley.llm import prefix_trie

    conversations = table(spark, sf_dir, "conversations")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(conversations), conversations, turn_col="place")


# A subtree's leaves and texts are those of all nodes whose smallest member goes through its top.
OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
           lambda crc, d: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, _: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, d)), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM t
), u AS (
  SELECT ids.c, t.k AS p, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 5 WHERE t.k <= h
  UNION ALL SELECT ids.c, t.k + 8, role, text FROM ids JOIN t ON t.c = ids.c WHERE t.k > h
), r AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS bytes,
         list(sha256(concat(strlen(role), ':', role, text))) OVER w AS path
  FROM u WINDOW w AS (PARTITION BY c ORDER BY p)
), m AS (SELECT c, d, bytes, array_to_string(path, ',') AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT d, path, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes FROM m GROUP BY d, path),
x AS (SELECT m.c, m.d, n.conv, n.n, n.bytes FROM m JOIN n USING (d, path)),
own AS (SELECT a.conv, a.d, b.conv AS parent, a.n, a.bytes FROM x a LEFT JOIN x b ON a.c = b.c AND b.d = a.d - 1 WHERE a.c = a.conv),
kids AS (SELECT parent AS conv, d - 1 AS d, count(*) AS k FROM own WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT own.*, coalesce(k, 0) AS k FROM own LEFT JOIN kids USING (conv, d)),
sums AS (SELECT x.conv, x.d, sum(CAST(f.k = 0 AS BIGINT)) AS leaves, sum((f.n - 1) * f.bytes) AS saved FROM full_ f JOIN x ON x.c = f.conv AND x.d <= f.d GROUP BY ALL),
ends AS (SELECT conv, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS members FROM x WHERE (c, d) IN (SELECT (c, max(d)) FROM m GROUP BY c) GROUP BY ALL)
SELECT f.conv AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.k AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM full_ f JOIN sums USING (conv, d) LEFT JOIN ends USING (conv, d)
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived by content, written as WARC files and described by what is read back."""
    from parley.llm import warc

    return warc.archived_pages(table(spark, sf_dir, "pages")).drop("record_id")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed FROM pages),
firsts AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hexed, CAST(k // 4 * 5 + 1 AS INT), 5) AS INTEGER) >> CAST(15 - k % 4 * 5 AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN firsts USING (html)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_shards": op2_shards,
    "op3_resample": op3_resample,
    "op4_media": op4_media,
    "op5_nearest": op5_nearest,
    "op6_langid": op6_langid,
    "op7_mixing": op7_mixing,
    "op8_katz": op8_katz,
    "op9_lines": op9_lines,
    "op10_bpe": op10_bpe,
    "op11_periodic": op11_periodic,
    "op12_trie": op12_trie,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op5_nearest": OP5_SQL, "op12_trie": OP12_SQL, "op13_warc": OP13_SQL}
