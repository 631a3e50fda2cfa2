"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of neighbours are hashed into buckets. The raw model has the buckets' frequencies
over all documents, the target model those of a bounded sample of good documents, drawn to the raw
frequencies where the sample expects few. A document's weight is the ratio of its likelihoods under
the two models; the log weights plus Gumbel noise from a seeded hash of the id are ranked, and the k
largest are a sample without replacement in proportion to the weights.

Cases: a null text or one without words has ratio 1 (log 0); without target documents all weights
are equal; texts are taken whole; rows with one id have equal noise; ties go to the smaller id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import hashed_words, mixed, settle, SLICES, slices_of, small_batches, summed_slices, text_slices
from parley.llm.sharding import with_position

BUCKETS = 1 << 20
TARGET_DOCS = 20_000  # at most so many good documents make the target model
PRIOR = 10.0  # with 2, held-out good documents scored far below those learned from


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of all words and neighbouring pairs."""
    words, doc, _, _ = hashed_words(texts)
    same = doc[1:] == doc[:-1]
    pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[same]
    bucket = np.concatenate([words, pairs]) >> np.uint64(44)
    return np.concatenate([doc, doc[:-1][same]]), bucket.astype(np.int64)


def fit(docs: DataFrame, good_ids: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """log target over raw frequency by bucket; good_ids has one column of ids (columns doc_id, text of docs)."""
    kind = dict(docs.dtypes)["doc_id"]
    ids = good_ids.toDF("id").select(F.xxhash64(F.col("id").cast(kind)).alias("h"), "id").filter("id is not null").distinct().orderBy("h", "id").limit(target_docs)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r.h for r in ids.collect()), np.int64))
    width = 2 * BUCKETS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in text_slices(batch, 1):
                doc, bucket = grams(part.column(1))
                target = (np.isin(part.column(0).fill_null(0).to_numpy(), shared.value) & ~np.array(part.column(0).is_null(), bool))[doc]
                held[0] += np.bincount(bucket, minlength=BUCKETS)
                held[1] += np.bincount(bucket[target], minlength=BUCKETS)
        flat = held.reshape(-1)
        at = np.flatnonzero(flat)
        yield slices_of(at, flat[at], width)

    small_batches(docs.sparkSession)
    known = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))  # ids of any kind
    partial = docs.select(known.alias("h"), "text").mapInArrow(run, "slice int, blob binary")
    raw, target = summed_slices(partial, width, np.zeros(2 * BUCKETS)).reshape(2, BUCKETS)
    expected = raw / max(raw.sum(), 1) * target.sum()
    model = raw * (target + PRIOR) / (expected + PRIOR)
    total = max(model.sum(), 1e-9)
    ratio = np.where(raw > 0, (target + PRIOR) / (expected + PRIOR) * raw.sum() / total, 1.0)
    return np.log(ratio).astype(np.float32)


def log_ratios(docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """doc_id, log_ratio of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                doc, bucket = grams(part.column(1))
                sums = np.bincount(doc, shared.value[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.float64())], names=["doc_id", "log_ratio"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, log_ratio double")


def resample(docs: DataFrame, good_ids: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """doc_id, log_ratio, gumbel_key, rank (from 0) of the ``share`` of the rows that is sampled."""
    scored = log_ratios(docs, fit(docs, good_ids))
    uniform = (F.xxhash64(F.lit(seed), F.col("doc_id")).cast("double") / F.lit(2.0**64)) + 0.5
    inside = F.greatest(F.lit(1e-18), F.least(uniform, F.lit(1 - 1e-16)))
    keyed = settle(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(inside))))
    ranked = with_position(keyed, F.desc("gumbel_key"), F.asc("doc_id"), name="rank")
    return ranked.filter(F.col("rank") < F.lit(int(round(share * keyed.count()))))
