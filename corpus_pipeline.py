"""From raw documents to token ids: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again, so a lost executor costs no finished stage.

Cases, alike in all stages: rows may lack any value; a null or empty text has no language and goes
with the first stage; repeated rows are treated alike until near-dedup keeps one of them; rows that
share an id but not a text, or have no id, are each judged by their text; texts are taken whole; an
empty table gives no rows; further columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, langid, linededup, mixing, simhash
from parley.llm.common import stored

#: A document stays if this share of its letters is in one language.
LEAST_LANGUAGE_SHARE = 0.5
#: No source's tokens are repeated more often.
MOST_REPEATS = 1.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no language has half of."""
    model = langid.fit(docs)
    prefix = "found "
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = langid.identify(docs, model, keep=tuple(docs.columns), with_spans=False, prefix=prefix)
    sure = (F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= LEAST_LANGUAGE_SHARE)
    return found.filter(sure).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat or resemble earlier ones."""
    return linededup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose members have 0.8 or more of their five-word shingles in common."""
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources have their weights."""
    return mixing.mix(docs, most_repeats=MOST_REPEATS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with digests of the ids and of their decoding."""
    file = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, file, bpe.build_lexicon(docs, file), keep=("doc_id", "source"), with_text=False)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("BPE encoding", encoded),
]

#: Hashes, Viterbi and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
