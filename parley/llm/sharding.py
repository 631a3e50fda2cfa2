"""Shards that all hold the sources' mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank
(rank + 1/2) / rows of the source spreads every source evenly over 0..1. The rows in the order of
that fraction are cut into shards of equal counts, so each shard holds each source's share.

Ranks come from range-partitioned sorts: a source with a third of all rows is spread over many
tasks, and only ids and sizes are shuffled, never texts.

Cases: a null text counts 0 bytes and has the checksum of the empty text; null sources are a
source of their own; repeated rows stay repeated (ties go by id, checksum and size); an empty table
gives no shards; with fewer rows than shards some shards stay empty; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import scaled_partitions, settle


def with_position(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in the given order over all rows.

    One range shuffle; the driver sees one count per partition.
    """
    parts = scaled_partitions(df.sparkSession)
    placed = settle(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())  # partition << 33 | place in it
    )
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.get(F.lit(starts).cast("array<long>"), part.cast("int")) if starts else F.lit(0).cast("long")
    return placed.withColumn(name, start + place).drop("_at")


def shard(docs: DataFrame, shards: int = 24, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per row: id, source, size (UTF-8 bytes plus 8), text_crc32, shard, slot (gapless from 0)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_shuffled"),
    )
    ranked = with_position(rows, "source", "_shuffled", "doc_id", "text_crc32", "size")
    sources = ranked.groupBy(F.col("source").alias("_source")).agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    spread = (
        ranked.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_share", (F.col("position") - F.col("_first") + 0.5) / F.col("_rows"))
        .drop("position", "_first", "_rows", "_source")
    )
    placed = with_position(spread, "_share", "_shuffled", "doc_id", "text_crc32", "size")
    total = placed.count()
    cut = F.expr(f"cast((position * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", cut).withColumn("slot", (F.col("position") - first).cast("long")).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
