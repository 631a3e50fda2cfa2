"""Token usage and cost of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_PRICES = 1000


def priced(responses: DataFrame, prices: DataFrame) -> DataFrame:
    """``responses`` with cost: the first price row whose pattern finds the model; null without one.

    ``prices`` is a short ordered list (``MOST_PRICES`` at most), so it becomes a chain of conditions and no join.
    """
    rows = prices.limit(MOST_PRICES + 1).collect()
    if len(rows) > MOST_PRICES:
        raise ValueError(f"a price list has {MOST_PRICES} rows at most")

    def first(column: str) -> Column:
        out = F.lit(None).cast("double")
        for r in reversed(rows):
            out = F.when(F.col("model").rlike(r.pattern), F.lit(r[column])).otherwise(out)
        return out

    cost = F.col("input") * first("input_price") + F.col("cache_read") * first("read_price") + F.col("cache_write") * first("input_price") * 1.25 + F.col("output") * first("output_price")
    return responses.withColumn("cost", cost / 1e6)


def totals(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, tokens, cost, unpriced responses, the largest live prompt, and the cache hit rate (null without prompts)."""
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(c).cast("long").alias(c) for c in ("input", "cache_read", "cache_write", "output")],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"),
        F.coalesce(F.max(F.when(F.col("live"), prompt)), F.lit(0)).alias("peak_prompt"),
        F.try_divide(F.sum("cache_read"), F.nullif(F.sum(prompt), F.lit(0))).alias("hit_rate"),
    )
