"""Joins and unions of time intervals.

Range conditions alone would make Spark compare all pairs; intervals are dealt into time buckets
first, so the join has an equality on (key, bucket). A pair is kept in the bucket where the later of
the two begins, so no pair is made twice and none has to be removed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dealt(df: DataFrame, low: Column, high: Column, bucket: int) -> DataFrame:
    dealt = df.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    first, last = F.floor(F.col("_low") / bucket), F.floor(F.col("_high") / bucket)
    return dealt.withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], bucket: int, how: str = "inner") -> DataFrame:
    """Pairs of one key whose closed intervals meet; ``right`` shares only the keys' names with ``left``.

    ``how`` is inner or left_semi. An interval of n buckets has n rows, so ``bucket`` should be about a
    usual length; a semi join makes no buckets and keeps repeated rows of ``left``.
    """
    if how == "left_semi":
        return _meeting(left, right, keys, left_span, right_span)
    a = _dealt(left, *left_span, bucket)
    b = _dealt(right, *right_span, bucket)
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in (*keys, "_low", "_high", "_bucket")], F.col("_low").alias("_rlow"), F.col("_high").alias("_rhigh"), F.col("_bucket").alias("_rbucket"))
    same = (a["_bucket"] == b["_rbucket"]) & (F.col("_low") <= F.col("_rhigh")) & (F.col("_rlow") <= F.col("_high"))
    for k in keys:
        same = same & (a[k] == b[f"_k_{k}"])
    once = F.col("_bucket") == F.floor(F.greatest("_low", "_rlow") / bucket)
    return a.join(b, same & once).drop("_low", "_high", "_bucket", "_rlow", "_rhigh", "_rbucket", *[f"_k_{k}" for k in keys])


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column]) -> DataFrame:
    """Rows of ``left`` that some interval of ``right`` meets: of the right side's islands, which do not meet each other, the last that begins by a row's end decides."""
    spans = right.select(*keys, right_span[0].alias("_at"), right_span[1].alias("_until")).filter("_at <= _until")
    islands = merged(spans, keys, "_at", "_until", 0)
    rows = left.select(*keys, left_span[1].alias("_at"), left_span[0].alias("_since"), F.struct(*left.columns).alias("_whole"))
    found = as_of(rows, islands, keys, "_at", ["_until"])
    return found.filter("_since <= _at AND _until >= _since").select("_whole.*")


def merged(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", touch: int = 1) -> DataFrame:
    """Spans of a key that overlap or lie within ``touch`` of each other, as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)
    island = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def uncovered(spans: DataFrame, covers: DataFrame, keys: list[str], slack: int, least: int, bucket: int) -> DataFrame:
    """Spans (columns keys, span_id, start_ms, end_ms) some part of which, longer than ``least``, no cover widened by ``slack`` has."""
    wide = merged(covers.select(*keys, (F.col("start_ms") - slack).alias("c_start"), (F.col("end_ms") + slack).alias("c_end")), keys, "c_start", "c_end", 0)
    met = overlap_join(spans, wide, keys, (F.col("start_ms"), F.col("end_ms")), (F.col("c_start"), F.col("c_end")), bucket)
    ids = [*keys, "span_id", "start_ms", "end_ms"]
    w = Window.partitionBy(*ids).orderBy("c_start")
    gap_before = F.col("c_start") - F.coalesce(F.max("c_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_ms"))
    gaps = met.withColumn("_gap", gap_before).groupBy(*ids).agg(F.max("_gap").alias("_gap"), F.max("c_end").alias("_end"))
    joined = spans.join(gaps, ids, "left")
    worst = F.when(F.col("_end").isNull(), F.col("end_ms") - F.col("start_ms")).otherwise(F.greatest("_gap", F.col("end_ms") - F.col("_end")))
    return joined.filter(worst > least).drop("_gap", "_end")


def as_of(points: DataFrame, anchors: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """``points`` with the values of the last anchor at or before each (null before the first): one sort, no range join."""
    packed = F.struct(F.col(at).alias("_at"), *values)
    a = anchors.select(*keys, at, packed.alias("_anchor"), F.lit(0).alias("_kind"))
    p = points.select(*keys, at, F.struct(*[c for c in points.columns if c not in (*keys, at)]).alias("_row"), F.lit(1).alias("_kind"))
    both = a.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_kind")
    known = both.withColumn("_anchor", F.last("_anchor", ignorenulls=True).over(w)).filter("_kind = 1")
    return known.select(*keys, at, "_row.*", F.col("_anchor._at").alias("anchor_at"), *[F.col("_anchor")[v].alias(v) for v in values])


def session_ms(points: DataFrame, anchors: DataFrame, keys: list[str], rate: int = 16_000) -> DataFrame:
    """``points`` (column sample) with ms, by the last anchor (sample, ms) at or before each; before the first one its time."""
    first = anchors.groupBy(*keys).agg(F.min_by("ms", "sample").alias("_first"))
    known = as_of(points, anchors, keys, "sample", ["ms"]).join(first, keys, "left")
    own = F.expr(f"ms + (sample - anchor_at) * 1000 div {rate}")
    alone = F.expr(f"coalesce(_first, sample * 1000 div {rate})")
    return known.withColumn("ms", F.coalesce(own, alone)).drop("_first", "anchor_at")


def matched_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: int) -> DataFrame:
    """Rows of ``left`` for which ``right`` has a point of the key within the tolerance."""
    point = F.col(at)
    wide = right.select(*keys, (point - tolerance).alias("r_low"), (point + tolerance).alias("r_high"))
    return overlap_join(left, wide, keys, (point, point), (F.col("r_low"), F.col("r_high")), max(1, 2 * tolerance), "left_semi")
