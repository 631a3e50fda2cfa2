"""Vector and level functions on arrays, as Column expressions; and sums of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequally long or zero vectors."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one; null if empty, not finite or (nearly) zero."""
    n = norm(a)
    return F.when((F.size(a) > 0) & ~F.isnan(n) & (n < float("inf")) & (n > 1e-12), F.transform(a, lambda x: x.cast("double") / n))


def duration_weight(ms: Column) -> Column:
    """Seconds between a half and ten."""
    return F.least(F.greatest(ms / 1000.0, F.lit(0.5)), F.lit(10.0))


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 without samples."""
    return F.when(F.size(samples) > 0, F.sqrt(dot(samples, samples) / F.size(samples))).otherwise(F.lit(0.0))


def decibels(level: Column, floor: float = -100.0) -> Column:
    """20 log10 of a level, at least ``floor``."""
    return F.when(level > 0, F.greatest(20 * F.log10(level), F.lit(floor))).otherwise(F.lit(floor))


def meter_fraction(db: Column, low: float = -55.0, span: float = 50.0) -> Column:
    """A level's place on a meter, between 0 and 1."""
    return F.least(F.greatest((db - low) / span, F.lit(0.0)), F.lit(1.0))


def windows(samples: Column, length: int, hop: int) -> Column:
    """Starts (from 0) and slices of sliding windows; the last one ends with the samples, short input is one window."""
    n = F.size(samples)
    starts = F.when(n <= length, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), n - length, F.lit(hop)), F.array(n - length))))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(samples, s + 1, F.least(F.lit(length), n)).alias("values")))


KEYS_HELD = 20_000  # whose sums a task holds at once


def sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, sum: of each key's vectors (those without nulls), place by place; sums leave a task once per key and length."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        key_type = None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], key_type), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["key", "part"])
            held.clear()
            return batch

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    held[k, len(x)] = held[k, len(x)] + x if (k, len(x)) in held else x
            if len(held) > KEYS_HELD:
                yield out()
        if held:
            yield out()

    parts = df.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(run, f"key {kind}, part array<double>")
    places = parts.select("key", F.size("part").alias("n"), F.posexplode("part").alias("at", "x")).groupBy("key", "n", "at").agg(F.sum("x").alias("x"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return places.groupBy("key", "n").agg(whole.alias("sum")).select(F.col("key").alias(key), "sum")
