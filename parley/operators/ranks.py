"""Places and percentiles within keys, without a task that holds a key.

Rows are sorted over all partitions by key and order; a row's running total is that of its part of a
partition, after the totals of the key's earlier partitions, of which there is one row each. Percentiles run over
the different values with their counts, so a value that a third of all rows have is one row.

Cases: null values have no place in percentiles and come first otherwise; nulls in keys are a key; ties of
order are told apart by a hash of the row, equal rows are alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import settled


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys that may be null; ``small`` has each once."""
    named = small.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return rows.join(named, on, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def running_total(rows: DataFrame, keys: list[str], order: list[str | Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over a key's rows up to each in ``order``."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled(rows.withColumn("_weight", weight).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *keys).agg(F.sum("_weight").alias("_total"))
    before = totals.select("_part", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    found = _joined(dealt.withColumn(name, F.sum("_weight").over(inner)), before, ["_part", *keys])
    return found.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_weight", "_before")


def placed(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 among those of their key."""
    return running_total(rows, keys, [*order, F.xxhash64(*rows.columns)], F.lit(1).cast("long"), name)


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], between: bool = False) -> DataFrame:
    """keys and for each name of ``wanted`` the value at (n - 1) q of the sorted values: the nearest place (halves up), or between the two in proportion."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = running_total(counts, keys, ["_v"], F.col("_n"), "_to")
    met = _joined(run, run.groupBy(*keys).agg(F.max("_to").alias("_all")), keys)
    out, last = [], []
    for name, q in wanted.items():
        at = (F.col("_all") - 1) * F.lit(float(q))
        held = lambda place: F.max(F.when((place >= F.col("_to") - F.col("_n")) & (place < F.col("_to")), F.col("_v")))
        if between:
            out += [held(F.floor(at)).alias(f"{name}_low"), held(F.ceil(at)).alias(f"{name}_high"), F.max(at - F.floor(at)).alias(f"{name}_part")]
            low = F.col(f"{name}_low")
            last.append((low + (F.col(f"{name}_high") - low) * F.col(f"{name}_part")).alias(name))
        else:
            out.append(held(F.floor(at + 0.5)).alias(name))
            last.append(F.col(name))
    return met.groupBy(*keys).agg(*out).select(*keys, *last)
