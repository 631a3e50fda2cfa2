"""Whether a call reaches the microphone: two thresholds over sliding counts of evidence.

A frame is evidence for an echo path (the microphone was well above its floor and cancelling brought
it back), against it (the call was loud and the microphone stayed at its floor), or neither. The path
is taken as gone once less than ``OFF_BELOW`` of the last ``WINDOW`` evidence frames speak for it, and as
back once ``ON_ABOVE`` of the last ``RECENT`` do.

A step maps either state to a state, and maps compose: the state after a frame is that of the last step
that leads to one state from both, changed once for each step after it that exchanges them. So blocks
of frames are summed up by themselves, blocks of a key in their order, and frames within their block;
counts that slide over many blocks are differences of running counts. A meeting with a third of all
frames is many blocks.

Cases: frames that are no evidence, or have none, keep the last state; before any evidence the path is
taken as there; frames of a key that have the same order value have an undefined order; an empty table
gives no rows; nulls in the key are a key; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames kept, evidence needed, shares and frames that decide, powers.
WINDOW, LEAST, OFF_BELOW, RECENT, ON_ABOVE = 1000, 300, 0.1, 200, 0.5
LOUD_FAR, LEAST_POWER = 1e-4, 1e-8
BLOCK = 4096


def evidence(far: Column, before: Column, after: Column, floor: Column) -> Column:
    """True, false or null from a frame's powers: the call, the microphone before and after cancelling, and its noise floor."""
    removed = (before > 16 * floor) & (after < 2 * floor)
    silent = (far > LOUD_FAR) & (before < 4 * floor)
    return F.when(floor.isNull() | (before < LEAST_POWER), None).when(removed, True).when(silent, False)


def _with(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the further columns of ``other``, which has each key at most once; keys may be null."""
    named = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _windows(keys: list[str], order: str) -> tuple[Window, Window]:
    """Rows of a block up to now, and earlier blocks of a key."""
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return inner, Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (with ``_block``) with sums up to each row: within its block, and of the key's earlier blocks."""
    inner, earlier = _windows(keys, order)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t{n}") for n, c in sums.items()])
    before = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t{n}").over(earlier), F.lit(0)).alias(f"_b{n}") for n in sums])
    found = _with(rows.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}), before, [*keys, "_block"])
    return found.withColumns({n: F.col(n) + F.col(f"_b{n}") for n in sums}).drop(*[f"_b{n}" for n in sums])


def states(rows: DataFrame, keys: list[str], order: str, if_on: Column, if_off: Column, start: bool = True) -> DataFrame:
    """``rows`` (with ``_block``) with ``_state`` after each; a row leads from on to ``if_on``, from off to ``if_off`` (null: no change)."""
    inner, earlier = _windows(keys, order)
    to_on, to_off = F.coalesce(if_on, F.lit(True)), F.coalesce(if_off, F.lit(False))
    swaps = running_sums(rows, keys, order, {"_swaps": (~to_on & to_off).cast("long")})
    ended = swaps.withColumn("_end", F.when(to_on == to_off, F.struct(to_on.alias("state"), "_swaps")))
    ends = ended.groupBy(*keys, "_block").agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col(order))).alias("_last"))
    carried = ends.select(*keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    found = _with(ended.withColumn("_within", F.last("_end", ignorenulls=True).over(inner)), carried, [*keys, "_block"])
    since = F.coalesce("_within", "_carried")
    exchanged = (F.col("_swaps") - F.coalesce(since["_swaps"], F.lit(0))) % 2 == 1
    return found.withColumn("_state", F.coalesce(since["state"], F.lit(start)) != exchanged).drop("_swaps", "_end", "_within", "_carried")


def echo_paths(
    frames: DataFrame, keys: list[str], order: str, proof: Column, window: int = WINDOW, least: int = LEAST, off_below: float = OFF_BELOW, recent: int = RECENT, on_above: float = ON_ABOVE, block: int = BLOCK
) -> DataFrame:
    """``frames`` with ``coupled``, the state after each; ``order`` is a whole number, ``proof`` boolean or null."""
    rows = frames.withColumns({"_proof": proof, "_block": F.floor(F.col(order) / block)})
    given = F.col("_proof").isNotNull()
    counted = running_sums(rows, keys, order, {"_n": given.cast("long"), "_yes": F.coalesce(F.col("_proof").cast("long"), F.lit(0))})
    marks = counted.filter(given)
    for steps, name in ((window, "_old"), (recent, "_older")):  # the running count that many evidence frames ago
        counted = _with(counted, marks.select(*keys, (F.col("_n") + steps).alias("_n"), F.col("_yes").alias(name)), [*keys, "_n"])
    seen = F.least(F.col("_n"), F.lit(window))
    off = (seen >= least) & (F.col("_yes") - F.coalesce("_old", F.lit(0)) < off_below * seen)
    on = F.col("_yes") - F.coalesce("_older", F.lit(0)) >= on_above * recent
    found = states(counted.withColumns({"_off": F.when(given, off), "_on": F.when(given, on)}), keys, order, ~F.col("_off"), F.col("_on"))
    return found.select(*frames.columns, F.col("_state").alias("coupled"))
