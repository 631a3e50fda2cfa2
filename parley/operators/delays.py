"""How far an echo lags behind the call: correlated envelopes, confirmed lags, and when to realign.

Every ``STEP`` frames the last ``WINDOW`` frames of the microphone's log energy are correlated with the
call's at every lag up to ``MOST_LAG``, all lags at once by Fourier transforms. A lag stands if it
correlates well and clearly better than others; it is confirmed when ``AGREEING`` estimates in a row differ
by ``NEAR`` frames or less. Estimates come from groups of ``GROUP`` frames with the frames before them
that they need, so a meeting of any length is many groups of one size. What follows is on estimates: streaks
by windows, and only estimates that differ from the one before reach the fold of confirmations.

Cases: a frame that is missing or has no level is silence; frames that are given twice count with the
louder level; before ``LEAST_WINDOW`` frames beyond the longest lag there is no estimate, nor where the call or the
microphone hardly changes; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

FRAME_MS = 10
#: Fixed values, in frames (10 ms) unless named otherwise.
WINDOW, LEAST_WINDOW, STEP, MOST_LAG = 500, 200, 50, 100
FLOOR_DB, ACTIVE_DB = -75.0, -55.0
LEAST_SCORE, LEAST_LEAD, APART = 0.4, 0.08, 8
NEAR, AGREEING = 3, 3
NATIVE_MS, LATE_MS, EARLY_MS, COOLDOWN = (30, 400), 100, 250, 500
GROUP = 24_000


def log_energy(samples: Column) -> Column:
    """A frame's level in dB of full scale, ``FLOOR_DB`` at least."""
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.greatest(10 * F.log10(squares / F.greatest(F.size(samples), F.lit(1)) + 1e-20), F.lit(FLOOR_DB))


def best_lag(far: np.ndarray, near: np.ndarray, most_lag: int) -> int | None:
    """The lag at which ``near`` follows ``far`` (all that is known, up to now), if one stands out."""
    n = len(near)
    if np.count_nonzero(far > ACTIVE_DB) * 4 < n:
        return None
    centred = near - near.sum() / n
    near_variance = (centred * centred).sum() / n
    if near_variance < 1.0:
        return None
    history = far[len(far) - n - most_lag :]
    size = 1 << (len(history) + n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(history, size) * np.conj(np.fft.rfft(centred, size)), size)[: most_lag + 1]
    sums = np.zeros((2, len(history) + 1))
    np.cumsum([history, history * history], axis=1, out=sums[:, 1:])
    mean, square = (sums[:, n:] - sums[:, :-n]) / n
    variance = square - mean * mean
    with np.errstate(invalid="ignore", divide="ignore"):
        scores = np.where(variance < 1.0, -np.inf, cross / n / np.sqrt(variance * near_variance))[::-1]  # by lag
    best = most_lag - int(np.argmax(scores[::-1]))  # of equal ones the longest
    others = scores[np.abs(np.arange(most_lag + 1) - best) > APART]
    runner_up = others.max() if len(others) else -np.inf
    return best if scores[best] >= LEAST_SCORE and scores[best] - runner_up >= LEAST_LEAD else None


def estimates(frames: DataFrame, keys: list[str], window: int = WINDOW, least: int = LEAST_WINDOW, step: int = STEP, most_lag: int = MOST_LAG, group: int = GROUP) -> DataFrame:
    """keys, frame, lag: what stood out after each ``step`` frames (columns frame, from 0, far_db, near_db)."""
    reach = window + most_lag
    group = -(-group // step) * step
    level = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(FLOOR_DB)), F.lit(FLOOR_DB))
    named = frames.filter("frame >= 0").select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("frame").cast("long").alias("frame"), level("far_db").alias("far"), level("near_db").alias("near"))
    ks = [f"k{i}" for i in range(len(keys))]
    # a frame belongs to its group and, as history, to the next ones it reaches into
    dealt = named.withColumn("part", F.explode(F.sequence(F.floor(F.col("frame") / group), F.floor((F.col("frame") + reach) / group))))
    # a group that holds only history of a later one, or ends before the first estimate, gives nothing: it is not sent to Python
    first = -(-(least + most_lag) // step) * step
    last = F.max("frame").over(Window.partitionBy(*ks, "part"))
    ending = dealt.withColumn("last", last).filter(F.col("last") + 1 >= F.greatest(F.col("part") * group + step, F.lit(first))).drop("last")
    schema = named.select(*ks, "frame", F.lit(None).cast("int").alias("lag")).schema
    result = to_arrow_schema(schema)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        start = key[-1].as_py() * group
        begin = max(0, start - reach)
        at, far_db, near_db = (rows[c].to_numpy() for c in ("frame", "far", "near"))
        end = int(at.max()) + 1
        far, near = np.full(end - begin, FLOOR_DB), np.full(end - begin, FLOOR_DB)
        np.maximum.at(far, at - begin, far_db)
        np.maximum.at(near, at - begin, near_db)
        found = []
        for to in range(start + step, min(end, start + group) + 1, step):
            n = min(to, window, to - most_lag)
            if n >= least:
                lag = best_lag(far[max(0, to - reach) - begin : to - begin], near[to - n - begin : to - begin], most_lag)
                if lag is not None:
                    found.append((to - 1, lag))
        frame, lag = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.table([*(pa.repeat(k, len(found)) for k in key[:-1]), frame, lag], names=result.names).cast(result)

    out = ending.groupBy(*ks, "part").applyInArrow(run, schema)
    known = lambda k, kind: F.nanvl(k, F.lit(None)) if kind in ("float", "double") else F.col(k)  # noqa: E731  (a key that is no number comes back as null)
    return out.select(*[known(f"k{i}", named.dtypes[i][1]).alias(k) for i, k in enumerate(keys)], "frame", "lag")


def streaks(found: DataFrame, keys: list[str], near: int = NEAR) -> DataFrame:
    """Estimates with ``streak``: how many in a row, this one included, differ from the one before by ``near`` or less."""
    w = Window.partitionBy(*keys).orderBy("frame")
    breaks = F.coalesce((F.abs(F.col("lag") - F.lag("lag").over(w)) > near).cast("int"), F.lit(1))
    islands = found.withColumn("_breaks", breaks).withColumn("_island", F.sum("_breaks").over(w))
    return islands.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("frame"))).drop("_breaks", "_island")


def wanted_delay(delay_ms: int, current_ms: int) -> int | None:
    """The reference's delay that brings a confirmed echo back into the canceller's own range, if it is out of it."""
    if delay_ms >= current_ms + NATIVE_MS[1]:
        return delay_ms - LATE_MS
    if current_ms > 0 and delay_ms < current_ms + NATIVE_MS[0]:
        return max(0, delay_ms - EARLY_MS)
    return None


def confirmations(found: DataFrame, keys: list[str], agreeing: int = AGREEING, near: int = NEAR, cooldown: int = COOLDOWN) -> DataFrame:
    """keys, frame, delay_ms of confirmed lags; realigned, and reference_ms, the reference's delay from then on."""
    sure = streaks(found, keys, near).filter(F.col("streak") >= agreeing)
    w = Window.partitionBy(*keys).orderBy("frame")
    changed = sure.withColumn("_old", F.lag("lag").over(w)).filter("_old IS NULL OR _old <> lag")  # an equal one confirms nothing new
    named = changed.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "frame", "lag")
    ks = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join([*(f"{k} {t}" for k, t in named.dtypes[: len(ks)]), "frame long, delay_ms int, realigned boolean, reference_ms int"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, confirmed, current, last = [], None, 0, None
        for frame, lag in sorted(zip(rows["frame"].tolist(), rows["lag"].tolist())):
            if confirmed is not None and abs(confirmed - lag) <= near:
                continue
            confirmed = lag
            want = wanted_delay(lag * FRAME_MS, current)
            moved = want is not None and want != current and (last is None or frame >= last + cooldown)
            if moved:
                current, last = want, frame
            out.append((*key, frame, lag * FRAME_MS, moved, current))
        return pd.DataFrame(out, columns=[*ks, "frame", "delay_ms", "realigned", "reference_ms"])

    out = named.groupBy(*ks).applyInPandas(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "frame", "delay_ms", "realigned", "reference_ms")
