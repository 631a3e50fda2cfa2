"""Streaming forms of the meeting operators; each has a batch twin that tests compare it with."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions.text import is_blank
from parley.operators.echo import HOLD_MS, Guard

IDLE_MS = 600_000
OUT = "meeting_id long, id string, source string, start_ms long, end_ms long, text string, is_final boolean, emitted_ms long"
COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]


def held_back_stream(events: DataFrame) -> DataFrame:
    """Echo suppression of a stream of audio activity and segments (see ``parley.operators.echo``).

    A held final is judged again with every batch of its meeting, and after ``HOLD_MS`` without one. A
    meeting that holds nothing and is silent for ``IDLE_MS`` is forgotten.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard, last = pickle.loads(state.get[0]) if state.exists else (Guard(), 0)
        out = []
        if state.hasTimedOut:
            if not guard.held:
                state.remove()
                yield pd.DataFrame(columns=COLUMNS)
                return
            last += HOLD_MS
            out += [{**s, "emitted_ms": last} for s in guard.judged(last)]
        else:
            for e in pd.concat(list(frames)).sort_values("arrival_ms", kind="stable").to_dict("records"):
                last = max(last, int(e["arrival_ms"]))
                got = guard.sound(int(e["start_ms"]), int(e["end_ms"]), e["rms"], last) if e["kind"] == "audio" else guard.segment(e, last)
                out += [{**s, "emitted_ms": last} for s in got]
        state.update((pickle.dumps((guard, last)),))
        state.setTimeoutDuration(HOLD_MS if guard.held else IDLE_MS)
        yield pd.DataFrame(out, columns=COLUMNS if not out else None).reindex(columns=COLUMNS)

    return events.groupBy("meeting_id").applyInPandasWithState(run, OUT, "guard binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def finals_once(segments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first final of each id with text, within a delay (event time in the column ts)."""
    return segments.withWatermark("ts", delay).filter(F.col("is_final") & ~is_blank(F.col("text"))).dropDuplicatesWithinWatermark(["meeting_id", "id"])


def levels(chunks: DataFrame, size: str = "100 milliseconds", delay: str = "5 seconds") -> DataFrame:
    """Root mean square of each window of a stream (columns meeting_id, source, ts, samples)."""
    squares = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sums = chunks.withWatermark("ts", delay).groupBy("meeting_id", "source", F.window("ts", size)).agg(F.sum(squares).alias("s"), F.sum(F.size("samples")).alias("n"))
    return sums.select("meeting_id", "source", F.col("window.start").alias("start"), F.sqrt(F.col("s") / F.greatest("n", F.lit(1))).alias("rms"))


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions per user of a stream (columns user_id, ts, value), once the watermark has passed them."""
    grouped = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def current_only(sink: Callable[[DataFrame, int], None], generation: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that drops batches of an older generation and repeats of a batch."""
    mine, done = generation(), -1

    def run(batch: DataFrame, epoch: int) -> None:
        nonlocal done
        if generation() == mine and epoch > done:
            sink(batch, epoch)
            done = epoch

    return run


def run_once(stream: DataFrame, name: str, mode: str = "append", wait_s: float = 120.0) -> DataFrame:
    """Processes what is there into a table in memory and returns it, for tests and small jobs.

    Processing-time timers make batches without end, so the query is stopped after one without input.
    """
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    limit = time.time() + wait_s
    try:
        while time.time() < limit:
            seen = [p["numInputRows"] for p in query.recentProgress]
            if query.exception() is not None or (any(seen) and seen[-1] == 0):
                break
            time.sleep(0.2)
    finally:
        failed = query.exception()
        query.stop()
    if failed is not None:
        raise failed
    return stream.sparkSession.table(name)
