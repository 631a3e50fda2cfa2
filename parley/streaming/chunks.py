"""Equal chunks from pieces that arrive with their own clock; long lags become jumps of the timeline."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RATE, SIZE, LAG_MS, PERSIST_MS = 16_000, 512, 250, 1000
SCHEMA = "meeting_id long, source string, start_ms long, samples array<float>"


@dataclass
class Rechunker:
    """Counts time in samples; a lag behind arrival of over ``LAG_MS`` that lasts ``PERSIST_MS`` moves it on by the least lag seen."""

    anchor_ms: int | None = None
    done: int = 0  # samples since the anchor
    waiting: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    lag_since: int | None = None
    least_lag: int = 0

    def feed(self, arrival_ms: int, samples) -> list[tuple[int, list[float]]]:
        """A piece whose last sample arrived at ``arrival_ms``; gives full chunks with their starts."""
        samples = np.asarray(samples, np.float32)
        length = len(samples) * 1000 // RATE
        if self.anchor_ms is None:
            self.anchor_ms = arrival_ms - length
        out: list[tuple[int, list[float]]] = []
        lag = arrival_ms - length - self.at(self.done + len(self.waiting))
        if lag > LAG_MS:
            self.least_lag = lag if self.lag_since is None else min(self.least_lag, lag)
            self.lag_since = arrival_ms if self.lag_since is None else self.lag_since
            if arrival_ms - self.lag_since >= PERSIST_MS:
                out += self.finish()
                self.anchor_ms, self.done, self.lag_since = self.at(self.done) + self.least_lag, 0, None
        else:
            self.lag_since = None
        self.waiting = np.concatenate([self.waiting, samples])
        while len(self.waiting) >= SIZE:
            out.append((self.at(self.done), self.waiting[:SIZE].tolist()))
            self.waiting, self.done = self.waiting[SIZE:], self.done + SIZE
        return out

    def at(self, samples: int) -> int:
        return self.anchor_ms + samples * 1000 // RATE

    def finish(self) -> list[tuple[int, list[float]]]:
        """The partial chunk, padded with silence."""
        if not len(self.waiting):
            return []
        out = (self.at(self.done), np.pad(self.waiting, (0, SIZE - len(self.waiting))).tolist())
        self.waiting, self.done = self.waiting[:0], self.done + SIZE
        return [out]


def _rows(key: tuple, found: list) -> pd.DataFrame:
    return pd.DataFrame({"meeting_id": [key[0]] * len(found), "source": [key[1]] * len(found), "start_ms": [a for a, _ in found], "samples": [s for _, s in found]}).astype({"meeting_id": "int64", "start_ms": "int64"})


def rechunked(pieces: DataFrame) -> DataFrame:
    """Chunks of finished streams (columns meeting_id, source, arrival_ms, samples)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kernel = Rechunker()
        found = [c for r in rows.sort_values("arrival_ms").itertuples() for c in kernel.feed(int(r.arrival_ms), r.samples)]
        return _rows(key, found + kernel.finish())

    return pieces.groupBy("meeting_id", "source").applyInPandas(run, SCHEMA)


def chunk_stream(pieces: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """The same of a stream; one idle for so long is finished."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(state.get[0]) if state.exists else Rechunker()
        if state.hasTimedOut:
            state.remove()
            yield _rows(key, kernel.finish())
            return
        found = [c for r in pd.concat(list(frames)).sort_values("arrival_ms").itertuples() for c in kernel.feed(int(r.arrival_ms), r.samples)]
        state.update((pickle.dumps(kernel),))
        state.setTimeoutDuration(idle_ms)
        yield _rows(key, found)

    return pieces.groupBy("meeting_id", "source").applyInPandasWithState(run, SCHEMA, "kernel binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
