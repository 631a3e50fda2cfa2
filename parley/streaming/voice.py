"""Utterances from speech flags: a session with hysteresis, a longest length, and cuts at quiet places.

One kernel per (meeting, source) serves the batch form and the streaming form, whose state is the
kernel itself; a stream's state is bounded by the longest utterance.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_MS = 32
SPEECH_MS, SILENCE_MS, SHORT_SILENCE_MS, BEFORE_MS, AFTER_MS = 150, 500, 100, 250, 150
LONGEST_MS, LOOK_BACK_MS, GRACE_MS = 20_000, 3_000, 800


@dataclass
class Segmenter:
    """Fed one window after another (its end, the detector's speech flag, its level); gives (start, end) of utterances.

    The flag comes from a detector that wants 150 ms of speech before it rises and 500 ms of silence
    (100 ms in an utterance over half the longest) before it falls. After three longest utterances
    without a pause the detector begins anew; the open utterance then waits 800 ms for more speech.
    """

    longest_ms: int = LONGEST_MS
    start: int | None = None
    before: int = 0  # the previous utterance's end
    speaking: bool = False
    voice_since: int = 0
    grace_until: int | None = None
    levels: list[tuple[int, float]] = field(default_factory=list)
    fed: int = 0

    def feed(self, end: int, speech: bool, level: float) -> list[tuple[int, int]]:
        soft = self.start is not None and self.speaking and self.fed + 3 * WINDOW_MS - self.voice_since > max(self.longest_ms // 2, 1_500)
        was, self.speaking, self.fed = self.speaking, speech, end
        self.levels = [x for x in self.levels if x[0] > end - LOOK_BACK_MS] + [(end, level * level)]
        if speech and not was:
            self.voice_since = max(end - 2 * WINDOW_MS - SPEECH_MS, 0)
            self.grace_until = None
            if self.start is None:
                self.start = max(self.voice_since - BEFORE_MS, self.before, 0)
        elif was and not speech and self.start is not None:
            silence = SHORT_SILENCE_MS if soft else SILENCE_MS
            return [self.close(end - silence + min(AFTER_MS, silence // 2))]
        elif speech and self.start is not None and end - self.start >= self.longest_ms:
            return [self.cut()]
        elif self.start is not None and self.grace_until is not None and end >= self.grace_until:
            return [self.close(end)]
        return []

    def close(self, end: int) -> tuple[int, int]:
        out = (self.start, min(max(end, self.start), self.fed))
        self.start, self.before, self.grace_until = None, out[1], None
        return out

    def cut(self) -> tuple[int, int]:
        """Ends at the centre of the quietest three windows looked back on (the latest of equals) and begins anew there."""
        low = max(self.start + self.longest_ms // 2, self.fed - LOOK_BACK_MS)
        window = [x for x in self.levels if x[0] - WINDOW_MS >= low]
        three = [(sum(e for _, e in window[i : i + 3]), -window[i + 1][0]) for i in range(len(window) - 2)]
        at = -min(three)[1] - WINDOW_MS // 2 if three else self.fed
        out = self.close(at)
        self.start = out[1]
        if self.fed - self.voice_since >= 3 * max(self.longest_ms, LONGEST_MS):
            self.speaking, self.voice_since, self.grace_until = False, self.fed, self.fed + GRACE_MS
        return out

    def finish(self) -> list[tuple[int, int]]:
        return [self.close(self.fed)] if self.start is not None and self.fed > self.start else []


SCHEMA = "meeting_id long, source string, start_ms long, end_ms long"


def _rows(key: tuple, spans: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"meeting_id": [key[0]] * len(spans), "source": [key[1]] * len(spans), "start_ms": [a for a, _ in spans], "end_ms": [b for _, b in spans]}).astype({"meeting_id": "int64", "start_ms": "int64", "end_ms": "int64"})


def utterances(windows: DataFrame) -> DataFrame:
    """Utterances of finished streams (columns meeting_id, source, end_ms, speech, level)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kernel = Segmenter()
        spans = [s for r in rows.sort_values("end_ms").itertuples() for s in kernel.feed(int(r.end_ms), bool(r.speech), float(r.level))]
        return _rows(key, spans + kernel.finish())

    return windows.groupBy("meeting_id", "source").applyInPandas(run, SCHEMA)


def utterance_stream(windows: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """The same of a stream, utterance by utterance; a stream idle for so long is finished."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(state.get[0]) if state.exists else Segmenter()
        if state.hasTimedOut:
            state.remove()
            yield _rows(key, kernel.finish())
            return
        rows = pd.concat(list(frames)).sort_values("end_ms")
        spans = [s for r in rows.itertuples() if r.end_ms > kernel.fed for s in kernel.feed(int(r.end_ms), bool(r.speech), float(r.level))]
        state.update((pickle.dumps(kernel),))
        state.setTimeoutDuration(idle_ms)
        yield _rows(key, spans)

    return windows.groupBy("meeting_id", "source").applyInPandasWithState(run, SCHEMA, "kernel binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
