"""Streams with named state and timers: echo hold-back, silence watch, debounced attempts.

Each is a stateful processor with state by name (values, lists and maps in RocksDB, of which a batch
writes what it changed) and event-time timers. Rows wait until the watermark has passed their time and are
then taken in order, so results do not depend on how arrivals are cut into batches, nor on their order within
``delay``; deadlines are timers, so a meeting in which nothing more happens still gives what it holds.

``held_back`` also runs on processing time, where Spark can expire state by itself: the call's history then has
a time to live instead of being removed by event time (Spark has no expiry by event time).

Cases: a row later than the watermark is taken with the next ones; rows without time or key never arrive;
rows of equal time are taken by id; a key that holds nothing has no state but its clock; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.operators.echo import HOLD_MS, KEEP_MS, Guard

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "arrival_ms long, kind string, id string, source string, start_ms long, end_ms long, text string, is_final boolean, rms double"
OUT = "meeting_id long, id string, source string, start_ms long, end_ms long, text string, is_final boolean, emitted_ms long"


def _names(fields: str) -> list[str]:
    return [f.split(" ")[0] for f in fields.split(", ")]


def with_rocks(spark: SparkSession) -> None:
    """Named state needs the RocksDB store, for all stateful streams that are started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Keeps rows (``fields``, the first one their time) until the watermark, and hands them over in order.

    Subclasses say what happens to rows that are due, and when they must be woken next.
    """

    fields: str
    out: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.fields)

    def step(self, key: tuple, due: list[tuple], now: int) -> list[tuple]:
        """Rows to give out, by time, after ``due`` ones in order and nothing else until ``now``."""
        raise NotImplementedError

    def wake(self) -> int | None:
        """The time of the next deadline."""
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for frame in rows for r in zip(*(frame[c].tolist() for c in _names(self.fields)))]
        if fresh:
            self.pending.appendList(fresh)
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, key: tuple, now: int, fresh: list[tuple]) -> pd.DataFrame:
        waiting = list(self.pending.get()) if self.pending.exists() else []
        due = sorted((r for r in waiting if r[0] <= now), key=self.order)
        later = [r for r in waiting if r[0] > now]
        if due:
            self.pending.put(later) if later else self.pending.clear()
        out = self.step(key, due, now)
        wakes = [t for t in (min((r[0] for r in later), default=None), self.wake()) if t is not None]
        for t in self.handle.listTimers():
            if t not in wakes:
                self.handle.deleteTimer(t)
        for t in wakes:
            self.handle.registerTimer(t)
        return pd.DataFrame(out, columns=_names(self.out))

    def order(self, row: tuple) -> tuple:
        return row[:1] + tuple("" if x is None else str(x) for x in row[1:])

    def close(self) -> None:
        pass


def _changed(state, old: dict, new: dict) -> None:
    """Write to a map state what differs."""
    for k in old.keys() - new.keys():
        state.removeKey(k)
    for k, v in new.items():
        if old.get(k) != v:
            state.updateValue(k, v)


class HeldBack(InOrder):
    """Echo hold-back (see ``parley.operators.echo``) with its state by name."""

    fields, out = EVENT, OUT
    held_fields = "id string, source string, start_ms long, end_ms long, text string, plain string, deadline_ms long"

    def __init__(self, lives_ms: int | None = None) -> None:
        self.lives_ms = lives_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        ttl = self.lives_ms
        self.held = handle.getListState("held", self.held_fields)
        self.shown = handle.getMapState("shown", "id string", "end_ms long", ttl)
        self.speaking = handle.getMapState("speaking", "id string", "start_ms long, end_ms long", ttl)
        self.finals = handle.getMapState("finals", "start_ms long, end_ms long, plain string", "times int", ttl)
        self.sounds = handle.getMapState("sounds", "start_ms long", "end_ms long", ttl)
        self.clock = handle.getValueState("clock", "newest_ms long, deadline_ms long")

    def load(self) -> Guard:
        guard = Guard()
        for id_, source, start, end, text, plain, deadline in self.held.get() if self.held.exists() else ():
            guard.held.append(({"id": id_, "source": source, "start_ms": start, "end_ms": end, "text": text, "is_final": True}, plain, deadline))
        guard.shown = {k[0]: v[0] for k, v in self.shown.iterator()}
        guard.speaking = {k[0]: tuple(v) for k, v in self.speaking.iterator()}
        guard.finals = sorted(tuple(k) for k, v in self.finals.iterator() for _ in range(v[0]))
        guard.sounds = sorted([k[0], v[0]] for k, v in self.sounds.iterator())
        if self.clock.exists():
            guard.newest = self.clock.get()[0]
        return guard

    def snapshot(self, guard: Guard) -> tuple:
        times: dict[tuple, int] = {}
        for f in guard.finals:
            times[tuple(f)] = times.get(tuple(f), 0) + 1
        return (
            [(s["id"], s["source"], s["start_ms"], s["end_ms"], s["text"], plain, deadline) for s, plain, deadline in guard.held],
            {(k,): (v,) for k, v in guard.shown.items()},
            {(k,): tuple(v) for k, v in guard.speaking.items()},
            {k: (n,) for k, n in times.items()},
            {(a,): (b,) for a, b in guard.sounds},
        )

    def store(self, guard: Guard, old: tuple) -> None:
        new = self.snapshot(guard)
        if new[0] != old[0]:
            self.held.put(new[0]) if new[0] else self.held.clear()
        for state, before, after in zip((self.shown, self.speaking, self.finals, self.sounds), old[1:], new[1:]):
            _changed(state, before, after)
        self.clock.update((guard.newest, guard.held[0][2] if guard.held else -1))

    def step(self, key: tuple, due: list[tuple], now: int) -> list[tuple]:
        guard = self.load()
        old, out = self.snapshot(guard), []
        for e in due:
            event = dict(zip(_names(self.fields), e))
            out += [(s, event["arrival_ms"]) for s in punctual(guard, event)]
        while guard.held and guard.held[0][2] <= now:
            at = guard.held[0][2]
            out += [(s, at) for s in guard.judged(at)]
        self.store(guard, old)
        return [(key[0], s["id"], s["source"], s["start_ms"], s["end_ms"], s["text"], s["is_final"], at) for s, at in out]

    def wake(self) -> int | None:
        deadline = self.clock.get()[1] if self.clock.exists() else -1
        return deadline if deadline >= 0 else None


class HeldBackLive(HeldBack):
    """The same on processing time: rows are taken as they come, and the call's history has a time to live."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = sorted((r for frame in rows for r in zip(*(frame[c].tolist() for c in _names(self.fields)))), key=self.order)
        out = self.step(key, fresh, -1)
        if self.wake() is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + HOLD_MS)
        yield pd.DataFrame(out, columns=_names(self.out))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        yield pd.DataFrame(self.step(key, [], held[-1][-1] if held else -1), columns=_names(self.out))


def punctual(guard: Guard, event: dict) -> list[dict]:
    """What leaves the guard by an event: first the finals whose deadline is over, without it."""
    now, out = event["arrival_ms"], []
    while guard.held and guard.held[0][2] < now:
        out += guard.judged(guard.held[0][2])
    if event["kind"] == "audio":
        return out + guard.sound(event["start_ms"], event["end_ms"], event["rms"], now)
    return out + guard.segment({c: event[c] for c in ("id", "source", "start_ms", "end_ms", "text", "is_final")}, now)


def _timed(rows: DataFrame, at: str, delay: str, key: str, fields: str) -> DataFrame:
    typed = rows.filter(F.col(at).isNotNull()).select(F.col(key).cast("long").alias(key), *[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in fields.split(", ")])
    filled = typed.na.fill("").na.fill(0).na.fill(False)
    return filled.withColumn("_ts", F.timestamp_millis(F.col(at))).withWatermark("_ts", delay)


def held_back(events: DataFrame, delay: str = "200 milliseconds", processing_time: bool = False) -> DataFrame:
    """Echo suppression of a stream (meeting_id and ``EVENT``) by named state; ``replayed`` is its batch twin."""
    with_rocks(events.sparkSession)
    grouped = _timed(events, "arrival_ms", delay, "meeting_id", EVENT).groupBy("meeting_id")
    if processing_time:
        return grouped.transformWithStateInPandas(HeldBackLive(KEEP_MS), OUT, "append", "ProcessingTime")
    return grouped.transformWithStateInPandas(HeldBack(), OUT, "append", "EventTime")


def replayed(events: list[dict]) -> list[tuple]:
    """One meeting's events through the guard with punctual deadlines: (id, text, emitted_ms)."""
    guard, out = Guard(), []
    for e in sorted(events, key=lambda e: HeldBack.order(HeldBack(), tuple(e[c] for c in _names(EVENT)))):
        for s in punctual(guard, e):
            out.append((s["id"], s["text"], e["arrival_ms"]))
    while guard.held:
        at = guard.held[0][2]
        out += [(s["id"], s["text"], at) for s in guard.judged(at)]
    return out


class Silences(InOrder):
    """A segment after which no other begins for ``wait_ms``."""

    fields, out = "start_ms long, end_ms long, id string, speaker string, text string", "meeting_id long, id string, speaker string, start_ms long, end_ms long, fired_ms long"

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", self.fields)

    def step(self, key: tuple, due: list[tuple], now: int) -> list[tuple]:
        last, out = self.last.get() if self.last.exists() else None, []

        def fire(s: tuple) -> None:
            out.append((key[0], s[2], s[3], s[0], s[1], s[1] + self.wait_ms))

        for s in due:
            if last is not None and s[0] - last[1] >= self.wait_ms:
                fire(last)
            last = s
        if last is not None and last[1] + self.wait_ms <= now:
            fire(last)
            last = None
        self.last.update(last) if last is not None else self.last.clear()
        return out

    def wake(self) -> int | None:
        return self.last.get()[1] + self.wait_ms if self.last.exists() else None


def silences(segments: DataFrame, wait_ms: int = 2_500, delay: str = "5 seconds") -> DataFrame:
    """The stream form of ``turns.unanswered`` (meeting_id, id, speaker, start_ms, end_ms, text), with the time it fired."""
    with_rocks(segments.sparkSession)
    spoken = segments.filter(F.length(F.trim("text")) > 0)
    return _timed(spoken, "start_ms", delay, "meeting_id", Silences.fields).groupBy("meeting_id").transformWithStateInPandas(Silences(wait_ms), Silences.out, "append", "EventTime")


class Debounced(InOrder):
    """Attempts that fire: so long after the last one that fired and was not skipped."""

    fields, out = "at_ms long, skipped boolean", "meeting_id long, at_ms long"

    def __init__(self, apart_ms: int) -> None:
        self.apart_ms = apart_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at_ms long")

    def step(self, key: tuple, due: list[tuple], now: int) -> list[tuple]:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for at, skipped in due:
            if last is None or at - last >= self.apart_ms:
                out.append((key[0], at))
                if not skipped:
                    last = at
                    self.last.update((at,))
        return out


def debounced(attempts: DataFrame, apart_ms: int = 20_000, delay: str = "1 second") -> DataFrame:
    """The stream form of ``live.fired`` (meeting_id, at_ms, skipped)."""
    with_rocks(attempts.sparkSession)
    return _timed(attempts, "at_ms", delay, "meeting_id", Debounced.fields).groupBy("meeting_id").transformWithStateInPandas(Debounced(apart_ms), Debounced.out, "append", "EventTime")
