"""Echo suppression: microphone finals that repeat the call are dropped or blanked.

The batch form has all of the call's finals; the streaming form holds a microphone final back until
the call's text can be known, in order, for a bounded time. Both judge by the same text rule.
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import is_echo, normalized
from parley.operators.intervals import overlap_join

REACH_MS, HOLD_MS, KEEP_MS = 1_500, 2_500, 60_000
QUIET_RMS, SLACK_MS, LEAST_GAP_MS, LEAST_SCORE = 0.003, 500, 150, 0.6


def echoes(segments: DataFrame, activity: DataFrame) -> DataFrame:
    """meeting_id, id of microphone finals that are echoes; ``activity`` has the call's sound (start_ms, end_ms, rms).

    A final is judged only if the call sounded near it; its text is compared with the joined finals of the call near it.
    """
    finals = segments.filter("is_final").withColumn("_text", normalized(F.col("text"))).filter("_text <> ''")
    mic = finals.filter("source = 'mic'").select("meeting_id", "id", "start_ms", "end_ms", "_text")
    call = finals.filter("source = 'system'").select("meeting_id", F.col("id").alias("c_id"), F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), F.col("_text").alias("c_text"))
    sound = activity.filter(F.col("rms") >= QUIET_RMS).select("meeting_id", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    low = F.greatest(F.col("start_ms") - REACH_MS, F.lit(0))
    heard = overlap_join(mic, sound, ["meeting_id"], (low + 1, F.col("end_ms") - 1), (F.col("a_start"), F.col("a_end")), 10_000, "left_semi")
    near = overlap_join(heard, call, ["meeting_id"], (low, F.col("end_ms") + REACH_MS), (F.col("c_start"), F.col("c_end")), 10_000)
    joined = near.groupBy("meeting_id", "id", "_text").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_start", "c_id", "c_text"))), lambda x: x["c_text"]), " ").alias("_call"))
    return joined.filter(is_echo(F.col("_text"), F.col("_call"), LEAST_SCORE)).select("meeting_id", "id")


def without_echoes(segments: DataFrame, activity: DataFrame) -> DataFrame:
    """Segments with echoes blanked where partials had been shown, and dropped where not."""
    found = echoes(segments, activity).select(F.col("meeting_id").alias("_m"), F.col("id").alias("_i"), F.lit(True).alias("_echo"))
    shown = segments.filter("not is_final").select(F.col("meeting_id").alias("_pm"), F.col("id").alias("_pi"), F.lit(True).alias("_shown")).distinct()
    marked = segments.join(found, (segments.meeting_id == F.col("_m")) & (segments.id == F.col("_i")) & segments.is_final, "left")
    marked = marked.join(shown, (F.col("meeting_id") == F.col("_pm")) & (F.col("id") == F.col("_pi")), "left")
    kept = marked.filter("_echo is null or _shown")
    return kept.withColumn("text", F.when(F.col("_echo"), "").otherwise(F.col("text"))).select(*segments.columns)


def plain(text: str) -> str:
    """Lower-cased letters and digits, words by single blanks, ё as е."""
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower().replace("ё", "е")).strip()


def contained(part: str, whole: str) -> float:
    """The share of the first text's trigrams that the second has."""
    grams = lambda t: Counter(f" {t} "[i : i + 3] for i in range(len(t)))
    mine = grams(part)
    return sum((mine & grams(whole)).values()) / max(sum(mine.values()), 1)


def repeats(mic: str, call: str) -> bool:
    """The text rule of ``is_echo`` on normalised texts."""
    if not mic or not call:
        return False
    return mic in call.split() if " " not in mic else contained(mic, call) >= LEAST_SCORE


@dataclass
class Guard:
    """One meeting's hold-back state; every method gives the segments that may go on, in order."""

    held: deque = field(default_factory=deque)
    shown: dict = field(default_factory=dict)  # partials shown of the microphone: id -> latest end
    speaking: dict = field(default_factory=dict)  # open utterances of the call: id -> earliest start, latest end
    finals: list = field(default_factory=list)
    sounds: list = field(default_factory=list)
    newest: int = 0

    def forget(self, end: int) -> None:
        """Drop utterances without a final that ended long before the newest segment, so that the state stays bounded."""
        self.newest = max(self.newest, end)
        waiting = {s["id"] for s, _, _ in self.held}
        self.shown = {i: e for i, e in self.shown.items() if e >= self.newest - KEEP_MS or i in waiting}
        self.speaking = {i: x for i, x in self.speaking.items() if x[1] >= self.newest - KEEP_MS}

    def sound(self, start: int, end: int, rms: float, now: int) -> list[dict]:
        if rms >= QUIET_RMS:
            if self.sounds and start <= self.sounds[-1][1] + 1:
                self.sounds[-1][1] = max(self.sounds[-1][1], end)
            else:
                self.sounds.append([start, end])
            self.sounds = [s for s in self.sounds if s[1] >= end - KEEP_MS]
        return self.judged(now)

    def segment(self, s: dict, now: int) -> list[dict]:
        text = plain(s["text"])
        self.forget(s["end_ms"])
        if s["source"] == "system":
            if s["is_final"]:
                self.speaking.pop(s["id"], None)
                if text:
                    self.finals.append((s["start_ms"], s["end_ms"], text))
                    self.finals = [f for f in self.finals if f[1] >= s["end_ms"] - KEEP_MS]
            else:
                start, end = self.speaking.get(s["id"], (s["start_ms"], s["end_ms"]))
                self.speaking[s["id"]] = min(s["start_ms"], start), max(s["end_ms"], end)
            return [s, *self.judged(now)]
        if not s["is_final"]:
            self.shown[s["id"]] = max(s["end_ms"], self.shown.get(s["id"], 0))
            return [s]
        if not text:
            self.shown.pop(s["id"], None)
            return [s]
        self.held.append((s, text, now + HOLD_MS))
        return self.judged(now)

    def judged(self, now: int, finishing: bool = False) -> list[dict]:
        """Judges the oldest held final until one must wait."""
        out = []
        while self.held:
            s, text, deadline = self.held[0]
            verdict = self.verdict(s, text, finishing or now >= deadline)
            if verdict is None:
                break
            self.held.popleft()
            was_shown = self.shown.pop(s["id"], None) is not None
            if verdict:
                out.append(s)
            elif was_shown:
                out.append({**s, "text": ""})
        return out

    def verdict(self, s: dict, text: str, last: bool) -> bool | None:
        low, high = max(s["start_ms"] - REACH_MS, 0), s["end_ms"] + REACH_MS
        near = [a for a in self.sounds if a[0] < s["end_ms"] and a[1] > low]
        if not near:
            return True
        if repeats(text, " ".join(t for a, b, t in sorted(self.finals) if a <= high and b >= low)):
            return False
        if last or not (any(a <= high for a, _ in self.speaking.values()) or any(self.untold(max(a, low), min(b, s["end_ms"])) for a, b in near)):
            return True
        return None

    def untold(self, start: int, end: int) -> bool:
        """Whether the call's finals, somewhat wider, leave a long part of a sound without text."""
        at = start
        for a, b, _ in sorted(self.finals):
            if a - SLACK_MS - at > LEAST_GAP_MS and a - SLACK_MS < end:
                return True
            at = max(at, b + SLACK_MS)
        return end - at > LEAST_GAP_MS


def replay(events: pd.DataFrame) -> pd.DataFrame:
    """One meeting's log (arrival_ms, kind audio or segment, and both kinds' columns) through the guard, and its end."""
    guard, out = Guard(), []
    for e in events.sort_values("arrival_ms", kind="stable").to_dict("records"):
        got = guard.sound(e["start_ms"], e["end_ms"], e["rms"], e["arrival_ms"]) if e["kind"] == "audio" else guard.segment(e, e["arrival_ms"])
        out += [{**s, "emitted_ms": e["arrival_ms"]} for s in got]
    end = int(events.arrival_ms.max()) if len(events) else 0
    out += [{**s, "emitted_ms": end} for s in guard.judged(end, True)]
    columns = ["meeting_id", "id", "source", "start_ms", "end_ms", "text", "is_final", "emitted_ms"]
    return pd.DataFrame(out, columns=[*columns, *({c for r in out for c in r} - set(columns))])[columns]


def held_back(events: DataFrame) -> DataFrame:
    """The segments that leave the guard, replayed meeting by meeting."""
    kind = dict(events.dtypes)["meeting_id"]
    return events.groupBy("meeting_id").applyInPandas(replay, f"meeting_id {kind}, id string, source string, start_ms long, end_ms long, text string, is_final boolean, emitted_ms long")
