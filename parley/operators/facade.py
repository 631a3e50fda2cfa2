"""The meeting library: append-only Parquet logs below a folder, and the calls of an application on them.

Nothing is updated in place: a call appends rows with a sequence number, and reads are the views of
``parley.operators.store`` over the logs, so concurrent readers see whole writes only. A sequence number is
the time, or one more than the log's last where the clock went back; so writes of one writer keep their order,
and of writers at once on several machines the later by their clocks wins.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.display import iso_seconds
from parley.functions.text import clean, default_name, is_blank
from parley.operators import store

SCHEMAS = {
    "meetings": "id string, title string, context string, started_at string, ended_at string, _seq long",
    "ends": "id string, ended_at string, _seq long",
    "deleted": "id string, _seq long",
    "segments": "meeting_id string, id string, source string, speaker string, start_ms long, end_ms long, text string, is_final boolean, _seq long",
    "changes": "meeting_id string, segment_id string, speaker string, _seq long",
    "notes": "id string, meeting_id string, kind string, content string, trigger string, created_at string, _seq long",
    "names": "meeting_id string, label string, name string, _seq long",
    "embeddings": "meeting_id string, segment_id string, embedding array<float>, _seq long",
    "kv": "key string, value string, _seq long",
}
NOTE_KINDS = ("hint", "summary", "final")
SETTINGS = "settings"


class Meetings:
    """Calls on one library. A running meeting is the last one that was created and has no end."""

    def __init__(self, spark: SparkSession, folder: str, default_title: str = "Встреча"):
        self.spark, self.folder, self.default_title = spark, folder, default_title

    def _log(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, /, **row) -> None:
        fields = [f.split(" ")[0] for f in SCHEMAS[name].split(", ")]
        last = self._log(name).agg(F.max("_seq")).first()[0] or 0
        values = tuple(max(time.time_ns(), last + 1) if f == "_seq" else row.get(f) for f in fields)
        self.spark.createDataFrame([values], SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _now(self) -> str:
        return self.spark.range(1).select(iso_seconds(F.current_timestamp())).first()[0]

    def _meetings(self) -> DataFrame:
        kept = self._log("meetings").join(self._log("deleted").select("id").distinct(), "id", "left_anti")
        return store.ended_meetings(kept, self._log("ends"))

    def _children(self, name: str) -> DataFrame:
        return store.without_deleted(self._log(name), self._log("deleted"))

    def _segments(self) -> DataFrame:
        kept = store.stored_segments(self._children("segments"))
        last = store.latest(self._children("changes"), ["meeting_id", "segment_id"])
        return store.relabelled(kept, last)

    def create_meeting(self, title: str = "", context: str = "") -> str:
        """A new meeting's id; an empty title gets the default one."""
        meeting_id = str(uuid.uuid4())
        self._append("meetings", id=meeting_id, title=title.strip() or self.default_title, context=context, started_at=self._now())
        return meeting_id

    def end_meeting(self, meeting_id: str) -> None:
        """The first end counts."""
        self._append("ends", id=meeting_id, ended_at=self._now())

    def running(self) -> str | None:
        last = self._meetings().orderBy(F.desc("_seq")).first()
        return last.id if last and last.ended_at is None else None

    def delete_meeting(self, meeting_id: str) -> None:
        """The meeting and all that belongs to it; the running one cannot be deleted."""
        if self.running() == meeting_id:
            raise ValueError("a running meeting cannot be deleted")
        self._append("deleted", id=meeting_id)

    def save_segment(self, meeting_id: str, **segment) -> None:
        """Only finals with text are kept; the last write of an id wins."""
        self._append("segments", meeting_id=meeting_id, **segment)

    def set_speakers(self, meeting_id: str, changes: dict[str, str | None]) -> None:
        for segment_id, speaker in changes.items():
            self._append("changes", meeting_id=meeting_id, segment_id=segment_id, speaker=speaker)

    def rename_speaker(self, meeting_id: str, label: str, name: str) -> None:
        """An empty name takes the custom one away."""
        self._append("names", meeting_id=meeting_id, label=label, name=name)

    def save_note(self, meeting_id: str, kind: str, content: str, trigger: str | None = None) -> str:
        if kind not in NOTE_KINDS:
            raise ValueError(f"a note's kind is one of {', '.join(NOTE_KINDS)}")
        note_id = str(uuid.uuid4())
        self._append("notes", id=note_id, meeting_id=meeting_id, kind=kind, content=content, trigger=trigger, created_at=self._now())
        return note_id

    def save_embedding(self, meeting_id: str, segment_id: str, embedding: list[float]) -> None:
        self._append("embeddings", meeting_id=meeting_id, segment_id=segment_id, embedding=embedding)

    def embeddings(self, meeting_id: str) -> DataFrame:
        """segment_id, embedding: the last one of each segment."""
        own = self._children("embeddings").filter(F.col("meeting_id") == meeting_id)
        return store.latest(own, ["meeting_id", "segment_id"]).select("segment_id", "embedding")

    def list_meetings(self) -> DataFrame:
        return store.list_meetings(self._meetings())

    def list_speakers(self, meeting_id: str) -> DataFrame:
        """label, name, segment_count, talk_ms of a meeting, most talk first."""
        mine = F.col("meeting_id") == meeting_id
        found = store.list_speakers(self._segments().filter(mine), store.renamed_speakers(self._children("names").filter(mine)))
        return found.drop("meeting_id").orderBy(F.desc("talk_ms"), "label")

    def get_meeting(self, meeting_id: str) -> DataFrame:
        """The meeting with its segments, notes and speakers nested; no row if there is none."""
        mine = F.col("meeting_id") == meeting_id
        segments = self._segments().filter(mine)
        speakers = store.list_speakers(segments, store.renamed_speakers(self._children("names").filter(mine)))
        return store.get_meetings(self._meetings().filter(F.col("id") == meeting_id), segments, self._children("notes").filter(mine), speakers)

    def set_value(self, key: str, value) -> None:
        self._append("kv", key=key, value=json.dumps(value, ensure_ascii=False))

    def value(self, key: str):
        """The last value of a key; None if there is none or it is null."""
        row = store.latest(self._log("kv").filter(F.col("key") == key), ["key"]).first()
        return json.loads(row.value) if row else None

    def save_settings(self, settings: dict) -> None:
        if not isinstance(settings, dict):
            raise ValueError("settings are one object")
        self.set_value(SETTINGS, settings)

    def settings(self, defaults: dict | None = None) -> dict:
        """Saved settings over defaults; unknown keys stay."""
        saved = self.value(SETTINGS)
        return {**(defaults or {}), **(saved if isinstance(saved, dict) else {})}

    def has_voiceprint(self) -> bool:
        return bool(self.value("voiceprint"))

    def enroll(self, embedding: list[float], voiced_ms: int, least_ms: int = 4_000) -> None:
        """Keeps a voiceprint of recorded speech that is long enough."""
        if voiced_ms < least_ms:
            raise ValueError("too little speech")
        self.set_value("voiceprint", embedding)

    def clear_voiceprint(self) -> None:
        self.set_value("voiceprint", None)

    def counts(self) -> DataFrame:
        """meeting_id and its rows in each log, deleted ones included."""
        parts = [self._log(n).groupBy(F.col("meeting_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("log", F.lit(n)) for n in ("segments", "notes", "names", "embeddings")]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union.groupBy("meeting_id").pivot("log", ["segments", "notes", "names", "embeddings"]).agg(F.sum("n")).fillna(0)

    def transcript(self, meeting_id: str) -> DataFrame:
        """id, start_ms, name, text of a meeting's segments in order, by custom or default names."""
        mine = F.col("meeting_id") == meeting_id
        names = store.renamed_speakers(self._children("names").filter(mine)).select(F.col("label").alias("speaker"), "name")
        joined = self._segments().filter(mine & ~is_blank(F.col("text"))).join(names, "speaker", "left")
        return joined.select("id", "start_ms", F.coalesce("name", default_name(F.col("speaker"))).alias("name"), clean(F.col("text")).alias("text")).orderBy("start_ms", "id")
