"""The meeting store as logs and latest-by-key views.

Tables are append-only logs with a sequence column; what the store's statements update in place is
a view here. Keys are shuffled once per view, and a key's rows are bounded by its own updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import is_blank


def latest(log: DataFrame, keys: list[str], seq: str = "_seq") -> DataFrame:
    """The last row of each key (ties: the larger whole row), without a window: one partial aggregate."""
    rest = [c for c in log.columns if c not in keys and c != seq]
    return log.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_last")).select(*keys, "_last.*").select(*log.columns)


def stored_segments(log: DataFrame) -> DataFrame:
    """Finals with text; the last write of a (meeting_id, id) wins."""
    return latest(log.filter(F.col("is_final") & ~is_blank(F.col("text"))), ["meeting_id", "id"])


def renamed_speakers(log: DataFrame) -> DataFrame:
    """The last name of each (meeting_id, label); an empty last name removes it."""
    return latest(log, ["meeting_id", "label"]).withColumn("name", F.trim("name")).filter(F.col("name") != "")


def ended_meetings(meetings: DataFrame, ends: DataFrame) -> DataFrame:
    """Meetings with their first recorded end where they had none."""
    first = ends.groupBy(F.col("id").alias("_id")).agg(F.min("ended_at").alias("_ended"))
    joined = meetings.join(first, meetings.id == F.col("_id"), "left")
    return joined.withColumn("ended_at", F.coalesce("ended_at", "_ended")).select(*meetings.columns)


def without_deleted(children: DataFrame, deleted: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Cascade: children whose parent (``deleted`` has its id) is not deleted."""
    return children.join(deleted.select(F.col("id").alias("_gone")), children[key] == F.col("_gone"), "left_anti")


def relabelled(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Segments with changed speakers; a change to null counts, no change does not."""
    new = changes.select(F.col("meeting_id").alias("_m"), F.col("segment_id").alias("_s"), F.col("speaker").alias("_speaker"), F.lit(True).alias("_changed"))
    joined = segments.join(new, (segments.meeting_id == F.col("_m")) & (segments.id == F.col("_s")), "left")
    return joined.withColumn("speaker", F.when(F.col("_changed"), F.col("_speaker")).otherwise(F.col("speaker"))).select(*segments.columns)


def list_meetings(meetings: DataFrame) -> DataFrame:
    """Newest first; of one second, the later row first."""
    return meetings.orderBy(F.desc("started_at"), F.desc("_seq")).select("id", "title", "started_at", "ended_at")


def list_speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """meeting_id, label, name, segment_count, talk_ms: labels with segments and labels with names only."""
    spoken = segments.filter("speaker is not null").groupBy("meeting_id", F.col("speaker").alias("label")).agg(F.count(F.lit(1)).alias("segment_count"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))
    joined = spoken.join(names.select("meeting_id", "label", "name"), ["meeting_id", "label"], "full_outer")
    return joined.select("meeting_id", "label", "name", F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce("talk_ms", F.lit(0)).alias("talk_ms"))


def get_meetings(meetings: DataFrame, segments: DataFrame, notes: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each meeting with its segments, notes and speakers nested in their orders."""

    def nested(df: DataFrame, name: str, *order: Column) -> DataFrame:
        rest = [c for c in df.columns if c != "meeting_id"]
        ordered = F.sort_array(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))))
        return df.groupBy("meeting_id").agg(F.transform(ordered, lambda x: x["row"]).alias(name))

    out = meetings
    for df, name, order in ((segments, "segments", ("start_ms", "id")), (notes, "notes", ("created_at", "_seq")), (speakers, "speakers", None)):
        keys = [F.col(c) for c in order] if order else [-F.col("talk_ms"), F.col("label")]
        part = nested(df, name, *keys)
        out = out.join(part, out.id == part.meeting_id, "left").drop("meeting_id")
    return out


def latest_notes(notes: DataFrame) -> DataFrame:
    """The last note of each kind in a meeting, ties to the later row."""
    return notes.groupBy("meeting_id", "kind").agg(F.max(F.struct("created_at", "_seq", "content")).alias("_n")).select("meeting_id", "kind", "_n.content", "_n.created_at")


def newest(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in an order (Spark cuts groups before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")
