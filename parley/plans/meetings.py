"""Queries on meetings: the events table read as labelled segments, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import intervals, ranks, store, turns
from parley.session import table

#: events as segments: a user is a meeting, a type is a speaker (view: none), the value a duration.
SEGMENTS_SQL = """
segments AS (
  SELECT user_id AS meeting_id, concat('e-', CAST(event_id AS VARCHAR)) AS id,
         CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS source,
         CASE event_type WHEN 'click' THEN 'sys:1' WHEN 'error' THEN 'sys:2' WHEN 'purchase' THEN 'mic:1' WHEN 'signup' THEN 'me' END AS speaker,
         CAST(epoch_us(ts) // 1000 AS BIGINT) AS start_ms,
         CAST(epoch_us(ts) // 1000 AS BIGINT) + CAST(round(value * 100000) AS BIGINT) AS end_ms,
         event_type AS text, event_id AS _seq
  FROM events
)
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as segments (see ``SEGMENTS_SQL``)."""
    kind, ms = F.col("event_type"), F.unix_millis(F.col("ts").cast("timestamp"))
    speaker = F.when(kind == "click", "sys:1").when(kind == "error", "sys:2").when(kind == "purchase", "mic:1").when(kind == "signup", "me")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("meeting_id"),
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system").alias("source"),
        speaker.alias("speaker"),
        ms.alias("start_ms"),
        (ms + F.round(F.col("value") * 100000).cast("long")).alias("end_ms"),
        kind.alias("text"),
        F.col("event_id").alias("_seq"),
        F.lit(True).alias("is_final"),
    )


def _names(spark: SparkSession) -> DataFrame:
    """A few names: one without segments, and labels without a name."""
    return spark.createDataFrame([("sys:1", "Anna"), ("mic:1", "Boris"), ("sys:9", "Clara")], "label string, name string")


NAMES_SQL = "names AS (SELECT * FROM (VALUES ('sys:1', 'Anna'), ('mic:1', 'Boris'), ('sys:9', 'Clara')) t(label, name))"
RUNS_SQL = """
changed AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS c
  FROM segments WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, id)
), turned AS (SELECT *, sum(c) OVER (PARTITION BY meeting_id ORDER BY start_ms, id) AS run FROM changed)
"""
STATS_SQL = """
stats AS (
  SELECT meeting_id, speaker AS label, CAST(sum(greatest(end_ms - start_ms, 0)) AS BIGINT) AS talk_ms,
         count(DISTINCT run) AS turns, count(*) AS segments, min(start_ms) AS first_ms
  FROM turned GROUP BY meeting_id, speaker
)
"""


def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk time, turns and names of each meeting's speakers, the flagship query."""
    named = turns.speaker_stats(segments(spark, sf_dir)).join(F.broadcast(_names(spark)), "label", "left")
    return turns.share_of_most(named).withColumn("share", F.round("share", 9)).select("meeting_id", "label", "name", "talk_ms", "turns", "segments", "first_ms", "share")


SPEAKER_STATS = f"""
WITH {SEGMENTS_SQL}, {NAMES_SQL}, {RUNS_SQL}, {STATS_SQL}
SELECT meeting_id, label, name, talk_ms, turns, segments, first_ms,
       round(talk_ms / CAST(greatest(max(talk_ms) OVER (PARTITION BY meeting_id), 1) AS DOUBLE), 9) AS share
FROM stats LEFT JOIN names USING (label)
"""


def list_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with segments or names, with counts and talk time."""
    rows = segments(spark, sf_dir)
    names = rows.select("meeting_id").distinct().crossJoin(F.broadcast(_names(spark)))  # three rows
    return store.list_speakers(rows, names)


LIST_SPEAKERS = f"""
WITH {SEGMENTS_SQL}, {NAMES_SQL}, n AS (SELECT DISTINCT meeting_id, label, name FROM segments, names),
u AS (
  SELECT meeting_id, speaker AS label, CAST(NULL AS VARCHAR) AS name, count(*) AS c, sum(end_ms - start_ms) AS t FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT meeting_id, label, name, 0, 0 FROM n
)
SELECT meeting_id, label, max(name) AS name, CAST(sum(c) AS BIGINT) AS segment_count, CAST(sum(t) AS BIGINT) AS talk_ms FROM u GROUP BY meeting_id, label
"""


def last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose ids repeat (one per speaker here): the last write wins."""
    log = segments(spark, sf_dir).withColumn("id", F.coalesce("speaker", F.lit("none")))
    return store.stored_segments(log).select("meeting_id", "id", "start_ms", "end_ms", "text", "_seq")


LAST_WRITTEN = f"""
WITH {SEGMENTS_SQL}, l AS (SELECT *, coalesce(speaker, 'none') AS k FROM segments)
SELECT meeting_id, k AS id, start_ms, end_ms, text, _seq FROM l
QUALIFY row_number() OVER (PARTITION BY meeting_id, k ORDER BY _seq DESC) = 1
"""


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last name per speaker from a rename log; an empty one removes it."""
    log = segments(spark, sf_dir).filter("speaker is not null").select("meeting_id", F.col("speaker").alias("label"), F.when(F.col("_seq") % 3 == 0, "  ").otherwise(F.concat("source", F.lit(" "), "text")).alias("name"), "_seq")
    return store.renamed_speakers(log).select("meeting_id", "label", "name")


RENAMED = f"""
WITH {SEGMENTS_SQL}, l AS (
  SELECT meeting_id, speaker AS label, CASE WHEN _seq % 3 = 0 THEN '  ' ELSE concat(source, ' ', text) END AS name, _seq FROM segments WHERE speaker IS NOT NULL
), t AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, label ORDER BY _seq DESC) AS r FROM l)
SELECT meeting_id, label, trim(name) AS name FROM t WHERE r = 1 AND trim(name) <> ''
"""


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers after a change table that also sets some to null."""
    rows = segments(spark, sf_dir)
    changes = rows.filter("_seq % 7 = 0").select("meeting_id", F.col("id").alias("segment_id"), F.when(F.col("_seq") % 2 == 0, "sys:5").alias("speaker"))
    return store.relabelled(rows, changes).groupBy("meeting_id", "speaker").agg(F.count(F.lit(1)).alias("n"))


RELABELLED = f"""
WITH {SEGMENTS_SQL}
SELECT meeting_id, CASE WHEN _seq % 7 = 0 THEN CASE WHEN _seq % 2 = 0 THEN 'sys:5' END ELSE speaker END AS speaker, count(*) AS n FROM segments GROUP BY 1, 2
"""


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments left per meeting after the meetings divisible by three are deleted."""
    rows = segments(spark, sf_dir)
    gone = rows.filter("meeting_id % 3 = 0").select(F.col("meeting_id").alias("id")).distinct()
    return store.without_deleted(rows, gone).groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"))


CASCADE = f"WITH {SEGMENTS_SQL} SELECT meeting_id, count(*) AS n FROM segments WHERE meeting_id % 3 <> 0 GROUP BY meeting_id"


def previous_same_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row before, if of the same speaker and within six hours."""
    return turns.previous_of_same_speaker(segments(spark, sf_dir), 6 * 3_600_000).filter("previous_text is not null").select("meeting_id", "id", "previous_text")


PREVIOUS_SAME_SPEAKER = f"""
WITH {SEGMENTS_SQL}, k AS (SELECT *, coalesce(speaker, concat('?', source)) AS k FROM segments), l AS (
  SELECT *, lag(k) OVER w AS pk, lag(end_ms) OVER w AS pe, lag(text) OVER w AS previous_text FROM k WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, id)
)
SELECT meeting_id, id, previous_text FROM l WHERE pk = k AND start_ms - pe <= 21600000
"""


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after which nobody speaks for twelve hours."""
    return turns.unanswered(segments(spark, sf_dir), 12 * 3_600_000).select("meeting_id", "id", "end_ms")


SILENCES = f"""
WITH {SEGMENTS_SQL}, l AS (SELECT *, lead(start_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, id) AS n FROM segments)
SELECT meeting_id, id, end_ms FROM l WHERE n IS NULL OR n - end_ms >= 43200000
"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphone segments and the call's that meet them, six hours to either side."""
    rows = segments(spark, sf_dir)
    mic = rows.filter("source = 'mic'").select("meeting_id", "id", "start_ms", "end_ms")
    call = rows.filter("source = 'system'").select("meeting_id", F.col("id").alias("call_id"), F.col("start_ms").alias("call_start"), F.col("end_ms").alias("call_end"))
    wide = 6 * 3_600_000
    found = intervals.overlap_join(mic, call, ["meeting_id"], (F.col("start_ms") - wide, F.col("end_ms") + wide), (F.col("call_start"), F.col("call_end")), 12 * 3_600_000)
    return found.select("meeting_id", "id", "call_id")


OVERLAPS = f"""
WITH {SEGMENTS_SQL}
SELECT a.meeting_id, a.id, b.id AS call_id FROM segments a JOIN segments b ON a.meeting_id = b.meeting_id AND a.source = 'mic' AND b.source = 'system'
WHERE b.start_ms <= a.end_ms + 21600000 AND b.end_ms >= a.start_ms - 21600000
"""


def active_mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphone segments that some segment of the call meets (semi join)."""
    rows = segments(spark, sf_dir)
    mic = rows.filter("source = 'mic'").select("meeting_id", "id", "start_ms", "end_ms")
    call = rows.filter("source = 'system'").select("meeting_id", F.col("start_ms").alias("call_start"), F.col("end_ms").alias("call_end"))
    # half-open and strict: closed intervals of whole milliseconds, one shorter
    return intervals.overlap_join(mic, call, ["meeting_id"], (F.col("start_ms"), F.col("end_ms") - 1), (F.col("call_start"), F.col("call_end") - 1), 600_000, "left_semi")


ACTIVE_MIC = f"""
WITH {SEGMENTS_SQL}
SELECT meeting_id, id, start_ms, end_ms FROM segments a WHERE source = 'mic' AND EXISTS (
  SELECT 1 FROM segments b WHERE b.source = 'system' AND a.meeting_id = b.meeting_id AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms
    AND a.start_ms < a.end_ms AND b.start_ms < b.end_ms)
"""


def merged_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of a meeting within six hours, as one span."""
    return intervals.merged(segments(spark, sf_dir), ["meeting_id"], touch=6 * 3_600_000).select("meeting_id", "start_ms", "end_ms")


MERGED_ACTIVITY = f"""
WITH {SEGMENTS_SQL}, r AS (
  SELECT *, max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments
), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms) AS k FROM r)
SELECT meeting_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY meeting_id, k
"""


def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every click, the last purchase of the meeting before it."""
    rows = segments(spark, sf_dir)
    anchors = rows.filter("text = 'purchase'").select("meeting_id", "start_ms", F.col("id").alias("anchor_id"))
    clicks = rows.filter("text = 'click'").select("meeting_id", "start_ms", "id")
    return intervals.as_of(clicks, anchors, ["meeting_id"], "start_ms", ["anchor_id"]).select("meeting_id", "id", "anchor_id")


AS_OF_PURCHASE = f"""
WITH {SEGMENTS_SQL}
SELECT c.meeting_id, c.id, p.id AS anchor_id FROM (SELECT * FROM segments WHERE text = 'click') c
ASOF LEFT JOIN (SELECT * FROM segments WHERE text = 'purchase') p ON c.meeting_id = p.meeting_id AND c.start_ms >= p.start_ms
"""


def near_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that have a click of the meeting within two hours (tolerance match)."""
    rows = segments(spark, sf_dir).select("meeting_id", "id", "start_ms", "text")
    errors = rows.filter("text = 'error'").select("meeting_id", "id", "start_ms")
    return intervals.matched_within(errors, rows.filter("text = 'click'"), ["meeting_id"], "start_ms", 2 * 3_600_000)


NEAR_EVENTS = f"""
WITH {SEGMENTS_SQL}
SELECT meeting_id, id, start_ms FROM segments a WHERE text = 'error' AND EXISTS (
  SELECT 1 FROM segments b WHERE b.text = 'click' AND a.meeting_id = b.meeting_id AND abs(a.start_ms - b.start_ms) <= 7200000)
"""


def uncovered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphone segments that the call's, a minute wider, do not cover but for ten seconds."""
    rows = segments(spark, sf_dir)
    spans = rows.filter("source = 'mic'").select("meeting_id", F.col("id").alias("span_id"), "start_ms", "end_ms")
    return intervals.uncovered(spans, rows.filter("source = 'system'"), ["meeting_id"], 60_000, 10_000, 3_600_000).select("meeting_id", "span_id")


UNCOVERED_SPANS = f"""
WITH {SEGMENTS_SQL}, a AS (SELECT * FROM segments WHERE source = 'mic'), b AS (SELECT meeting_id, start_ms - 60000 AS s, end_ms + 60000 AS e FROM segments WHERE source = 'system'),
met AS (SELECT a.meeting_id, a.id, a.start_ms, a.end_ms, s, e FROM a JOIN b ON a.meeting_id = b.meeting_id AND b.s <= a.end_ms AND b.e >= a.start_ms),
g AS (SELECT *, s - coalesce(max(e) OVER (PARTITION BY meeting_id, id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms) AS gap FROM met),
w AS (SELECT meeting_id, id, greatest(max(gap), max(end_ms) - max(e)) AS worst FROM g GROUP BY meeting_id, id)
SELECT a.meeting_id, a.id AS span_id FROM a LEFT JOIN w USING (meeting_id, id) WHERE coalesce(worst, a.end_ms - a.start_ms) > 10000
"""


def level_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of every ten values of a user, in order."""
    found = turns.count_windows(table(spark, sf_dir, "events"), ["user_id"], ("ts", "event_id"), "value", 10)
    return found.withColumn("rms", F.round("rms", 6))


LEVEL_WINDOWS = """
WITH n AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS w FROM events)
SELECT user_id, CAST(w AS BIGINT) AS "window", round(sqrt(sum(value * value) / 10), 6) AS rms FROM n GROUP BY user_id, w HAVING count(*) = 10
"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-rank 90th percentile of each user's values."""
    return ranks.percentiles(table(spark, sf_dir, "events"), ["user_id"], "value", {"p90": 0.9})


LATENCY_PERCENTILES = """
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, value AS p90 FROM n WHERE r = floor((c - 1) * 0.9 + 0.5) + 1
"""


def newest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest segments of each meeting."""
    return store.newest(segments(spark, sf_dir), ["meeting_id"], 5, F.desc("start_ms"), F.desc("id")).select("meeting_id", "id")


NEWEST_SEGMENTS = f"""
WITH {SEGMENTS_SQL}
SELECT meeting_id, id FROM segments QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms DESC, id DESC) <= 5
"""


def meeting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each meeting with nested segments and speakers, as sizes and ends of the nested lists."""
    rows = segments(spark, sf_dir)
    meetings = rows.groupBy(F.col("meeting_id").alias("id")).agg(F.min("start_ms").alias("started"))
    notes = rows.filter("text = 'signup'").select("meeting_id", F.col("start_ms").alias("created_at"), "_seq", F.col("text").alias("content"))
    speakers = store.list_speakers(rows, F.broadcast(_names(spark)).withColumn("meeting_id", F.lit(-1).cast("long"))).filter("meeting_id >= 0")
    nested = store.get_meetings(meetings, rows, notes, speakers)
    return nested.select("id", F.size("segments").cast("long").alias("n_segments"), F.coalesce(F.size("notes"), F.lit(0)).cast("long").alias("n_notes"), F.element_at("segments", 1)["id"].alias("first_id"), F.element_at("segments", -1)["id"].alias("last_id"), F.get("speakers", F.lit(0))["label"].alias("top_label"))


MEETING_DOCUMENTS = f"""
WITH {SEGMENTS_SQL}, t AS (SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id ORDER BY sum(end_ms - start_ms) DESC, speaker) AS r FROM segments WHERE speaker IS NOT NULL GROUP BY meeting_id, speaker)
SELECT s.meeting_id AS id, count(*) AS n_segments, count(*) FILTER (WHERE text = 'signup') AS n_notes,
       arg_min(s.id, (start_ms, s.id)) AS first_id, arg_max(s.id, (start_ms, s.id)) AS last_id, max(t.speaker) AS top_label
FROM segments s LEFT JOIN t ON t.meeting_id = s.meeting_id AND t.r = 1 GROUP BY s.meeting_id
"""

NAMED = ["speaker_stats", "list_speakers", "last_written", "renamed", "relabelled", "cascade", "previous_same_speaker", "silences", "overlaps", "active_mic", "merged_activity", "as_of_purchase", "near_events", "uncovered_spans", "level_windows", "latency_percentiles", "newest_segments", "meeting_documents"]
QUERIES = {n: globals()[n] for n in NAMED}
ORACLES = {n: globals()[n.upper()] for n in NAMED}
