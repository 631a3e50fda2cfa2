"""Queries on recordings and requests of meetings, each with its SQL twin.

The events table is read as recordings, a user being a meeting, an event a piece of one of two sources or a
frame with levels of both; and as a meeting's log of lines, names and requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import conversation, delays, echo_path
from parley.session import table
from parley.streaming import alignment

#: Two minutes of the table are two samples, so that pieces touch, overlap and leave gaps.
SECONDS, STEP = 120, 2


def aligned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each meeting's microphone with sums of what it and the call gave in them."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    level = F.floor("value").cast("float")
    chunks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("meeting_id"),
        F.when(F.col("event_type").isin("view", "click"), "mic").otherwise("system").alias("source"),
        F.timestamp_micros((F.floor(seconds / SECONDS) * (STEP * 125 // 2)).cast("long")).alias("ts"),
        F.array_repeat(level, (F.lit(1) + F.floor("value") % 200).cast("int")).alias("samples"),
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")).cast("long")
    met = alignment.aligned_chunks(chunks)
    return met.select("meeting_id", "frame", "first", "n_real", total("samples").alias("mic_sum"), total("reference").alias("reference_sum"))


ALIGNED_FRAMES = """
WITH c AS (
  SELECT user_id AS m, event_type IN ('view', 'click') AS mic, CAST(floor(epoch(ts)) AS BIGINT) // 120 * 2 AS start,
         CAST(floor(value) AS BIGINT) AS v, 1 + CAST(floor(value) AS BIGINT) % 200 AS n
  FROM events
), s AS (SELECT m, mic, start + unnest(range(n)) AS p, start, v FROM c),
w AS (SELECT m, mic, p, arg_min(v, (start, v)) AS v FROM s GROUP BY m, mic, p),
f AS (SELECT m, mic, p // 160 AS frame, min(p % 160) AS first, count(*) AS n, sum(v) AS s FROM w GROUP BY m, mic, p // 160)
SELECT a.m AS meeting_id, a.frame, CAST(a.first AS INTEGER) AS first, CAST(a.n AS INTEGER) AS n_real, CAST(a.s AS BIGINT) AS mic_sum, CAST(coalesce(b.s, 0) AS BIGINT) AS reference_sum
FROM f a LEFT JOIN f b ON b.m = a.m AND b.frame = a.frame AND NOT b.mic WHERE a.mic
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each meeting's events as frames numbered from 0."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), place.alias("frame"), "event_id", "event_type", "value")


def echo_path_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each frame, whether the call reaches the microphone: off below a fifth of 20, on from a half of 6."""
    power = F.col("value") / 100
    proof = echo_path.evidence(F.lit(1.0), power, F.lit(0.0), F.when(F.col("event_type") != "error", 0.04))
    return echo_path.echo_paths(_frames(spark, sf_dir), ["meeting_id"], "frame", proof, window=20, least=8, off_below=0.2, recent=6, on_above=0.5, block=64).select("meeting_id", "frame", "coupled")


ECHO_PATH_STATES = """
WITH RECURSIVE f AS (
  SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         CASE WHEN event_type = 'error' OR value / 100 < 1e-8 THEN NULL WHEN value / 100 > 16 * CAST(0.04 AS DOUBLE) THEN true WHEN value / 100 < 4 * CAST(0.04 AS DOUBLE) THEN false END AS e
  FROM events
), g AS (
  SELECT m, frame, e, row_number() OVER w AS n, count_if(e) OVER (PARTITION BY m ORDER BY frame ROWS 19 PRECEDING) AS y20, count_if(e) OVER (PARTITION BY m ORDER BY frame ROWS 5 PRECEDING) AS y6
  FROM f WHERE e IS NOT NULL WINDOW w AS (PARTITION BY m ORDER BY frame)
), t AS (SELECT m, frame, n, NOT (least(n, 20) >= 8 AND y20 < 0.2 * least(n, 20)) AS if_on, y6 >= 3 AS if_off FROM g),
r AS (
  SELECT m, n, if_on AS state FROM t WHERE n = 1
  UNION ALL SELECT t.m, t.n, CASE WHEN r.state THEN t.if_on ELSE t.if_off END FROM r JOIN t ON t.m = r.m AND t.n = r.n + 1
), s AS (SELECT t.m, t.frame, r.state FROM t JOIN r USING (m, n))
SELECT f.m AS meeting_id, f.frame, coalesce(last_value(s.state IGNORE NULLS) OVER (PARTITION BY f.m ORDER BY f.frame), true) AS coupled FROM f LEFT JOIN s USING (m, frame)
"""


def echo_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags that stand out between two levels of each meeting, one the other's echo from five to seven frames before."""
    frames = _frames(spark, sf_dir)
    w = Window.partitionBy("meeting_id").orderBy("frame")
    far = F.least(F.col("value"), F.lit(45.0)) - 70
    echo = F.element_at(F.array(*[F.lag(far, k).over(w) for k in (5, 6, 7)]), (F.col("meeting_id") % 3 + 1).cast("int"))
    return delays.estimates(frames.withColumns({"far_db": far, "near_db": 0.8 * echo - 10}), ["meeting_id"], window=60, least=30, step=20, most_lag=12, group=100)


ECHO_DELAYS = """
WITH f AS (SELECT user_id AS m, row_number() OVER w - 1 AS frame, least(value, 45.0) - 70 AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, greatest(coalesce(0.8 * lag(far, CAST(5 + m % 3 AS INTEGER)) OVER (PARTITION BY m ORDER BY frame) - 10, -75.0), -75.0) AS near FROM f),
t AS (SELECT m, frame + 1 AS upto, least(frame + 1, 60, frame + 1 - 12) AS n FROM l WHERE (frame + 1) % 20 = 0 AND frame + 1 - 12 >= 30),
a AS (SELECT t.m, t.upto, count_if(l.far > -55) * 4 >= any_value(t.n) AS active FROM t JOIN l ON l.m = t.m AND l.frame < t.upto AND l.frame >= t.upto - 72 GROUP BY 1, 2),
c AS (
  SELECT t.m, t.upto, k.lag, covar_pop(x.far, y.near) AS cov, var_pop(x.far) AS vf, var_pop(y.near) AS vn
  FROM t CROSS JOIN (SELECT unnest(range(13)) AS lag) k JOIN l y ON y.m = t.m AND y.frame < t.upto AND y.frame >= t.upto - t.n JOIN l x ON x.m = t.m AND x.frame = y.frame - k.lag
  GROUP BY 1, 2, 3
), s AS (SELECT m, upto, lag, CASE WHEN vf < 1 THEN -1e9 ELSE cov / sqrt(vf * vn) END AS score FROM c JOIN a USING (m, upto) WHERE active AND vn >= 1),
b AS (SELECT m, upto, arg_max(lag, (score, lag)) AS lag, max(score) AS score FROM s GROUP BY 1, 2)
SELECT b.m AS meeting_id, upto - 1 AS frame, CAST(b.lag AS INTEGER) AS lag FROM b
WHERE score >= 0.4 AND score - coalesce((SELECT max(s.score) FROM s WHERE s.m = b.m AND s.upto = b.upto AND abs(s.lag - b.lag) > 8), -1e9) >= 0.08
"""

def request_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each meeting's requests the version they continue, and the lines and rename notes they add."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), (F.col("event_id") * 10).alias("at"), "event_id", "event_type", "value", F.floor("value").cast("long").alias("v"))
    label = lambda c: F.when(c, "sys:1").otherwise("sys:2")
    of = lambda kind: rows.filter(F.col("event_type") == kind)
    said = rows.filter(F.col("event_type").isin("view", "click"))
    segments = said.select("meeting_id", "at", F.col("event_id").cast("string").alias("id"), label(F.col("event_type") == "view").alias("label"), F.col("at").alias("start_ms"), F.col("event_type").alias("text"), F.lit(True).alias("is_final"))
    names = of("signup").select("meeting_id", "at", label(F.col("v") % 2 == 0).alias("label"), F.concat(F.lit("N"), F.col("v").cast("string")).alias("name"))
    relabels = of("error").select("meeting_id", "at", F.lit("none").alias("id"), F.lit("sys:3").alias("label"))
    kind = F.when(F.col("value") < 15, "fork").when(F.col("value") > 90, "rollover").otherwise("live")
    requests = of("purchase").select("meeting_id", F.col("event_id").alias("n"), "at", (F.col("at") + 5).alias("done_at"), kind.alias("kind"), (F.col("v") % 4 != 0).alias("ok"), F.lit("t").alias("task"), F.lit("r").alias("reply"), F.lit(None).cast("string").alias("summary"), F.lit(1 << 30).alias("most_chars"))
    found = conversation.request_counts(segments, names, relabels, requests, bucket=100_000)
    return found.select("meeting_id", "n", "kind", "parent", "epoch", "lines", "notes")


REQUEST_UPDATES = """
WITH e AS (SELECT user_id AS m, event_id * 10 AS tm, event_id, event_type AS t, value, CAST(floor(value) AS BIGINT) AS v FROM events),
s AS (SELECT m, tm, CASE t WHEN 'view' THEN 'sys:1' ELSE 'sys:2' END AS label FROM e WHERE t IN ('view', 'click')),
a AS (SELECT m, tm, CASE WHEN v % 2 = 0 THEN 'sys:1' ELSE 'sys:2' END AS label, 'N' || v AS name FROM e WHERE t = 'signup'),
q AS (SELECT m, tm, event_id AS n, CASE WHEN value < 15 THEN 'fork' WHEN value > 90 THEN 'rollover' ELSE 'live' END AS kind, v % 4 <> 0 AS ok FROM e WHERE t = 'purchase'),
c AS (SELECT m, tm, n, kind FROM q WHERE kind = 'rollover' OR (kind = 'live' AND ok)),
p AS (SELECT q.*, (SELECT max(c.tm) FROM c WHERE c.m = q.m AND c.tm < q.tm) AS parent_at, (SELECT count(*) FROM c WHERE c.m = q.m AND c.tm < q.tm AND c.kind = 'rollover') AS epoch FROM q),
f AS (SELECT s.m, s.label, min(c.tm) AS told_at FROM s JOIN c ON c.m = s.m AND c.tm >= s.tm GROUP BY s.m, s.label),
w AS (SELECT p.m, p.n, f.label,
        coalesce((SELECT arg_max(name, a.tm) FROM a WHERE a.m = p.m AND a.label = f.label AND a.tm <= p.parent_at), '') AS b,
        coalesce((SELECT arg_max(name, a.tm) FROM a WHERE a.m = p.m AND a.label = f.label AND a.tm <= p.tm), '') AS n2
      FROM p JOIN f ON f.m = p.m AND f.told_at <= p.parent_at WHERE p.kind <> 'rollover')
SELECT p.m AS meeting_id, p.n, p.kind, CAST(p.parent_at // 10 AS BIGINT) AS parent, p.epoch,
       (SELECT count(*) FROM s WHERE s.m = p.m AND s.tm <= p.tm AND (p.kind = 'rollover' OR s.tm > coalesce(p.parent_at, -1))) AS lines,
       (SELECT count(*) FROM w WHERE w.m = p.m AND w.n = p.n AND w.b <> w.n2) AS notes
FROM p
"""

QUERIES = {"request_updates": request_updates, "aligned_frames": aligned_frames, "echo_path_states": echo_path_states, "echo_delays": echo_delays}
ORACLES = {"request_updates": REQUEST_UPDATES, "aligned_frames": ALIGNED_FRAMES, "echo_path_states": ECHO_PATH_STATES, "echo_delays": ECHO_DELAYS}
