"""Queries on text: conversations read as transcripts, documents and benchmark as hypotheses and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import scoring, turns
from parley.session import table


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with white space collapsed, and their lengths."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean(F.col("text")).alias("text")).withColumn("n", F.length("text").cast("long"))


CLEAN_TEXTS = r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM conversations"


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts lower-cased with letters and digits only."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalized(F.col("text")).alias("text"))


NORMALIZED_TEXTS = r"SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')) AS text FROM conversations"


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of each role, by the Latin, Russian and Kazakh tokenizer."""
    words = table(spark, sf_dir, "conversations").select("role", F.explode(T.tokens(F.col("text"))).alias("w"))
    return words.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("w").alias("distinct_words"))


TOKEN_TOTALS = """
WITH w AS (SELECT role, unnest(regexp_split_to_array(replace(lower(text), 'ё', 'е'), '[^a-zа-яәғқңөұүһі0-9]+')) AS w FROM conversations)
SELECT role, count(*) AS n, count(DISTINCT w) AS distinct_words FROM w WHERE w <> '' GROUP BY role
"""


def echo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each turn's text is contained in the previous turn's, by trigrams of whole texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalized(F.col("text")).alias("t"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("p"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.containment(F.col("t"), F.col("p")), 9).alias("containment"))


ECHO_SCORES = r"""
WITH n AS (SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM conversations),
i AS (SELECT conv_id, turn, concat(' ', t, ' ') AS p, unnest(range(1, length(t) + 1)) AS i FROM n),
g AS (SELECT conv_id, turn, substr(p, i, 3) AS g, count(*) AS c FROM i GROUP BY ALL),
s AS (SELECT a.conv_id, a.turn, sum(least(a.c, coalesce(b.c, 0))) AS shared, sum(a.c) AS total
      FROM g a LEFT JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.g = b.g GROUP BY 1, 2)
SELECT n.conv_id, n.turn, round(coalesce(shared / total, 0), 9) AS containment
FROM n JOIN n p ON n.conv_id = p.conv_id AND p.turn = n.turn - 1 LEFT JOIN s ON s.conv_id = n.conv_id AND s.turn = n.turn
"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text of clocked lines, a turn every 41 seconds."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "role", "text", (F.col("turn") * 41_000).alias("start_ms"), F.col("turn").alias("id"))
    lines = turns.transcript_lines(rows, F.col("role"))
    return turns.text_of(lines, ["meeting_id"], ("start_ms", "id"), "line")


TRANSCRIPTS = """
SELECT conv_id AS meeting_id, string_agg(concat('[', lpad(CAST(turn * 41 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(turn * 41 % 60 AS VARCHAR), 2, '0'), '] ', role, ': ', trim(text, ' ')), chr(10) ORDER BY turn) AS text
FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id
"""


def budgeted_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns of each conversation within 1,500 characters and four lines; one at least."""
    rows = table(spark, sf_dir, "conversations")
    return turns.newest_within(rows, ["conv_id"], ("turn",), "text", 1500, 4).select("conv_id", "turn")


BUDGETED_SUFFIX = """
WITH c AS (SELECT conv_id, turn, row_number() OVER w AS r, sum(length(text) + 1) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn FROM c WHERE r = 1 OR (s <= 1500 AND r <= 4)
"""


def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus error rates by role, each whole turn taken as a hypothesis of the whole next one."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +"), lambda w: w != "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words.alias("hyp"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("hyp").alias("ref"))
    return scoring.error_rates(rows.join(nxt, ["conv_id", "turn"]), ["role"])


WORD_ERROR_RATE = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, row_number() OVER () AS k, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '') AS w FROM conversations
), pairs AS (
  SELECT row_number() OVER () AS p, a.role, coalesce(a.w, []) AS hyp, b.w AS ref FROM said a JOIN said b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE b.w IS NOT NULL
), d AS (
  SELECT p, 0 AS i, unnest(range(len(hyp) + 1)) AS j, unnest(range(len(hyp) + 1)) AS d FROM pairs
  UNION ALL
  SELECT p, i + 1, j, min(t - j) OVER (PARTITION BY p ORDER BY j) + j FROM (
    SELECT d.p, d.i, d.j, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.d + 1, d.before + CAST(q.hyp[d.j] <> q.ref[d.i + 1] AS INTEGER)) END AS t
    FROM (SELECT *, lag(d) OVER (PARTITION BY p ORDER BY j) AS before FROM d) d JOIN pairs q ON q.p = d.p AND d.i < len(q.ref)
  )
), e AS (
  SELECT role, len(ref) AS rw, d AS we, levenshtein(array_to_string(hyp, ' '), array_to_string(ref, ' ')) AS ce, length(array_to_string(ref, ' ')) AS rc
  FROM pairs JOIN d ON d.p = pairs.p AND d.i = len(ref) AND d.j = len(hyp)
)
SELECT role, CAST(sum(rw) AS BIGINT) AS ref_words, CAST(sum(we) AS BIGINT) AS word_errors, CAST(sum(ce) AS BIGINT) AS char_errors, round(sum(we) / sum(rw), 9) AS wer, round(sum(ce) / sum(rc), 9) AS cer FROM e GROUP BY role
"""


def text_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each role's texts, the shares with punctuation, capitals and digits, and the empty ones."""
    return scoring.text_fractions(table(spark, sf_dir, "conversations"), ["role"], "text")


TEXT_FRACTIONS = r"""
SELECT role, round(avg(CAST(regexp_matches(text, '[.,!?;:]') AS INTEGER)), 9) AS punctuation, round(avg(CAST(regexp_matches(text, '\p{Lu}') AS INTEGER)), 9) AS capitals,
       round(avg(CAST(regexp_matches(text, '\d') AS INTEGER)), 9) AS digits, count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS empty
FROM conversations GROUP BY role
"""


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each meeting, those of the call and the room numbered by their loudest event, with default names, numbers and order."""
    loudest = F.floor(F.max("value")).cast("long").cast("string")
    kind = F.when(F.col("event_type") == "signup", "me").when(F.col("event_type") == "purchase", "mic:").when(F.col("event_type") == "click", "sys:").when(F.col("event_type") == "error", "x")
    spoken = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), kind.alias("kind")).agg(loudest.alias("n"))
    labels = spoken.select("id", F.when(F.col("kind") == "me", "me").otherwise(F.concat("kind", "n")).alias("label"))
    return labels.select("id", "label", T.default_name(F.col("label")).alias("name"), T.label_number(F.col("label")).alias("number"), T.label_order(F.col("label"))["rank"].alias("rank"))


DISPLAY_NAMES = r"""
WITH s AS (SELECT user_id AS id, CASE event_type WHEN 'signup' THEN 'me' WHEN 'purchase' THEN 'mic:' WHEN 'click' THEN 'sys:' WHEN 'error' THEN 'x' END AS kind, CAST(floor(max(value)) AS BIGINT) AS n FROM events GROUP BY 1, 2),
l AS (SELECT id, CASE WHEN kind = 'me' THEN 'me' ELSE kind || CAST(n AS VARCHAR) END AS label FROM s)
SELECT id, label, CASE WHEN label IS NULL THEN '?' WHEN label = 'me' THEN 'Я' WHEN label LIKE 'sys:%' THEN concat('Участник ', label[5:]) WHEN label LIKE 'mic:%' THEN concat('Зал ', label[5:]) ELSE label END AS name,
       CASE WHEN label LIKE '%:%' THEN CAST(label[5:] AS BIGINT) END AS number,
       CASE WHEN label = 'me' THEN 0 WHEN label LIKE 'sys:%' THEN 1 WHEN label LIKE 'mic:%' THEN 2 WHEN label IS NOT NULL THEN 3 ELSE 4 END AS rank FROM l
"""


def talk_time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals read as milliseconds: clock and talk time labels."""
    ms = F.col("o_totalprice").cast("long") * 37
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clock(ms).alias("clock"), T.talk_time(ms).alias("talk"))


TALK_TIME_LABELS = """
WITH m AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) * 37 AS ms FROM orders), s AS (SELECT o_orderkey, ms // 1000 AS c, (ms + 500) // 1000 AS t FROM m)
SELECT o_orderkey,
  CASE WHEN c >= 3600 THEN concat(c // 3600, ':', lpad(CAST(c // 60 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(c % 60 AS VARCHAR), 2, '0')) ELSE concat(lpad(CAST(c // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(c % 60 AS VARCHAR), 2, '0')) END AS clock,
  CASE WHEN t < 60 THEN concat(t, ' с') WHEN t < 3600 THEN concat(t // 60, ' мин ', lpad(CAST(t % 60 AS VARCHAR), 2, '0'), ' с') ELSE concat(t // 3600, ' ч ', lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0'), ' мин') END AS talk
FROM s
"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and quotes of the benchmark texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.slug(F.col("text")).alias("slug"), T.quote(F.col("text"), 50).alias("quote"))


SLUGS = r"""
SELECT item_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'meeting') AS slug,
       CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 49), '…') ELSE text END AS quote FROM benchmark
"""

NAMED = ["clean_texts", "normalized_texts", "token_totals", "echo_scores", "word_error_rate", "transcripts", "budgeted_suffix", "text_fractions", "display_names", "talk_time_labels", "slugs"]
QUERIES = {n: globals()[n] for n in NAMED}
ORACLES = {n: globals()[n.upper()] for n in NAMED}
