"""Queries on running meetings and what their screens print, each with its SQL twin.

The events table is read as a meeting's log: a user is a meeting, an event an arrival, and five
utterances of each meeting change again and again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import display, text as T, validation
from parley.operators import export, live, store, turns
from parley.plans.meetings import SEGMENTS_SQL, segments
from parley.session import table

LOG_SQL = f"""
{SEGMENTS_SQL}, log AS (
  SELECT meeting_id, concat('u-', CAST(_seq % 5 AS VARCHAR)) AS id, speaker, start_ms, end_ms,
         CASE WHEN _seq % 7 = 0 THEN '' ELSE text END AS text, _seq % 4 = 0 AS is_final, _seq FROM segments
)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("_seq")
    rows = segments(spark, sf_dir).withColumn("id", F.concat(F.lit("u-"), (seq % 5).cast("string")))
    return rows.withColumn("text", F.when(seq % 7 == 0, "").otherwise(F.col("text"))).withColumn("is_final", seq % 4 == 0).select("meeting_id", "id", "speaker", "start_ms", "end_ms", "text", "is_final", "_seq")


def live_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first final with text of each utterance."""
    return live.finals(_log(spark, sf_dir)).select("meeting_id", "id", "text", "_seq")


LIVE_FINALS = f"""
WITH {LOG_SQL}
SELECT meeting_id, id, text, _seq FROM log WHERE is_final AND text <> '' QUALIFY row_number() OVER (PARTITION BY meeting_id, id ORDER BY _seq) = 1
"""


def live_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last partial of each utterance that no final followed."""
    return live.open_partials(_log(spark, sf_dir)).select("meeting_id", "id", "text", "_seq")


LIVE_PARTIALS = f"""
WITH {LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, id ORDER BY _seq DESC) AS r FROM log)
SELECT meeting_id, id, text, _seq FROM l WHERE r = 1 AND NOT is_final AND text <> ''
"""


def shown_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partials that show other text than their utterance's last shown."""
    return live.changed_partials(_log(spark, sf_dir)).select("meeting_id", "id", "text", "_seq")


SHOWN_PARTIALS = f"""
WITH {LOG_SQL}, l AS (SELECT *, lag(text) OVER (PARTITION BY meeting_id, id ORDER BY _seq) AS p FROM log WHERE NOT is_final AND text <> '')
SELECT meeting_id, id, text, _seq FROM l WHERE p IS DISTINCT FROM text
"""


def session_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each meeting's latest end of what is shown."""
    return live.session_now(_log(spark, sf_dir))


SESSION_CLOCK = f"""
WITH {LOG_SQL}, f AS (SELECT meeting_id, end_ms FROM log WHERE is_final AND text <> '' QUALIFY row_number() OVER (PARTITION BY meeting_id, id ORDER BY _seq) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, id ORDER BY _seq DESC) AS r FROM log),
p AS (SELECT meeting_id, end_ms FROM l WHERE r = 1 AND NOT is_final AND text <> '')
SELECT meeting_id, greatest(max(end_ms), 0) AS now_ms FROM (SELECT * FROM f UNION ALL SELECT * FROM p) GROUP BY 1
"""


def unnamed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who spoke in each meeting and has no name; every other meeting has one."""
    rows = segments(spark, sf_dir)
    names = rows.filter("meeting_id % 2 = 0").select("meeting_id", F.lit("sys:1").alias("label")).distinct()
    return live.unnamed_labels(rows, names)


UNNAMED_LABELS = f"WITH {SEGMENTS_SQL} SELECT DISTINCT meeting_id, speaker AS label FROM segments WHERE speaker <> 'me' AND NOT (meeting_id % 2 = 0 AND speaker = 'sys:1')"


def recap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each meeting's last five days."""
    rows = segments(spark, sf_dir)
    now = rows.groupBy("meeting_id").agg(F.max("end_ms").alias("now_ms"))
    return live.recap_lines(rows.join(now, "meeting_id"), F.col("now_ms"), 5 * 1440).select("meeting_id", "id")


RECAP_LINES = f"WITH {SEGMENTS_SQL} SELECT meeting_id, id FROM segments QUALIFY start_ms >= max(end_ms) OVER (PARTITION BY meeting_id) - 5 * 86400000"


def mic_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each meeting (a day of one, here) was recorded in a room."""
    return live.mic_modes(segments(spark, sf_dir).withColumn("meeting_id", F.concat_ws("/", F.col("meeting_id"), F.floor(F.col("start_ms") / 86_400_000))))


MIC_MODES = f"WITH {SEGMENTS_SQL} SELECT concat_ws('/', meeting_id, start_ms // 86400000) AS meeting_id, CASE WHEN bool_or(coalesce(speaker LIKE 'mic:%', false)) THEN 'room' ELSE 'me' END AS mic_mode FROM segments GROUP BY 1"


def hint_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest thirty hints as cards."""
    seq = F.col("event_id")
    trigger = F.get(F.array(*map(F.lit, ["manual", "auto: why", "ask:  how ", "explain:", "translate", "recap: 15m"])), (seq % 7).cast("int"))
    notes = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.when(F.col("event_type") == "view", "summary").otherwise("hint").alias("kind"), trigger.alias("trigger"), F.col("event_type").alias("content"), seq.alias("created_at"), seq.alias("_seq"))
    return live.cards(notes)


HINT_CARDS = """
WITH n AS (SELECT user_id AS meeting_id, event_id % 7 AS k, event_type AS content, event_id AS created_at FROM events WHERE event_type <> 'view'),
p AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY created_at DESC) AS place FROM n)
SELECT meeting_id, CAST(place AS INTEGER) AS place,
  CASE k WHEN 2 THEN 'ask' WHEN 3 THEN 'explain' WHEN 4 THEN 'translate' WHEN 5 THEN 'recap' ELSE 'hint' END AS card,
  CASE k WHEN 0 THEN 'Что ответить?' WHEN 1 THEN 'Подсказка (авто)' WHEN 2 THEN 'Вопрос ассистенту' WHEN 3 THEN 'Объяснение' WHEN 4 THEN 'Перевод' WHEN 5 THEN 'Кратко: 15 мин' ELSE 'Подсказка' END AS label,
  CASE k WHEN 1 THEN 'why' WHEN 2 THEN 'how' END AS detail, k = 1 AS auto, content, created_at
FROM p WHERE place <= 30
"""


def without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments of their value in milliseconds, one letter of every third's type: short ones are cleared."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("start_ms"), F.floor(F.col("value") * 10).cast("long").alias("end_ms"), F.when(F.col("event_id") % 3 == 0, F.left("event_type", F.lit(1))).otherwise(F.col("event_type")).alias("text"))
    return live.without_noise(rows).select("event_id", "text")


WITHOUT_NOISE = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN floor(value * 10) < 800 THEN '' ELSE substr(event_type, 1, 1) END ELSE event_type END AS text FROM events"


def whole_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events at which the whole percent of progress rises."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") % 1000) / 1000).alias("share"))
    return live.whole_percents(rows, ["user_id"], "event_id", "share")


WHOLE_PERCENTS = """
WITH e AS (SELECT user_id, event_id, (event_id % 1000) / 1000 AS share FROM events),
p AS (SELECT *, max(floor(share * 100)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT user_id, event_id, share FROM p WHERE b IS NULL OR floor(share * 100) > b
"""


def device_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as listed devices: by kind, the default first, else as listed."""
    kind = F.when(F.col("event_type").isin("error", "signup"), "monitor").otherwise("input")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), (F.col("value") > 60).alias("is_default"))
    return live.device_order(rows, ["user_id"], "event_id").select("event_id", "place")


DEVICE_ORDER = "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type IN ('error', 'signup'), value <= 60, event_id) AS INTEGER) AS place FROM events"


def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that begin when lines ship, minutes to days long, as labels; some are open and some end before they begin."""
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    long = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_partkey") * 3_600_000).otherwise((F.col("l_quantity") * 100_000).cast("long") - 600_000)
    end = F.when(F.col("l_linenumber") != 3, F.timestamp_micros(us + long * 1000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", display.duration_label(F.col("l_shipdate"), end).alias("label"))


DURATION_LABELS = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN l_partkey * 3600000 ELSE CAST(l_quantity * 100000 AS BIGINT) - 600000 END END AS ms FROM lineitem),
m AS (SELECT *, CAST(floor(ms / 60000 + 0.5) AS BIGINT) AS m FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ms >= 0 THEN CASE WHEN m < 60 THEN concat(m, ' мин') ELSE concat(m // 60, ' ч ', m % 60, ' мин') END END AS label FROM m
"""


def count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as token counts of four sizes, and as costs."""
    n, k = F.floor(F.col("o_totalprice")), F.col("o_orderkey") % 4
    n = F.when(k == 0, n % 1000).when(k == 1, n % 10_000).when(k == 2, n).otherwise(n * 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", display.count_label(n).alias("tokens"), display.cost_label(F.col("o_totalprice") / 70_000 - 0.5).alias("cost"))


COUNT_LABELS = """
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t, o_totalprice / 70000 - 0.5 AS usd FROM orders),
n AS (SELECT o_orderkey, usd, CASE o_orderkey % 4 WHEN 0 THEN t % 1000 WHEN 1 THEN t % 10000 WHEN 2 THEN t ELSE t * 100 END AS n FROM o),
x AS (SELECT *, CASE WHEN n >= 1000000 THEN n / 1000000 ELSE n / 1000 END AS x FROM n)
SELECT o_orderkey,
  CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE concat(CASE WHEN x < 10 THEN replace(regexp_replace(printf('%.1f', round(x, 1)), '\\.0$', ''), '.', ',') ELSE CAST(CAST(round(x, 0) AS BIGINT) AS VARCHAR) END, CASE WHEN n >= 1000000 THEN 'M' ELSE 'K' END) END AS tokens,
  CASE WHEN usd <= 0 THEN '$0' WHEN usd < 0.01 THEN '<$0.01' WHEN usd < 10 THEN concat('$', printf('%.2f', usd)) ELSE concat('$', printf('%.1f', usd)) END AS cost
FROM x
"""


def meeting_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates with weekday, and as a sentence has them."""
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", display.meeting_date(at).alias("date"), display.date_and_time(at).alias("sentence"), display.iso_seconds(at).alias("iso"))


MEETING_DATES = """
SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%d'), ', ', ['воскресенье', 'понедельник', 'вторник', 'среда', 'четверг', 'пятница', 'суббота'][dayofweek(o_orderdate) + 1]) AS date,
  concat(day(o_orderdate), ' ', ['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'][month(o_orderdate)], ' в 00:00') AS sentence,
  concat(strftime(o_orderdate, '%Y-%m-%d'), 'T00:00:00Z') AS iso FROM orders
"""

_MODELS_SQL = """
m AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'haiku' WHEN 3 THEN 'fable' WHEN 4 THEN 'mythos' ELSE 'other' END AS family,
      p_partkey // 6 % 4 + 3 AS major, CASE WHEN p_partkey % 5 = 0 THEN 20250514 ELSE p_partkey % 9 END AS minor FROM part)
"""


def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context windows and abilities of model ids of all families."""
    key = F.col("p_partkey")
    family = F.element_at(F.array(*map(F.lit, ["opus", "sonnet", "haiku", "fable", "mythos", "other"])), (key % 6 + 1).cast("int"))
    minor = F.when(key % 5 == 0, F.lit(20250514)).otherwise(key % 9)
    model = F.concat(F.lit(" Claude-"), family, F.lit("-"), (F.floor(key / 6) % 4 + 3).cast("string"), F.lit("-"), minor.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", display.context_window(model).alias("window"), display.model_abilities(model).alias("a")).select("p_partkey", "window", "a.*")


MODEL_WINDOWS = f"""
WITH {_MODELS_SQL}, v AS (SELECT p_partkey, family, major * 10 + CASE WHEN minor >= 100 THEN 0 ELSE minor END AS v FROM m)
SELECT p_partkey, CASE WHEN family IN ('fable', 'mythos') OR (family IN ('opus', 'sonnet') AND v >= 46) THEN 1000000 ELSE 200000 END AS "window",
  CASE family WHEN 'opus' THEN v >= 46 WHEN 'sonnet' THEN v >= 46 WHEN 'haiku' THEN v >= 50 ELSE true END AS adaptive_thinking,
  CASE family WHEN 'opus' THEN v >= 45 WHEN 'sonnet' THEN v >= 46 WHEN 'haiku' THEN v >= 50 ELSE true END AS effort,
  CASE family WHEN 'opus' THEN v >= 47 WHEN 'sonnet' THEN v >= 50 WHEN 'haiku' THEN false ELSE true END AS very_high,
  CASE family WHEN 'opus' THEN v >= 50 WHEN 'fable' THEN v >= 51 WHEN 'mythos' THEN v >= 51 ELSE false END AS fallbacks,
  CASE family WHEN 'opus' THEN v >= 41 WHEN 'sonnet' THEN v >= 45 WHEN 'haiku' THEN v >= 45 ELSE true END AS schema
FROM v
"""


def request_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: budgets by route (the status), hint effort (the priority) and summary effort (the price)."""
    route = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "live").otherwise("fork")
    effort = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    budget = display.request_budget(route, effort, F.when(F.col("o_totalprice") > 250_000, "xhigh").otherwise("high"))
    return table(spark, sf_dir, "orders").select("o_orderkey", budget.alias("b")).select("o_orderkey", "b.*")


REQUEST_BUDGETS = """
WITH n AS (
  SELECT o_orderkey, o_orderstatus AS r, CASE o_orderpriority[1] WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS h, CASE WHEN o_totalprice > 250000 THEN 'xhigh' ELSE 'high' END AS s FROM orders
)
SELECT o_orderkey, CASE WHEN r = 'F' THEN s ELSE h END AS effort,
  CASE WHEN r = 'F' THEN CASE s WHEN 'xhigh' THEN 64000 ELSE 32000 END WHEN h = 'high' THEN 16000 WHEN h = 'medium' OR r <> 'O' THEN 12000 ELSE 8000 END AS max_tokens FROM n
"""


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text read as a list of names."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(display.names_in(F.col("text")), "|").alias("names"))


NAME_LISTS = r"""
WITH p AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[,;\n]')) AS x, generate_subscripts(regexp_split_to_array(text, '[,;\n]'), 1) AS i FROM conversations),
c AS (SELECT conv_id, turn, i, substr(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 40) AS x FROM p),
f AS (SELECT * FROM c WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(x) ORDER BY i) = 1),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 10)
SELECT c.conv_id, c.turn, coalesce(string_agg(t.x, '|' ORDER BY t.i), '') AS names FROM conversations c LEFT JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY 1, 2
"""


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as speaker names: folded, cleaned, with colours, and whether they hold Kazakh letters."""
    name = F.concat(F.lit("  Әйгерім  "), F.col("p_name"), F.lit(" ё "))
    name = F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.folded(name).alias("folded"), T.speaker_name(name).alias("cleaned"), T.palette_index(F.col("p_name")).alias("colour"), T.has_kazakh_letters(name).alias("kazakh"), T.plural(F.col("p_partkey"), "реплика", "реплики", "реплик").alias("turns"))


NAME_FORMS = r"""
WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN concat('  Әйгерім  ', p_name, ' ё ') ELSE p_name END AS name FROM part)
SELECT p_partkey, translate(lower(name), 'әғқңөұүһіё', 'агкноуухие') AS folded, rtrim(substr(trim(regexp_replace(name, '\s+', ' ', 'g')), 1, 40)) AS cleaned,
  CAST(list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 12 AS INTEGER) AS colour,
  regexp_matches(lower(name), '[әғқңөұүһі]') AS kazakh,
  CASE WHEN p_partkey % 10 = 1 AND p_partkey % 100 <> 11 THEN 'реплика' WHEN p_partkey % 10 BETWEEN 2 AND 4 AND p_partkey % 100 NOT BETWEEN 12 AND 14 THEN 'реплики' ELSE 'реплик' END AS turns FROM n
"""


def skipped_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replies, some of which say that there is nothing to say."""
    reply = F.concat(F.get(F.array(*map(F.lit, ["", "**SKIP** ", " skip. ", "Skipping ", "«SKIP» "])), (F.col("turn") % 5).cast("int")), F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.lit("no")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_skip(reply).alias("skipped"))


SKIPPED_REPLIES = r"""
WITH r AS (SELECT conv_id, turn, regexp_replace(trim(concat(['', '**SKIP** ', ' skip. ', 'Skipping ', '«SKIP» '][turn % 5 + 1], CASE WHEN conv_id % 2 = 0 THEN text ELSE 'no' END), ' '), '^[\s*_`"''«»“”.,:;!-]+', '') AS r FROM conversations)
SELECT conv_id, turn, length(r) <= 160 AND regexp_matches(r, '^(?i)skip\b') AS skipped FROM r
"""


def ended_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as meetings, ended by their first purchase."""
    rows = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    meetings = rows.select(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("ended_at")).distinct()
    return store.ended_meetings(meetings, rows.filter("event_type = 'purchase'").select(F.col("user_id").alias("id"), at.alias("ended_at")))


ENDED_MEETINGS = "SELECT user_id AS id, min(CASE WHEN event_type = 'purchase' THEN CAST(epoch_us(ts) AS VARCHAR) END) AS ended_at FROM events GROUP BY 1"


def meeting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as meetings, newest first; of one day, the later first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("string").alias("started_at"), F.lit(None).cast("string").alias("ended_at"), F.col("o_orderkey").alias("_seq"))
    return store.list_meetings(rows)


MEETING_LIST = "SELECT o_orderkey AS id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at, CAST(NULL AS VARCHAR) AS ended_at FROM orders"


def last_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as written again and again for a twentieth of the segments: the last of each."""
    rows = table(spark, sf_dir, "embeddings")
    segments_ = F.floor(F.lit(1) + F.col("vec_id") % 25).cast("long")
    last = store.latest(rows.select(F.lit(1).alias("meeting_id"), segments_.alias("segment_id"), "embedding", F.col("vec_id").alias("_seq")), ["meeting_id", "segment_id"])
    return last.select("segment_id", "_seq", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


LAST_EMBEDDINGS = "SELECT 1 + vec_id % 25 AS segment_id, max(vec_id) AS _seq, CAST(len(max_by(embedding, vec_id)) AS INTEGER) AS size, round(CAST(max_by(embedding, vec_id)[1] AS DOUBLE), 6) AS first FROM embeddings GROUP BY 1"


def meeting_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a Markdown document; every other one has a summary."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("id"), "role", "text", (F.col("turn") * 41_000).alias("start_ms"))
    meetings = rows.select(F.col("meeting_id").alias("id"), F.when(F.col("meeting_id") % 3 > 0, F.concat(F.lit("Call "), F.col("meeting_id").cast("string"))).otherwise("").alias("title"), F.lit("2026-09-27 14:05:00").alias("started_at")).distinct()
    kind = F.when(F.col("meeting_id") % 4 == 0, "final").otherwise("summary")
    notes = meetings.withColumnRenamed("id", "meeting_id").filter("meeting_id % 2 = 0").select("meeting_id", kind.alias("kind"), F.concat(F.lit(" sum of "), F.col("meeting_id").cast("string")).alias("content"), F.lit("t").alias("created_at"), F.lit(1).alias("_seq"))
    return export.meeting_markdown(meetings, rows, notes, F.col("role"))


MEETING_MARKDOWN = r"""
WITH t AS (SELECT conv_id AS id, string_agg(concat('[', lpad(CAST(turn * 41 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(turn * 41 % 60 AS VARCHAR), 2, '0'), '] ', role, ': ', trim(text, ' '), '  '), chr(10) ORDER BY turn) AS s
  FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1)
SELECT id, concat('# ', CASE WHEN id % 3 > 0 THEN concat('Call ', id) ELSE 'Встреча' END, chr(10), chr(10), '_27 сентября в 14:05_',
  CASE WHEN id % 4 = 0 THEN concat(chr(10), chr(10), 'sum of ', id) WHEN id % 2 = 0 THEN concat(chr(10), chr(10), '## Резюме по ходу встречи', chr(10), chr(10), 'sum of ', id) ELSE '' END,
  chr(10), chr(10), '## Расшифровка', chr(10), chr(10), s, chr(10)) AS text FROM t
"""


def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as sentences of eleven speakers: one each, without digits, of a fitting length, two speakers used before."""
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 11).alias("key"), "text", (F.length("text") / 15).alias("seconds"))
    used = rows.filter("key IN (3, 5)").select("key").distinct()
    return live.evaluation_set(rows, "key", "text", "seconds", 2.0, 500.0, used)


EVALUATION_SET = r"""
WITH r AS (SELECT item_id % 11 AS key, text, length(text) / 15 AS seconds FROM benchmark),
f AS (SELECT * FROM r WHERE NOT regexp_matches(text, '\d') AND seconds BETWEEN 2 AND 500 AND key NOT IN (3, 5)),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY text ORDER BY key) = 1)
SELECT key, text, seconds FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY text) = 1
"""


def runnable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as models that need their nations' files, of which some are there."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    needs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("model"), F.col("n_name").alias("path"), (F.col("n_nationkey") * 1_500_000).cast("long").alias("size"))
    return live.runnable(needs, nation.filter("n_regionkey = 1 OR n_nationkey % 3 = 0").select(F.col("n_name").alias("path")))


RUNNABLE_MODELS = """
SELECT r_name AS model, bool_and(n_regionkey = 1 OR n_nationkey % 3 = 0) AS available,
       CAST(ceil(coalesce(sum(n_nationkey * 1500000) FILTER (WHERE NOT (n_regionkey = 1 OR n_nationkey % 3 = 0)), 0) / 1e6) AS BIGINT) AS missing_mb
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
"""


def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click's region: the first error of its user, as a span of eight hours, that its middle lies in."""
    rows = segments(spark, sf_dir)
    regions = rows.filter("speaker = 'sys:2'").select("meeting_id", F.col("_seq").alias("n"), (F.col("_seq") % 3).alias("kind"), "start_ms", (F.col("start_ms") + 28_800_000).alias("end_ms"))
    return live.regions_of(rows.filter("speaker = 'sys:1'"), regions, ["meeting_id"], bucket=14_400_000).select("meeting_id", "id", "region")


REGION_KINDS = f"""
WITH {SEGMENTS_SQL}, c AS (SELECT meeting_id, id, (start_ms + end_ms) // 2 AS m FROM segments WHERE speaker = 'sys:1'),
r AS (SELECT meeting_id, _seq AS n, _seq % 3 AS kind, start_ms - 300 AS low, start_ms + 28800300 AS high FROM segments WHERE speaker = 'sys:2')
SELECT c.meeting_id, c.id, min_by(r.kind, r.n) AS region FROM c LEFT JOIN r ON c.meeting_id = r.meeting_id AND c.m BETWEEN r.low AND r.high GROUP BY 1, 2
"""


def weighted_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' mean totals by status, as one objective of each priority."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    found = live.weighted_objective(rows, {"F": 0.5, "O": 0.3, "P": 0.2}, "o_orderstatus", "v", ["o_orderpriority"])
    return found.withColumn("objective", F.round("objective", 4))


WEIGHTED_OBJECTIVE = """
WITH v AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.3 ELSE 0.2 END AS w, avg(o_totalprice) AS v FROM orders GROUP BY o_orderpriority, o_orderstatus)
SELECT o_orderpriority, round(sum(v * w) / sum(w), 4) AS objective FROM v GROUP BY 1
"""


def settings_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as settings: what does not fit in each, and the threads that repaired ones have."""
    v, kind = F.floor("value").cast("long"), F.col("event_type")
    mode = F.when(kind == "view", "me").when(kind == "click", "room").otherwise(kind)
    threads = F.when(v % 3 == 0, F.concat(F.lit('"'), v.cast("string"), F.lit('"'))).otherwise(v.cast("string"))
    keys = F.when(kind == "signup", "null").when(kind == "purchase", '{"hint":"Shift+A"}').otherwise('{"hint":"Ctrl+B"}')
    made = F.concat(F.lit('{"micMode":"'), mode, F.lit('","numThreads":'), threads, F.lit(',"captureMic":'), F.when(kind == "error", '"yes"').otherwise("true"), F.lit(',"hotkeys":'), keys, F.lit("}"))
    json = F.when(v % 50 == 0, "[1]").when(v % 51 == 0, "oops").otherwise(made)
    rows = table(spark, sf_dir, "events").select("event_id", json.alias("json"))
    listed = F.array_join(F.transform(validation.problems(F.col("json")), lambda p: F.concat_ws("=", p["path"], p["problem"])), ";")
    return rows.select("event_id", listed.alias("problems"), validation.repaired(F.col("json"), {"numThreads": validation.SETTINGS["numThreads"]})["value"]["numThreads"].alias("threads"))


SETTINGS_PROBLEMS = """
WITH e AS (SELECT event_id, event_type AS t, CAST(floor(value) AS BIGINT) AS v FROM events),
j AS (
  SELECT event_id, CASE WHEN v % 50 = 0 THEN '[1]' WHEN v % 51 = 0 THEN 'oops' ELSE concat('{"micMode":"', CASE t WHEN 'view' THEN 'me' WHEN 'click' THEN 'room' ELSE t END,
    '","numThreads":', CASE WHEN v % 3 = 0 THEN concat('"', v, '"') ELSE CAST(v AS VARCHAR) END, ',"captureMic":', CASE WHEN t = 'error' THEN '"yes"' ELSE 'true' END,
    ',"hotkeys":', CASE t WHEN 'signup' THEN 'null' WHEN 'purchase' THEN '{"hint":"Shift+A"}' ELSE '{"hint":"Ctrl+B"}' END, '}') END AS x
  FROM e
), k AS (SELECT event_id, CASE WHEN json_valid(x) THEN CAST(x AS JSON) END AS x FROM j)
SELECT event_id,
  CASE WHEN x IS NULL THEN '$=not JSON' WHEN json_type(x) <> 'OBJECT' THEN '$=not an object' ELSE concat_ws(';',
    CASE WHEN json_type(x, '$.numThreads') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '$.numThreads=wrong type' END,
    CASE WHEN json_type(x, '$.captureMic') <> 'BOOLEAN' THEN '$.captureMic=wrong type' END,
    CASE WHEN json_type(x, '$.micMode') <> 'VARCHAR' THEN '$.micMode=wrong type' WHEN json_extract_string(x, '$.micMode') NOT IN ('me', 'room') THEN '$.micMode=not one of the choices' END,
    CASE WHEN json_type(x, '$.hotkeys') <> 'OBJECT' THEN '$.hotkeys=wrong type' END,
    CASE WHEN NOT regexp_matches(json_extract_string(x, '$.hotkeys.hint'), '(^|[+])(CommandOrControl|Control|Ctrl|Alt|Super)[+]') THEN '$.hotkeys.hint=not usable' END) END AS problems,
  CAST(CASE WHEN json_type(x, '$.numThreads') IN ('UBIGINT', 'BIGINT') THEN greatest(1, least(32, CAST(json_extract_string(x, '$.numThreads') AS BIGINT))) ELSE 4 END AS BIGINT) AS threads
FROM k
"""

NAMED = [
    "live_finals", "live_partials", "shown_partials", "session_clock", "unnamed_labels", "recap_lines", "mic_modes", "hint_cards", "without_noise", "whole_percents",
    "device_order", "duration_labels", "count_labels", "meeting_dates", "model_windows", "request_budgets", "name_lists", "name_forms", "skipped_replies", "ended_meetings",
    "meeting_list", "last_embeddings", "meeting_markdown", "evaluation_set", "runnable_models", "region_kinds", "weighted_objective", "settings_problems",
]
QUERIES = {n: globals()[n] for n in NAMED}
ORACLES = {n: globals()[n.upper()] for n in NAMED}
