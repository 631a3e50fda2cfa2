"""Usage, evaluation and plain relational queries over the star schema and the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import vectors
from parley.operators import regroup, scoring, turns, usage
from parley.session import table


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as model responses: requests, tokens, cost, unpriced ones and the largest live prompt."""
    return usage.totals(_responses(spark, sf_dir), ["model"]).withColumn("cost", F.round("cost", 6)).withColumn("hit_rate", F.round("hit_rate", 9))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a response: models by ship flag, tokens from its numbers."""
    model = F.concat_ws("-", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select(
        model.alias("model"),
        F.col("l_partkey").alias("input"),
        F.col("l_suppkey").alias("cache_read"),
        F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).otherwise(0).cast("long").alias("cache_write"),
        F.col("l_quantity").cast("long").alias("output"),
        (F.col("l_linenumber") <= 3).alias("live"),
    )
    prices = spark.createDataFrame([("^A", 1.0, 0.1, 5.0), ("^R", 3.0, 0.3, 15.0)], "pattern string, input_price double, read_price double, output_price double")
    return usage.priced(rows, prices)


USAGE_TOTALS = """
WITH r AS (
  SELECT concat(l_returnflag, '-', l_linestatus) AS model, l_partkey AS i, l_suppkey AS cr, CASE WHEN l_linenumber = 1 THEN l_partkey ELSE 0 END AS cw, CAST(trunc(l_quantity) AS BIGINT) AS o, l_linenumber <= 3 AS live,
         CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 3.0 END AS pi, CASE l_returnflag WHEN 'A' THEN 0.1 WHEN 'R' THEN 0.3 END AS pr, CASE l_returnflag WHEN 'A' THEN 5.0 WHEN 'R' THEN 15.0 END AS po FROM lineitem
), c AS (SELECT *, (i * CAST(pi AS DOUBLE) + cr * CAST(pr AS DOUBLE) + cw * CAST(pi AS DOUBLE) * 1.25 + o * CAST(po AS DOUBLE)) / 1e6 AS cost FROM r)
SELECT model, count(*) AS requests, CAST(sum(i) AS BIGINT) AS input, CAST(sum(cr) AS BIGINT) AS cache_read, CAST(sum(cw) AS BIGINT) AS cache_write, CAST(sum(o) AS BIGINT) AS output,
       round(coalesce(sum(cost), 0), 6) AS cost, count(*) FILTER (WHERE cost IS NULL) AS unpriced, coalesce(max(i + cr + cw) FILTER (WHERE live), 0) AS peak_prompt,
       round(sum(cr) / nullif(sum(i + cr + cw), 0), 9) AS hit_rate
FROM c GROUP BY model
"""


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status by priority, a dash where there are none."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P", "X"]).agg(F.first("n"))
    return wide.select("o_orderpriority", *[F.coalesce(F.col(c).cast("string"), F.lit("–")).alias(f"s_{c.lower()}") for c in ("F", "O", "P", "X")])


METRIC_PIVOT = "SELECT o_orderpriority, " + ", ".join(f"coalesce(CAST(nullif(count(*) FILTER (WHERE o_orderstatus = '{c}'), 0) AS VARCHAR), '–') AS s_{c.lower()}" for c in "FOPX") + " FROM orders GROUP BY o_orderpriority"


def real_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-time factors per ship flag: sums over sums."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("duration"), F.col("l_tax").alias("proc_s"), F.col("l_discount").alias("cpu_s"))
    return scoring.real_time_factor(items, ["l_returnflag"]).select("l_returnflag", F.round("rtf", 9).alias("rtf"), F.round("cpu_rtf", 9).alias("cpu_rtf"))


REAL_TIME = "SELECT l_returnflag, round(sum(l_tax) / nullif(sum(l_quantity), 0), 9) AS rtf, round(sum(l_discount) / nullif(sum(l_quantity), 0), 9) AS cpu_rtf FROM lineitem GROUP BY l_returnflag"


def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest line of each order with its own tax."""
    return scoring.best_run(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_tax")


BEST_RUNS = "SELECT l_orderkey, min(l_extendedprice) AS l_extendedprice, arg_min(l_tax, (l_extendedprice, l_tax)) AS l_tax FROM lineitem GROUP BY l_orderkey"


def matched_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many orders of each status as the rarest status of the priority has."""
    return scoring.matched_subset(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority")


MATCHED_SUBSET = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS c FROM orders),
m AS (SELECT *, min(c) OVER (PARTITION BY o_orderpriority) AS least FROM n)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM m WHERE r <= least
"""


def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned share of line items by quantity, read as 200 ms each."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("long") * 200).alias("ms"), (F.col("l_returnflag") == "R").alias("wrong"))
    return scoring.by_duration(rows, [], "ms", "wrong")


DURATION_BUCKETS = """
WITH r AS (SELECT CAST(trunc(l_quantity) AS BIGINT) * 200 AS ms, l_returnflag = 'R' AS wrong FROM lineitem)
SELECT CASE WHEN ms < 1000 THEN 0 WHEN ms < 2000 THEN 1 WHEN ms < 7000 THEN 2 ELSE 3 END AS bucket, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(coalesce(sum(ms) FILTER (WHERE wrong), 0) AS BIGINT) AS wrong_ms,
       round(sum(ms) / sum(sum(ms)) OVER (), 9) AS share FROM r GROUP BY 1
"""


def hourly_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decibels of the mean value of each hour with events."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    sums = table(spark, sf_dir, "events").groupBy(hour.alias("hour")).agg((F.sum("value") / F.count(F.lit(1))).alias("m"))
    return sums.select("hour", F.round(vectors.decibels(F.col("m")), 6).alias("db"))


HOURLY_LEVELS = "SELECT epoch_us(ts) // 3600000000 AS hour, round(CASE WHEN avg(value) > 0 THEN greatest(20 * log10(avg(value)), -100) ELSE -100 END, 6) AS db FROM events GROUP BY 1"


def smoothed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted mean of each user's values in order, 0.7 of the old one kept."""
    found = turns.smoothed(table(spark, sf_dir, "events"), ["user_id"], ("ts", "event_id"), F.col("value"), 0.1, 0.7, "ewma")
    return found.withColumn("ewma", F.round("ewma", 6))


SMOOTHED_VALUES = """
WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(list_concat([CAST(0.1 AS DOUBLE)], v), lambda s, x: 0.7 * s + 0.3 * x), 6) AS ewma FROM l
"""


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label centroid by cosine, ties to the smaller label."""
    rows = table(spark, sf_dir, "embeddings")
    centres = vectors.sums(rows, "label", "embedding").select("label", vectors.unit(F.col("sum")).alias("u"))
    return regroup.nearest_centres(rows, "vec_id", "embedding", centres).withColumn("similarity", F.round("similarity", 6))


NEAREST_CENTROID = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(v[i]) AS s FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, c.label AS nearest, round(list_cosine_similarity(v, c), 9) AS s FROM e, c)
SELECT vec_id, nearest, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nearest) = 1
"""


def moved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are nearer by 0.02 to another label's centre than to the rest of their own label, and that label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), vectors.unit(F.col("embedding")).alias("e"), F.lit(1.0).alias("w"), F.lit(1000).cast("long").alias("d"), F.col("label").cast("long").alias("cluster"))
    moves = regroup.moved(regroup.one_stream(rows.filter("e IS NOT NULL")), 0.02, 0.625)
    return moves.select(F.col("pos").alias("vec_id"), F.col("to").alias("label"))


MOVED_VECTORS = """
WITH u AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT vec_id, label, i, v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM u, range(1, 65) r(i)),
t AS (SELECT label, i, sum(x) AS s FROM e GROUP BY label, i),
n AS (SELECT label, count(*) AS n FROM u GROUP BY label),
l AS (SELECT label, sqrt(sum(s * s)) AS l FROM t GROUP BY label),
d AS (SELECT e.vec_id, any_value(e.label) AS own, t.label AS c, sum(e.x * t.s) AS d FROM e JOIN t USING (i) GROUP BY e.vec_id, t.label),
m AS (SELECT vec_id, own, CASE WHEN n.n > 1 THEN (d - 1) / sqrt(l * l - 2 * d + 1) ELSE 0.625 END AS mine FROM d JOIN l ON l.label = own JOIN n ON n.label = own WHERE c = own),
b AS (SELECT vec_id, arg_max(c, (d / l, -c)) AS label, max(d / l) AS best FROM d JOIN l ON l.label = c WHERE c <> own GROUP BY vec_id)
SELECT vec_id, b.label FROM b JOIN m USING (vec_id) WHERE best - mine >= 0.02
"""


def pair_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal error rate of same and different labels over all pairs of vectors."""
    cells = scoring.pair_cells(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return scoring.error_rate_of_cells(cells.withColumn("g", F.lit(1)), ["g"]).drop("g")


PAIR_ERROR_RATE = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT round(list_cosine_similarity(a.v, c.v), 6) AS s, a.label = c.label AS same FROM e a JOIN e c ON a.vec_id < c.vec_id),
x AS (SELECT greatest(0, least(201, CAST(floor((s + 0.2) / CAST(0.006 AS DOUBLE)) AS INTEGER) + 1)) AS c, count(*) FILTER (WHERE same) AS n, count(*) FILTER (WHERE NOT same) AS o FROM p GROUP BY 1),
g AS (SELECT i, coalesce(sum(n) FILTER (WHERE c <= i), 0) / greatest(sum(n), 1) AS frr, 1 - coalesce(sum(o) FILTER (WHERE c <= i), 0) / greatest(sum(o), 1) AS far FROM x, range(0, 201) r(i) GROUP BY i)
SELECT round(-0.2 + 0.006 * i, 9) AS threshold, round((frr + far) / 2, 9) AS eer FROM g ORDER BY round(abs(frr - far), 12), i LIMIT 1
"""


def revenue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and totals by status and priority with all subtotals."""
    cube = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return cube


REVENUE_CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and year through four joins."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    per_order = line.groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "year").agg(F.round(F.sum("r"), 2).alias("revenue"))


NATION_REVENUE = """
SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
"""


def without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, and those with an urgent one (anti and semi join, union)."""
    people, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    none = people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("kind", F.lit("none"))
    urgent = people.join(orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("kind", F.lit("urgent"))
    return none.unionByName(urgent)


WITHOUT_ORDERS = """
SELECT c_custkey, 'none' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'urgent' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's JSON properties, summed by type."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(k.isNull()).alias("missing"))


JSON_PROPS = "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (WHERE props->>'k' IS NULL) AS missing FROM events GROUP BY event_type"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, closed by eight hours without events."""
    gap = F.session_window(F.col("ts").cast("timestamp"), "8 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", gap).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n", "total")


SESSIONS = """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 8 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k
"""

NAMED = ["usage_totals", "metric_pivot", "real_time", "best_runs", "matched_subset", "duration_buckets", "hourly_levels", "smoothed_values", "nearest_centroid", "moved_vectors", "pair_error_rate", "revenue_cube", "nation_revenue", "without_orders", "json_props", "sessions"]
QUERIES = {n: globals()[n] for n in NAMED}
ORACLES = {n: globals()[n.upper()] for n in NAMED}
