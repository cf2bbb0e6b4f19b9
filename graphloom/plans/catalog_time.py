"""Streams, sketches, histories and statistics over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import sketches, stats
from graphloom.plans.tables import new_path
from graphloom.registry import query
from graphloom.sources.graphs import CodeGraph, session_graph
from graphloom.streaming import checkpoints as cp
from graphloom.streaming import journal as jn


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _journal(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return _events(spark, d).select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), "value")


@query(
    "journal_state",
    """WITH r AS (SELECT user_id AS key, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT key, seq, value FROM r WHERE rn = 1 AND event_type <> 'error'""",
)
def journal_state(spark, d):
    return jn.state(_journal(spark, d))


@query(
    "journal_state_at",
    """WITH r AS (SELECT user_id AS key, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id <= 500)
SELECT key, seq, value FROM r WHERE rn = 1 AND event_type <> 'error'""",
)
def journal_state_at(spark, d):
    return jn.state(_journal(spark, d), 500)


@query(
    "journal_state_from_snapshot",
    """WITH r AS (SELECT user_id AS key, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT key, seq, value FROM r WHERE rn = 1 AND event_type <> 'error'""",
)
def journal_state_from_snapshot(spark, d):
    """The state from a snapshot in the middle of the journal and the deltas after it, when the segments before are gone."""
    path, j = new_path(spark, "journal"), _journal(spark, d)
    middle = j.agg(F.expr("max(seq) div 2")).first()[0]
    size = 1 + middle // 4
    cp.append(j, path, size)
    cp.checkpoint(spark, path, middle, size)
    cp.compact(spark, path, size)
    return cp.state_at(spark, path, segment=size)


@query("turnstile_totals", "SELECT user_id AS key, sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END)::BIGINT AS total FROM events GROUP BY user_id HAVING total <> 0")
def turnstile_totals(spark, d):
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return jn.turnstile(_events(spark, d).select(F.col("user_id").alias("key"), delta.alias("delta")))


def _item_updates(spark, d):
    """Inserts of the edges from suppliers (even numbers) to parts (odd ones) of all line items, and deletes of those of small quantities."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"), "l_quantity", "l_discount")
    big = F.expr("l_quantity > 30 AND l_discount > 0.08 AND src % 3 = dst % 3")
    return li.select("src", "dst", F.lit(1).alias("delta")).unionByName(li.where(~big).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("delta")))


_LEFT_SQL = """left_edges AS (SELECT DISTINCT 2 * l_suppkey AS a, 2 * l_partkey + 1 AS b FROM lineitem WHERE l_quantity > 30 AND l_discount > 0.08 AND (2 * l_suppkey) % 3 = (2 * l_partkey + 1) % 3)"""


@query(
    "sketch_components",
    f"""WITH RECURSIVE {_LEFT_SQL}, sym AS (SELECT a, b FROM left_edges UNION SELECT b, a FROM left_edges), ids AS (SELECT 2 * s_suppkey AS id FROM supplier UNION SELECT 2 * p_partkey + 1 FROM part),
low AS (SELECT id, id AS reach FROM ids UNION SELECT s.b, l.reach FROM low l JOIN sym s ON s.a = l.id)
SELECT id, min(reach) AS component FROM low GROUP BY id""",
)
def sketch_components(spark, d):
    """Components of suppliers and parts by the edges that deletes have left, from sketches of the updates alone."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    nodes = t("supplier").select((2 * F.col("s_suppkey")).alias("id")).unionByName(t("part").select((2 * F.col("p_partkey") + 1).alias("id")))
    found, whole = sketches.agm_components(nodes, sketches.agm_sketch(_item_updates(spark, d), 30))
    if not whole:
        raise RuntimeError("the sketch has too few rounds")
    return found


@query(
    "sketch_of_parts",
    """WITH t AS (SELECT user_id AS key, sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END)::BIGINT AS total FROM events GROUP BY user_id HAVING total <> 0)
SELECT count(*) > 0 AS found, count(*) AS live, 0::BIGINT AS not_live FROM t""",
)
def sketch_of_parts(spark, d):
    """Samples from merged sketches of even and odd events, held against the exact totals: whether there are any, the live keys, and samples that aren't live with their total."""
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    u = _events(spark, d).select("event_id", F.col("user_id").alias("key"), delta.alias("delta"))
    half = lambda k: sketches.l0_sketch(u.where(f"event_id % 2 = {k}"), 64)
    got = sketches.l0_samples(sketches.merged(half(0), half(1)))
    live = jn.turnstile(u)
    bad = got.join(live, ["key", "total"], "left_anti").agg(F.count("*").alias("not_live"))
    return got.agg((F.count("*") > 0).alias("found")).crossJoin(live.agg(F.count("*").alias("live"))).crossJoin(bad)


@query("net_edges", "SELECT user_id AS src, event_type AS dst, sum(CASE WHEN value < 50 THEN 1 ELSE -1 END)::BIGINT AS n FROM events GROUP BY ALL HAVING n > 0")
def net_edges(spark, d):
    return jn.net_edges(_events(spark, d).select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.when(F.col("value") < 50, 1).otherwise(-1).alias("sign")))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return jn.windowed_counts(_events(spark, d)).withColumn("total", F.round("total", 4))


@query(
    "sliding_counts",
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""",
)
def sliding_counts(spark, d):
    return jn.windowed_counts(_events(spark, d), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query(
    "user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hours THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 hours AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark, d):
    return jn.sessions(_events(spark, d), "6 hours")


@query("streamed_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark, d):
    e = _events(spark, d)
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet*").parquet(d).groupBy("event_type").agg(F.count("*").alias("n"))
    return jn.run_to_table(stream, "streamed_counts", "complete")


@query(
    "step_cycles",
    """WITH s AS (SELECT user_id, event_type AS step, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, step, count(*) - 1 AS returns FROM s WHERE before IS NULL OR before <> step GROUP BY ALL HAVING returns > 0""",
)
def step_cycles(spark, d):
    return jn.step_cycles(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type"))


@query(
    "snapshot_diff",
    """WITH ev AS (SELECT user_id, event_type, ts, event_id, user_id || '/' || event_type AS id FROM events),
a AS (SELECT id AS src, lead(id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev),
ids AS (SELECT DISTINCT id, event_type FROM ev)
SELECT 'node' AS what, 'removed' AS change, id AS key FROM ids WHERE event_type = 'error'
UNION ALL SELECT DISTINCT 'edge', 'removed', src || '>' || dst || '>calls' FROM a WHERE dst IS NOT NULL AND (src LIKE '%/error' OR dst LIKE '%/error')
UNION ALL SELECT DISTINCT 'node', 'edges', src FROM a WHERE dst LIKE '%/error' AND src NOT LIKE '%/error'""",
)
def snapshot_diff(spark, d):
    g = session_graph(spark, d)
    less = CodeGraph(g.nodes.where("name <> 'error'"), g.edges.where("src NOT LIKE '%/error' AND dst NOT LIKE '%/error'"))
    return jn.snapshot_diff(g, less)


@query("stale_files", "SELECT p_brand || '/' || p_partkey AS file_path, CASE WHEN p_size < 10 THEN 'deleted' WHEN p_size < 20 THEN 'modified' ELSE 'added' END AS status FROM part WHERE p_size < 20 OR p_size > 40")
def stale_files(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("file_path"), "p_size", "p_name")
    old = p.where("p_size <= 40").select("file_path", F.sha2("p_name", 256).alias("hash"))
    new = p.where("p_size >= 10").select("file_path", F.sha2(F.when(F.col("p_size") < 20, F.upper("p_name")).otherwise(F.col("p_name")), 256).alias("hash"))
    return jn.stale_files(old, new)


@query("distinct_users_estimate")
def distinct_users_estimate(spark, d):
    by_day = stats.distinct_sketch(_events(spark, d).withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")
    return stats.merge_sketches(by_day, ["event_type"]).select("event_type", stats.sketch_estimate("sketch").alias("users"))


@query("distinct_users_exact", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users_exact(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("heavy_hitters")
def heavy_hitters(spark, d):
    return _events(spark, d).agg(F.expr("approx_top_k(user_id, 20)").alias("top")).select(F.explode("top").alias("x")).select("x.item", "x.count")


@query(
    "caller_trends",
    """WITH h AS (SELECT user_id AS symbol_id, epoch_ms(ts) AS t, CAST(floor(value) AS INTEGER) AS c, event_id FROM events),
k AS (SELECT symbol_id, count(*) AS points, coalesce(arg_max(c, t) FILTER (t < 1706140800000), arg_min(c, t)) AS baseline, arg_max(c, t) AS current FROM h GROUP BY symbol_id HAVING count(*) >= 3),
g AS (SELECT *, CASE WHEN baseline = 0 THEN CASE WHEN current = 0 THEN 0.0 ELSE 100.0 END ELSE (current - baseline) * 100.0::DOUBLE / baseline END AS growth FROM k)
SELECT symbol_id, points, baseline, current, round(growth, 6) AS growth, CASE WHEN growth > 5 THEN 'up' WHEN growth < -5 THEN 'down' ELSE 'stable' END AS direction, growth > 50 AS rapid FROM g""",
)
def caller_trends(spark, d):
    h = _events(spark, d).select(F.col("user_id").alias("symbol_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.floor("value").cast("int").alias("direct_callers"))
    return stats.trend(h, 1706140800000 + 7 * 86_400_000).withColumn("growth", F.round("growth", 6))


@query(
    "latency_stats",
    """SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p99_9
FROM events GROUP BY event_type""",
)
def latency_stats(spark, d):
    s = stats.latency_stats(_events(spark, d), ["event_type"], "value")
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@query(
    "without_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type)
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN q USING (event_type) WHERE value BETWEEN a - (b - a) * 1.5 AND b + (b - a) * 1.5 GROUP BY event_type""",
)
def without_outliers(spark, d):
    return stats.without_outliers(_events(spark, d).select("event_type", "value"), "event_type", "value").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "welch_test",
    """WITH s AS (SELECT count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb, avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'view') AS mb,
var_samp(value) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'view') AS vb FROM events)
SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d FROM s""",
)
def welch_test(spark, d):
    w = stats.welch(_events(spark, d), "event_type", "click", "view", "value")
    return w.select(*(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "t", "cohen_d")))


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return stats.bootstrap_mean(_events(spark, d), "value", "event_id")


@query("bootstrap_covers_the_mean", "SELECT round(avg(value), 6) AS exact, true AS covered, true AS narrow FROM events")
def bootstrap_covers_the_mean(spark, d):
    """The interval holds the mean and is about four standard errors wide."""
    e = _events(spark, d)
    b = stats.bootstrap_mean(e, "value", "event_id")
    m = e.agg(F.avg("value").alias("m"), (F.stddev("value") / F.sqrt(F.count("value"))).alias("s"))
    return m.crossJoin(F.broadcast(b)).select(F.round("m", 6).alias("exact"), F.col("m").between(F.col("low"), F.col("high")).alias("covered"), (F.col("high") - F.col("low")).between(3 * F.col("s"), 5 * F.col("s")).alias("narrow"))


@query("distinct_users_within_bound", "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type")
def distinct_users_within_bound(spark, d):
    """Merged daily sketches against the exact number: within three relative standard errors of a sketch of 2 ** 14 registers."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    merged = stats.merge_sketches(stats.distinct_sketch(e, ["event_type", "day"], "user_id"), ["event_type"]).select("event_type", stats.sketch_estimate("sketch").alias("about"))
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(merged, "event_type").select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 3 * 1.04 / 128 * F.col("users") + 1).alias("close"))


@query("count_min_within_bound", "SELECT user_id AS item, count(*) AS n, true AS over, true AS close FROM events GROUP BY user_id")
def count_min_within_bound(spark, d):
    e = _events(spark, d)
    exact = e.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("total"))
    both = exact.join(stats.count_min_estimates(e, "user_id"), "item").crossJoin(F.broadcast(total))
    return both.select("item", "n", (F.col("estimate") >= F.col("n")).alias("over"), (F.col("estimate") - F.col("n") <= 0.002 * F.col("total")).alias("close"))


@query(
    "heavy_hitters_exact",
    "SELECT user_id AS item, count(*) AS count FROM events GROUP BY user_id QUALIFY rank() OVER (ORDER BY count(*) DESC, user_id) <= 20",
)
def heavy_hitters_exact(spark, d):
    return _events(spark, d).groupBy(F.col("user_id").alias("item")).count().orderBy(F.desc("count"), "item").limit(20)


@query(
    "timeline_as_of",
    """SELECT user_id, arg_max(event_type, event_id) FILTER (ts < TIMESTAMP '2024-01-15') AS last_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS events_before FROM events GROUP BY user_id""",
)
def timeline_as_of(spark, d):
    before = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return _events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.when(before, F.col("event_id"))).alias("last_type"), F.count_if(before).alias("events_before"))
