"""Index batches, contexts, plans, checks, policies and history over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import project as pj
from graphloom.operators import structural as st
from graphloom.registry import query
from graphloom.sources.graphs import SESSION_SQL, SUPPLY_SQL, session_graph, supply_graph


@query(
    "rejected_batch",
    f"""WITH {SUPPLY_SQL}, b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, 'c' || o_custkey AS id FROM orders)
SELECT place, id, 'repeated in the batch' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS nth FROM b) WHERE nth > 1""",
)
def rejected_batch(spark, d):
    """The customers of all orders, one symbol an order."""
    g = supply_graph(spark, d)
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("at"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    batch = o.join(g.nodes, "id")
    return pj.add_batch(g.nodes.where("kind = 'struct'"), batch)[1].withColumnRenamed("at", "place")


@query("accepted_batch", f"WITH {SUPPLY_SQL} SELECT kind, count(*) AS n FROM nodes WHERE kind IN ('struct', 'class') GROUP BY kind")
def accepted_batch(spark, d):
    n = supply_graph(spark, d).nodes
    index, _ = pj.add_batch(n.where("kind = 'struct'"), n.where("kind = 'class'").withColumn("at", F.expr("cast(substring(id, 2) AS long)")))
    return index.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "minimal_context_of_orders",
    f"""WITH {SUPPLY_SQL}, t AS (SELECT id FROM nodes WHERE package = 'statusP'),
e AS (SELECT t.id AS target, CASE WHEN e.etype = 'references' THEN 1 ELSE 2 END AS o, e.dst AS id, count(*) AS n FROM t JOIN edges e ON e.src = t.id WHERE e.etype IN ('references', 'implements') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target, o ORDER BY n DESC, id) AS nth FROM e),
k AS (SELECT target, CASE o WHEN 1 THEN 'type' ELSE 'interface' END AS part, id, o, nth FROM r WHERE nth <= CASE o WHEN 1 THEN 10 ELSE 5 END UNION ALL SELECT id, 'target', id, 0, 1 FROM t)
SELECT target, part, id, 12::BIGINT AS tokens, (12 * row_number() OVER (PARTITION BY target ORDER BY o, nth))::BIGINT AS total FROM k QUALIFY total <= 60""",
)
def minimal_context_of_orders(spark, d):
    """Within 60 tokens: an order, its suppliers and its parts, 12 tokens each."""
    g = supply_graph(spark, d)
    return pj.minimal_context(g, g.nodes.where("package = 'statusP'").select("id"), 60)


@query(
    "cycle_through_package",
    f"""WITH {SUPPLY_SQL}, dep AS (SELECT DISTINCT a.package AS s, b.package AS t FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.package <> b.package),
c AS (SELECT min(y.s) AS mid FROM dep x JOIN dep y ON y.s = x.t WHERE x.s = 'statusO' AND y.t = 'statusO')
SELECT 0 AS place, 'statusO' AS package FROM c WHERE mid IS NOT NULL UNION ALL SELECT 1, mid FROM c WHERE mid IS NOT NULL UNION ALL SELECT 2, 'statusO' FROM c WHERE mid IS NOT NULL""",
)
def cycle_through_package(spark, d):
    """Open orders need a nation's suppliers, and a nation's customers need open orders."""
    way = pj.shortest_cycle(st.package_dependencies(supply_graph(spark, d)), "statusO")
    return spark.createDataFrame(list(enumerate(way)), "place int, package string")


_TYPES = ["int", "int64", "int32", "float64", "float32", "byte", "rune", "string", "[]byte", "int8", "{}", "*{}", "[]{}"]
_NAMES_SQL = lambda key, extra: "CASE " + key + f" % {13 + len(extra)} " + " ".join(f"WHEN {i} THEN " + (f"'{x.format('')}' || p_brand" if "{}" in x and "interface" not in x else x if x == "p_type" else f"'{x}'") for i, x in enumerate([*_TYPES, *extra])) + " END"


@query(
    "type_compatibility",
    f"""WITH p AS (SELECT DISTINCT {_NAMES_SQL("p_size", [])} AS source, {_NAMES_SQL("p_partkey", ["any", "interface{}", "uint8", "p_type"])} AS target FROM part),
fits AS (SELECT DISTINCT p_brand AS s, p_type AS t FROM part WHERE p_size > 25),
builtin(s, t) AS (VALUES ('int', 'int64'), ('int', 'int32'), ('int64', 'int'), ('int32', 'int'), ('float64', 'float32'), ('float32', 'float64'), ('byte', 'uint8'), ('rune', 'int32')),
r AS (SELECT *, CASE WHEN source = target THEN 'exact' WHEN target IN ('any', 'interface{{}}') THEN 'anything' WHEN (source, target) IN (SELECT (s, t) FROM builtin) THEN 'builtin' WHEN (source, target) IN (SELECT (s, t) FROM fits) THEN 'interface'
  WHEN source LIKE '*%' AND substr(source, 2) = target THEN 'dereference' WHEN target LIKE '*%' AND substr(target, 2) = source THEN 'address' ELSE 'none' END AS reason,
  regexp_full_match(source, '(int|int8|int32|int64|uint8|float32|float64)') AND regexp_full_match(target, '(int|int8|int32|int64|uint8|float32|float64)') AS numbers FROM p)
SELECT source, target, reason <> 'none' AS compatible, reason, CASE reason WHEN 'exact' THEN 1.0 WHEN 'interface' THEN 0.9 WHEN 'dereference' THEN 0.7 WHEN 'address' THEN 0.6 WHEN 'none' THEN 0.8 ELSE 0.95 END::DOUBLE AS confidence,
  CASE WHEN reason <> 'none' THEN CAST([] AS VARCHAR[]) WHEN numbers THEN [target || '(value)'] WHEN source = '[]byte' AND target = 'string' THEN ['string(value)'] WHEN source = 'string' AND target = '[]byte' THEN ['[]byte(value)']
    WHEN source NOT LIKE '*%' AND target LIKE '*%' THEN ['&value (if addressable)'] WHEN source LIKE '*%' AND target NOT LIKE '*%' THEN ['*value (dereference)'] ELSE CAST([] AS VARCHAR[]) END AS conversions FROM r""",
)
def type_compatibility(spark, d):
    """Every reason: builtin types, pointers and slices of brands, and the types of large parts as interfaces that their brands satisfy."""
    p = spark.read.parquet(f"{d}/part.parquet")

    def names(key, kinds):
        at = F.expr(f"{key} % {len(kinds)}")
        value = [F.col(x) if x == "p_type" else F.concat(F.lit(x.removesuffix("{}")), F.col("p_brand")) if x in _TYPES[-3:] else F.lit(x) for x in kinds]
        return F.get(F.array(*value), at)

    fits = p.where("p_size > 25").select(F.col("p_brand").alias("type"), F.col("p_type").alias("interface"))
    pairs = p.select(names("p_size", _TYPES).alias("source"), names("p_partkey", [*_TYPES, "any", "interface{}", "uint8", "p_type"]).alias("target"))
    return pj.type_compatibility(pairs.distinct(), fits)


@query(
    "missing_methods",
    """WITH have AS (SELECT DISTINCT n_name AS type, p_brand AS method FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity > 49),
need AS (SELECT DISTINCT r_name AS interface, p_brand AS method FROM region, part WHERE p_size = r_regionkey + 1), pairs AS (SELECT n_name AS type, r_name AS interface FROM nation JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT p.type, p.interface, n.method, h.method IS NULL AND n.method IS NOT NULL AS lacks FROM pairs p LEFT JOIN need n USING (interface) LEFT JOIN have h ON h.type = p.type AND h.method = n.method)
SELECT type, interface, count(*) FILTER (lacks) = 0 AS satisfied, coalesce(list_sort(list(method) FILTER (lacks)), []) AS missing FROM m GROUP BY type, interface""",
)
def missing_methods(spark, d):
    """Brands of small parts that the nations of a region don't supply in large quantities."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    have = t("lineitem").where("l_quantity > 49").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    need = t("region").join(t("part"), F.col("p_size") == F.col("r_regionkey") + 1).select(F.col("r_name").alias("interface"), F.col("p_brand").alias("method"))
    pairs = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("type"), F.col("r_name").alias("interface"))
    return pj.missing_methods(have.select(F.col("n_name").alias("type"), F.col("p_brand").alias("method")), need, pairs)


@query(
    "change_plan",
    f"""WITH {SESSION_SQL}, c AS (SELECT id FROM nodes WHERE name = 'purchase'), own AS (SELECT file_path, count(*) AS symbols FROM nodes WHERE id IN (SELECT id FROM c) GROUP BY file_path),
k AS (SELECT n.file_path, count(*) AS callers FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst IN (SELECT id FROM c) GROUP BY n.file_path)
SELECT coalesce(o.file_path, k.file_path) AS file_path, CASE WHEN symbols > 0 THEN 1 ELSE 2 END AS step, coalesce(symbols, 0) AS symbols, coalesce(callers, 0) AS callers FROM own o FULL JOIN k USING (file_path)""",
)
def change_plan(spark, d):
    g = session_graph(spark, d)
    return pj.change_plan(g, g.nodes.where("name = 'purchase'").select("id"))


@query(
    "change_plan_of_orders",
    f"""WITH {SUPPLY_SQL}, c AS (SELECT id FROM nodes WHERE package = 'statusP'), k AS (SELECT n.file_path, count(*) AS callers FROM edges e JOIN nodes n ON n.id = e.src WHERE e.etype = 'calls' AND e.dst IN (SELECT id FROM c) GROUP BY n.file_path)
SELECT file_path, 2 AS step, 0::BIGINT AS symbols, callers FROM k UNION ALL SELECT 'statusP/struct.go', 1, count(*), 0 FROM c HAVING count(*) > 0""",
)
def change_plan_of_orders(spark, d):
    g = supply_graph(spark, d)
    return pj.change_plan(g, g.nodes.where("package = 'statusP'").select("id"))


@query(
    "lint_policy",
    """WITH i AS (SELECT event_id, event_type || '/' || (user_id % 3) AS rule FROM events)
SELECT event_id, rule, CASE WHEN rule = 'error/0' THEN 'info' WHEN rule LIKE 'error/%' THEN 'error' ELSE 'warning' END AS level FROM i WHERE rule NOT LIKE 'view/%'""",
)
def lint_policy(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat_ws("/", "event_type", (F.col("user_id") % 3).cast("string")).alias("rule"))
    policy = spark.createDataFrame([("error/*", "error"), ("error/0", "info"), ("view/*", "ignore"), ("v*", "error")], "pattern string, level string")
    return pj.apply_policy(e, policy).select("event_id", "rule", "level")


def _history(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("symbol_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "event_id")


@query("symbol_history", "SELECT CAST(user_id AS VARCHAR) AS symbol_id, epoch_us(ts) // 1000 AS timestamp_ms, event_id FROM events WHERE user_id = 7 AND epoch_us(ts) // 1000 BETWEEN 1704672000000 AND 1705276800000")
def symbol_history(spark, d):
    return pj.history(_history(spark, d), "7", 1704672000000, 1705276800000)


@query("recent_events_by_symbol", "SELECT symbol_id, timestamp_ms FROM (SELECT CAST(user_id AS VARCHAR) AS symbol_id, epoch_us(ts) // 1000 AS timestamp_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC) AS nth FROM events) WHERE nth <= 3")
def recent_events_by_symbol(spark, d):
    return pj.recent_events(_history(spark, d), 3, True).select("symbol_id", "timestamp_ms")


@query("history_stats", "SELECT count(*) AS events, count(DISTINCT user_id) AS symbols, min(epoch_us(ts) // 1000) AS oldest, max(epoch_us(ts) // 1000) AS newest FROM events WHERE epoch_us(ts) // 1000 >= 1706572800000 - 7 * 86400000")
def history_stats(spark, d):
    return pj.history_stats(pj.retained(_history(spark, d), 1706572800000, 7))


@query(
    "table_invariants",
    """SELECT 'keys are unique' AS property, count(*) = count(DISTINCT o_orderkey) AS holds FROM orders UNION ALL SELECT 'customers are unique', count(*) = count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'prices are bounded', bool_and(o_totalprice BETWEEN 0 AND 1e9) FROM orders UNION ALL SELECT 'shares add up', true UNION ALL SELECT 'bounded if unique', bool_and(o_totalprice BETWEEN 0 AND 1e9) OR count(*) <> count(DISTINCT o_orderkey) FROM orders""",
)
def table_invariants(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    o = o.withColumn("share", F.lit(1.0) / max(o.count(), 1))
    bounded, unique = pj.holds_bounded("o_totalprice", 0, 1e9), pj.holds_unique("o_orderkey")
    return pj.check(o, {"keys are unique": unique, "customers are unique": pj.holds_unique("o_custkey"), "prices are bounded": bounded, "shares add up": pj.holds_distribution("share", 1e-6), "bounded if unique": pj.implies(unique, bounded)})


@query("values_step_back", "SELECT user_id, count(*) AS n FROM (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events) WHERE back GROUP BY user_id")
def values_step_back(spark, d):
    return pj.steps_back(spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")


@query("hot_symbols", "SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, id LIMIT 10")
def hot_symbols(spark, d):
    return pj.hot_symbols(_history(spark, d).select(F.col("symbol_id").alias("id")), 10)


@query(
    "library_search",
    """WITH own AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS terms FROM documents WHERE lang = 'en'),
size AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM own), post AS (SELECT doc_id, len(terms) AS l, unnest(terms) AS term FROM own), df AS (SELECT term, count(*) AS df FROM post WHERE term IN ('license', 'the', 'of') GROUP BY term),
raw AS (SELECT doc_id, sum((ln((n + 1) / (df + 1)) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / mean))) AS raw FROM post JOIN df USING (term), size GROUP BY doc_id)
SELECT doc_id, round(raw / max(raw) OVER (), 6) AS score, row_number() OVER (ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM raw QUALIFY rank <= 10""",
)
def library_search(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("library"), "text")
    return pj.search_library(docs, "the license of", "en").withColumn("score", F.round("score", 6))
