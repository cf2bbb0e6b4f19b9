"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import explore, structural
from graphloom.registry import query
from graphloom.sources.graphs import SESSION_SQL, SUPPLY_SQL, WEB_SQL, session_graph, supply_graph, web_graph


@query(
    "file_summary",
    f"""WITH {SUPPLY_SQL}, e AS (SELECT a.file_path AS a, b.file_path AS b FROM edges x JOIN nodes a ON a.id = x.src JOIN nodes b ON b.id = x.dst WHERE a.file_path <> b.file_path)
SELECT file_path, count(*) AS symbols, count(*) FILTER (exported) AS exported, list_sort(list(DISTINCT kind)) AS kinds, (SELECT count(*) FROM e WHERE b = n.file_path) AS incoming, (SELECT count(*) FROM e WHERE a = n.file_path) AS outgoing FROM nodes n GROUP BY file_path""",
)
def file_summary(spark, d):
    return explore.file_summary(supply_graph(spark, d))


@query(
    "public_api",
    f"""WITH {SUPPLY_SQL} SELECT n.id, n.kind, (SELECT count(DISTINCT a.package) FROM edges x JOIN nodes a ON a.id = x.src WHERE x.dst = n.id AND a.package <> 'statusO') AS users FROM nodes n WHERE n.package = 'statusO' AND n.exported""",
)
def public_api(spark, d):
    return explore.public_api(supply_graph(spark, d), "statusO")


@query(
    "dead_code_findings",
    f"""WITH {SUPPLY_SQL} SELECT id, round(0.95 - CASE WHEN exported THEN 0.35 ELSE 0 END, 4)::DOUBLE AS confidence FROM nodes WHERE id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT src FROM edges WHERE etype = 'implements')""",
)
def dead_code_findings(spark, d):
    return explore.dead_code_findings(supply_graph(spark, d))


@query(
    "data_flow_sessions",
    f"""WITH RECURSIVE {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT min(id) AS id, 0 AS depth FROM nodes UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.id WHERE w.depth < 5)
SELECT id, min(depth) AS depth, 'other' AS role FROM w GROUP BY id""",
)
def data_flow_sessions(spark, d):
    g = session_graph(spark, d)
    return explore.data_flow(g, g.nodes.agg(F.min("id")).first()[0])


@query("dependency_index", f"WITH {WEB_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst) SELECT id, (SELECT count(*) FROM e WHERE src = id) AS depends_on, (SELECT count(*) FROM e WHERE dst = id) AS depended_by FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)")
def dependency_index(spark, d):
    return explore.dependency_index(web_graph(spark, d).edges)


@query(
    "package_blast",
    f"""WITH RECURSIVE {SUPPLY_SQL}, dep AS (SELECT DISTINCT a.package AS s, b.package AS t FROM edges x JOIN nodes a ON a.id = x.src JOIN nodes b ON b.id = x.dst WHERE a.package <> b.package),
w AS (SELECT 'Brand#11' AS package, 0 AS depth UNION SELECT dep.s, w.depth + 1 FROM w JOIN dep ON dep.t = w.package WHERE w.depth < 6)
SELECT package, min(depth) AS depth FROM w GROUP BY package HAVING min(depth) > 0""",
)
def package_blast(spark, d):
    return explore.package_blast(structural.package_dependencies(supply_graph(spark, d)), "Brand#11")


@query(
    "simulated_change",
    f"""WITH {SUPPLY_SQL} SELECT e.dst AS id, e.src AS caller, '' AS file_path, e.line, 'replace the call' AS edit FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.etype = 'calls' AND n.package = 'statusP'""",
)
def simulated_change(spark, d):
    g = supply_graph(spark, d)
    return explore.simulate_change(g, g.nodes.where("package = 'statusP'").select("id", F.lit("removed").alias("change")))


@query(
    "arc_consistency",
    """WITH RECURSIVE d AS (SELECT n_nationkey AS v, n_regionkey AS r FROM nation), pairs AS (SELECT a.v AS a, b.v AS b FROM d a JOIN d b ON a.v + 1 = b.v AND a.r <= b.r)
SELECT 'x' AS variable, a AS value FROM pairs WHERE a <= 20 UNION SELECT 'y', b FROM pairs WHERE a <= 20""",
)
def arc_consistency(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("v"), F.col("n_regionkey").alias("r"))
    domains = n.where("v <= 20").select(F.lit("x").alias("variable"), F.col("v").alias("value")).unionByName(n.select(F.lit("y").alias("variable"), F.col("v").alias("value")))
    p = n.alias("a").join(n.alias("b"), (F.col("a.v") + 1 == F.col("b.v")) & (F.col("a.r") <= F.col("b.r"))).select(F.lit("x").alias("x"), F.col("a.v").alias("a"), F.lit("y").alias("y"), F.col("b.v").alias("b"))
    return explore.arc_consistent(domains, p)


@query("resolved_query")
def resolved_query(spark, d):
    return explore.resolve_query(supply_graph(spark, d), "which orders of `nation3` does Customer000000001 place")
