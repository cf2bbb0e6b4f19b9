"""Structural queries and traversals over the supply, web and tree graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import structural as st
from graphloom.operators import traversal as tr
from graphloom.registry import query
from graphloom.sources.graphs import SESSION_SQL, SUPPLY_SQL, WEB_SQL, CodeGraph, session_graph, supply_graph, web_graph



def _suppliers(g, package="nation3"):
    return g.nodes.where((F.col("kind") == "class") & (F.col("package") == package)).select("id")


@query("node_lookup", f"WITH {SUPPLY_SQL} SELECT id, name, kind, package, exported FROM nodes WHERE kind = 'class' AND exported")
def node_lookup(spark, d):
    return st.by_kind(supply_graph(spark, d), "class").where("exported").select("id", "name", "kind", "package", "exported")


@query("callers_of_open_orders", f"WITH {SUPPLY_SQL} SELECT e.dst AS target, e.src AS caller FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.etype = 'calls' AND n.package = 'statusO'")
def callers_of_open_orders(spark, d):
    g = supply_graph(spark, d)
    return st.callers(g, g.nodes.where("package = 'statusO'").select("id"))


@query(
    "callers_limited",
    f"""WITH {SESSION_SQL}, r AS (SELECT dst AS target, src AS caller, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn, count(*) OVER (PARTITION BY dst) > 3 AS truncated FROM edges)
SELECT target, caller, truncated FROM r WHERE rn <= 3""",
)
def callers_limited(spark, d):
    g = session_graph(spark, d)
    return st.callers(g, g.nodes.select("id"), 3)


@query("callees_distinct", f"WITH {SESSION_SQL} SELECT DISTINCT src AS source, dst AS callee FROM edges")
def callees_distinct(spark, d):
    g = session_graph(spark, d)
    return st.callees(g, g.nodes.select("id"))


@query("callers_by_name", f"WITH {SESSION_SQL} SELECT e.dst AS target, e.src AS caller FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.name = 'purchase'")
def callers_by_name(spark, d):
    return st.callers_by_name(session_graph(spark, d), "purchase")


@query("implementations_of_parts", f"WITH {SUPPLY_SQL} SELECT DISTINCT e.dst AS target, e.src AS implementation FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.etype = 'implements' AND n.package = 'Brand#11'")
def implementations_of_parts(spark, d):
    g = supply_graph(spark, d)
    return st.implementations(g, g.nodes.where("package = 'Brand#11'").select("id"))


@query(
    "references_of_suppliers",
    f"""WITH {SUPPLY_SQL}, r AS (SELECT e.dst AS target, e.src, e.etype, '' AS file_path, e.line,
  row_number() OVER (PARTITION BY e.dst ORDER BY CASE WHEN e.etype IN ('references', 'implements') THEN 0 ELSE 1 END, e.src, e.etype, e.line) AS rn, count(*) OVER (PARTITION BY e.dst) > 25 AS truncated
  FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.kind = 'class')
SELECT target, src, etype, file_path, line, truncated FROM r WHERE rn <= 25""",
)
def references_of_suppliers(spark, d):
    g = supply_graph(spark, d)
    return st.references(g, st.by_kind(g, "class").select("id"), 25)


@query("importers_of_hosts", f"WITH {WEB_SQL} SELECT e.dst AS imported, count(DISTINCT e.src) AS importers FROM edges e GROUP BY e.dst")
def importers_of_hosts(spark, d):
    g = web_graph(spark, d)
    return g.of_type("imports").groupBy(F.col("dst").alias("imported")).agg(F.countDistinct("src").alias("importers"))


@query("importers_of_external_pages", f"WITH {WEB_SQL} SELECT DISTINCT e.src AS importer FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.package = ''")
def importers_of_external_pages(spark, d):
    return st.importers(web_graph(spark, d), "")


@query(
    "external_dependencies",
    f"""WITH {WEB_SQL}, s AS (SELECT min(id) AS id FROM nodes WHERE kind = 'file'), x AS (SELECT dst AS id, 1 AS depth, min(src) AS first_caller FROM edges WHERE src IN (SELECT id FROM s) AND starts_with(dst, 'external:') GROUP BY dst),
n AS (SELECT id, regexp_extract(id, '[^/]*/?$') AS name FROM x)
SELECT id, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE '' END AS package, depth, first_caller FROM x JOIN n USING (id)""",
)
def external_dependencies(spark, d):
    """What the first page links to outside."""
    g = web_graph(spark, d)
    first = g.nodes.where("kind = 'file'").agg(F.min("id").alias("id")).withColumn("depth", F.lit(0))
    return st.external_dependencies(g, first)


@query("external_targets", f"WITH {WEB_SQL} SELECT id, count(*) AS links FROM nodes JOIN edges ON dst = id WHERE kind = 'external' GROUP BY id")
def external_targets(spark, d):
    g = web_graph(spark, d)
    return g.edges.join(st.by_kind(g, "external").select(F.col("id").alias("dst")), "dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links"))


@query(
    "package_dependencies",
    f"""WITH {SUPPLY_SQL} SELECT a.package AS src_package, b.package AS dst_package, count(*) AS edges
FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.package <> b.package GROUP BY ALL""",
)
def package_dependencies(spark, d):
    return st.package_dependencies(supply_graph(spark, d))


@query(
    "edge_partition",
    f"""WITH {SUPPLY_SQL} SELECT a.package <> b.package AS crossing, e.etype, count(*) AS edges
FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL""",
)
def edge_partition(spark, d):
    return st.edge_partition(supply_graph(spark, d))


@query("hierarchy_roll_up", f"WITH {SUPPLY_SQL} SELECT package, file_path, count(*) AS symbols FROM nodes GROUP BY ROLLUP (package, file_path)")
def hierarchy_roll_up(spark, d):
    return st.roll_up(supply_graph(spark, d))


@query("hierarchy_drill_down", f"WITH {SUPPLY_SQL} SELECT 'file' AS level, file_path AS id, count(*) AS symbols FROM nodes WHERE package = 'nation3' GROUP BY file_path")
def hierarchy_drill_down(spark, d):
    return st.drill_down(supply_graph(spark, d), "nation3")


@query("siblings", f"WITH {SUPPLY_SQL} SELECT n.id, n.name FROM nodes n JOIN nodes o ON o.id = 'c1' AND n.file_path = o.file_path AND n.kind = o.kind WHERE n.id <> 'c1'")
def siblings(spark, d):
    return st.siblings(supply_graph(spark, d), "c1").select("id", "name")


@query(
    "graph_stats",
    f"""WITH {SUPPLY_SQL} SELECT 'kind' AS what, kind AS value, count(*) AS n FROM nodes GROUP BY kind
UNION ALL SELECT 'etype', etype, count(*) FROM edges GROUP BY etype UNION ALL SELECT 'nodes', '', count(*) FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges""",
)
def graph_stats(spark, d):
    return st.graph_stats(supply_graph(spark, d))


@query("dangling_edges", f"WITH {SUPPLY_SQL}, left_over AS (SELECT id FROM nodes WHERE kind <> 'class' AND package <> 'statusP') SELECT src, dst, etype, line FROM edges WHERE src NOT IN (SELECT id FROM left_over) OR dst NOT IN (SELECT id FROM left_over)")
def dangling_edges(spark, d):
    """Edges of a graph that lost its suppliers and the pending orders."""
    g = supply_graph(spark, d)
    return st.dangling_edges(CodeGraph(g.nodes.where("kind <> 'class' AND package <> 'statusP'"), g.edges)).select("src", "dst", "etype", "line")


@query(
    "package_overview",
    f"""WITH {SUPPLY_SQL}, dep AS (SELECT DISTINCT a.package AS s, b.package AS t FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.package <> b.package)
SELECT package, count(*) AS symbols, count(*) FILTER (exported) AS exported, count(DISTINCT file_path) AS files,
  (SELECT count(*) FROM dep WHERE s = n.package) AS depends_on, (SELECT count(*) FROM dep WHERE t = n.package) AS dependents FROM nodes n GROUP BY package""",
)
def package_overview(spark, d):
    return st.package_overview(supply_graph(spark, d))


@query(
    "removed_file",
    f"""WITH {SUPPLY_SQL}, gone AS (SELECT id FROM nodes WHERE file_path = 'nation3/class.go')
SELECT etype, count(*) AS edges FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY etype""",
)
def removed_file(spark, d):
    return st.remove_file(supply_graph(spark, d), "nation3/class.go").edges.groupBy("etype").agg(F.count("*").alias("edges"))




@query(
    "call_graph_from_customer",
    f"""WITH RECURSIVE {SUPPLY_SQL}, walk AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 3),
first AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
SELECT f.id, f.depth, (SELECT min(e.src) FROM edges e JOIN first p ON p.id = e.src AND p.depth = f.depth - 1 WHERE e.dst = f.id) AS parent FROM first f""",
)
def call_graph_from_customer(spark, d):
    return tr.bfs(supply_graph(spark, d).edges, spark.createDataFrame([("c1", "c1")], "root string, id string"), 3).drop("root")


@query(
    "reverse_reach_of_supplier",
    f"""WITH RECURSIVE {SUPPLY_SQL}, walk AS (SELECT 's1' AS id, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.depth < 4)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""",
)
def reverse_reach_of_supplier(spark, d):
    return tr.bfs(supply_graph(spark, d).edges, spark.createDataFrame([("s1", "s1")], "root string, id string"), 4, reverse=True).select("id", "depth")


@query(
    "type_hierarchy_of_part",
    f"""WITH RECURSIVE {SUPPLY_SQL}, sym AS (SELECT src AS a, dst AS b FROM edges WHERE etype = 'implements' UNION SELECT dst, src FROM edges WHERE etype = 'implements'),
walk AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT s.b, w.depth + 1 FROM walk w JOIN sym s ON s.a = w.id WHERE w.depth < 2)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""",
)
def type_hierarchy_of_part(spark, d):
    return tr.type_hierarchy(supply_graph(spark, d), "p1", 2).select("id", "depth")


@query(
    "pair_distances",
    f"""WITH RECURSIVE {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), pairs AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON a.package = b.package WHERE a.name = 'signup' AND b.name IN ('purchase', 'error')),
walk AS (SELECT DISTINCT src AS root, src AS id, 0 AS depth FROM pairs UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.depth < 5),
first AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id)
SELECT p.src, p.dst, coalesce(f.depth, -1) AS length FROM pairs p LEFT JOIN first f ON f.root = p.src AND f.id = p.dst""",
)
def pair_distances(spark, d):
    g = session_graph(spark, d)
    a = g.nodes.where("name = 'signup'").select(F.col("id").alias("src"), "package")
    b = g.nodes.where("name IN ('purchase', 'error')").select(F.col("id").alias("dst"), "package")
    return tr.distances(g.edges, a.join(b, "package").select("src", "dst"), 5)
