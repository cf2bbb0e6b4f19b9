"""Centrality, cycles, communities and components over the supplied graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import analytics as an
from graphloom.operators.articulation import articulation
from graphloom.operators.components import connected_components
from graphloom.registry import query
from graphloom.sources.graphs import SESSION_SQL, SUPPLY_SQL, WEB_SQL, session_graph, supply_graph, web_graph

_DEGREES = """deg AS (SELECT n.id, n.kind, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM nodes n
  LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id)"""


@query(
    "hotspots_supply",
    f"""WITH {SUPPLY_SQL}, {_DEGREES} SELECT row_number() OVER (ORDER BY 2 * in_degree + out_degree DESC, id) AS rank, id, in_degree, out_degree, 2 * in_degree + out_degree AS score
FROM deg WHERE kind <> 'external' ORDER BY score DESC, id LIMIT 20""",
)
def hotspots_supply(spark, d):
    return an.hot_spots(supply_graph(spark, d), 20)


@query("degrees_web", f"WITH {WEB_SQL}, {_DEGREES} SELECT id, kind, in_degree, out_degree FROM deg")
def degrees_web(spark, d):
    return an.degrees(web_graph(spark, d))


@query(
    "dead_code_supply",
    f"""WITH {SUPPLY_SQL} SELECT id, name, file_path, CASE WHEN exported THEN 'exported but unreferenced' ELSE 'unreferenced' END AS reason
FROM nodes WHERE id NOT IN (SELECT dst FROM edges)""",
)
def dead_code_supply(spark, d):
    return an.dead_code(supply_graph(spark, d))


@query(
    "package_coupling",
    f"""WITH {SUPPLY_SQL}, p AS (SELECT DISTINCT a.package AS s, b.package AS t FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.package <> b.package),
k AS (SELECT package, count(*) FILTER (kind = 'interface') AS i, count(*) FILTER (kind IN ('interface', 'struct', 'class')) AS t,
  (SELECT count(*) FROM p WHERE t = n.package) AS afferent, (SELECT count(*) FROM p WHERE s = n.package) AS efferent FROM nodes n GROUP BY package)
SELECT package, afferent, efferent, CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent) ELSE 0.0 END AS instability, CASE WHEN t > 0 THEN i / t ELSE 0.0 END AS abstractness FROM k""",
)
def package_coupling(spark, d):
    return an.package_coupling(supply_graph(spark, d))


@query("entry_nodes_web", f"WITH {WEB_SQL} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def entry_nodes_web(spark, d):
    return an.entry_nodes(web_graph(spark, d)).select("id")


@query("exit_nodes_web", f"WITH {WEB_SQL} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def exit_nodes_web(spark, d):
    return an.exit_nodes(web_graph(spark, d))


def _pagerank_sql(base: str, rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM outs)) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.s, 0) AS rank"
            f" FROM nodes n LEFT JOIN (SELECT l.dst, sum(r.rank * l.share) AS s FROM links l JOIN r{k} r ON r.id = l.src GROUP BY l.dst) g ON g.dst = n.id)"
        )
    return (
        f"WITH {base}, outs AS (SELECT src, count(*) AS c FROM edges GROUP BY src), links AS (SELECT e.src, e.dst, count(*) / any_value(o.c) AS share FROM edges e JOIN outs o ON o.src = e.src GROUP BY e.src, e.dst), "
        + ", ".join(steps)
        + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"
    )


@query("pagerank_supply", _pagerank_sql(SUPPLY_SQL, 6))
def pagerank_supply(spark, d):
    return an.pagerank(supply_graph(spark, d), max_iterations=6, tolerance=0.0).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_converged_supply")
def pagerank_converged_supply(spark, d):
    """Until no rank moves by 1e-6; pagerank_supply ends after the six iterations that its SQL unrolls."""
    return an.pagerank(supply_graph(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_top_sessions")
def pagerank_top_sessions(spark, d):
    return an.pagerank_top(session_graph(spark, d), 50)


_REACH = "e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)"


@query(
    "cyclic_dependencies",
    f"""WITH RECURSIVE {SESSION_SQL}, {_REACH}, cyc AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT component, count(*) AS length, list_sort(list(DISTINCT n.package)) AS packages FROM cyc JOIN nodes n USING (id) GROUP BY component""",
)
def cyclic_dependencies(spark, d):
    return an.cyclic_dependencies(session_graph(spark, d))


@query(
    "components_web",
    f"""WITH RECURSIVE {WEB_SQL}, sym AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT a AS id, a AS root FROM sym UNION SELECT s.b, w.root FROM walk w JOIN sym s ON s.a = w.id)
SELECT id, min(root) AS component FROM walk GROUP BY id""",
)
def components_web(spark, d):
    return connected_components(web_graph(spark, d).edges)


@query(
    "modularity_by_package",
    f"""WITH {SUPPLY_SQL}, m AS (SELECT count(*) AS m FROM edges), i AS (SELECT a.package AS c, count(*) AS e FROM edges x JOIN nodes a ON a.id = x.src JOIN nodes b ON b.id = x.dst WHERE a.package = b.package GROUP BY a.package),
g AS (SELECT package AS c, count(*) AS k FROM nodes JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) USING (id) GROUP BY package)
SELECT round(sum(coalesce(e, 0) / m - pow(k / (2 * m), 2)), 9) AS modularity FROM g LEFT JOIN i USING (c), m""",
)
def modularity_by_package(spark, d):
    g = supply_graph(spark, d)
    return an.modularity(g, g.nodes.select("id", F.col("package").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


@query(
    "communities_sessions",
    f"""WITH {SESSION_SQL} SELECT min(n.id) AS community, count(*) AS size, n.package, any_value(e.internal) AS internal, 0::BIGINT AS external, 1.0::DOUBLE AS connectivity
FROM nodes n LEFT JOIN (SELECT split_part(src, '/', 1) AS package, count(*) AS internal FROM edges GROUP BY ALL) e USING (package) GROUP BY n.package""",
)
def communities_sessions(spark, d):
    """A user's event types are a component of their own, and none is worth splitting in a graph of many users: each is a community."""
    g = session_graph(spark, d)
    return an.community_summary(g, an.communities(g))


@query(
    "community_summary_by_package",
    f"""WITH {SUPPLY_SQL}, x AS (SELECT a.package AS s, b.package AS t, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL),
k AS (SELECT package, count(*) AS size, (SELECT coalesce(sum(n), 0) FROM x WHERE s = q.package AND t = q.package) AS internal, (SELECT coalesce(sum(n), 0) FROM x WHERE (s = q.package OR t = q.package) AND s <> t) AS external FROM nodes q GROUP BY package)
SELECT package AS community, size, package, internal::BIGINT AS internal, external::BIGINT AS external, CASE WHEN size = 1 THEN 1.0 WHEN internal + external > 0 THEN internal / (internal + external) ELSE 0.0 END AS connectivity FROM k""",
)
def community_summary_by_package(spark, d):
    g = supply_graph(spark, d)
    return an.community_summary(g, g.nodes.select("id", F.col("package").alias("community")))


@query(
    "articulation_web",
    f"""WITH RECURSIVE {WEB_SQL}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), sym AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
deg AS (SELECT x, min(y) AS one FROM sym GROUP BY x HAVING count(*) > 1),
cut AS (SELECT x AS gone, one AS id FROM deg UNION SELECT c.gone, s.y FROM cut c JOIN sym s ON s.x = c.id WHERE s.y <> c.gone),
split AS (SELECT a, b, a AS id FROM p UNION SELECT t.a, t.b, s.y FROM split t JOIN sym s ON s.x = t.id WHERE NOT (s.x = t.a AND s.y = t.b OR s.x = t.b AND s.y = t.a))
SELECT DISTINCT 'point' AS kind, d.x AS a, CAST(NULL AS VARCHAR) AS b FROM deg d JOIN sym s USING (x) WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.gone = d.x AND c.id = s.y)
UNION ALL SELECT 'bridge', a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM split t WHERE t.a = p.a AND t.b = p.b AND t.id = p.b)""",
)
def articulation_web(spark, d):
    """Cut nodes and edges; the SQL takes each away and looks at what is still reached."""
    return articulation(web_graph(spark, d).edges)


@query("file_classes_supply")
def file_classes_supply(spark, d):
    return an.file_classes(supply_graph(spark, d))
