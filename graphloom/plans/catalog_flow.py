"""Trees and control-flow analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import analytics as an
from graphloom.operators import dominators as dm
from graphloom.operators import chains, dyadic, trees
from graphloom.plans.tables import write_table
from graphloom.registry import query
from graphloom.sources.graphs import FLOW_SQL, SESSION_SQL, TREE_SQL, CodeGraph, flow_graph, geography_tree, session_graph


def _pairs(t):
    """Each customer with the supplier of the same key, and some pairs of inner nodes."""
    c = t.where(F.col("id").startswith("c")).select(F.col("id").alias("u"), F.concat(F.lit("s"), F.substring("id", 2, 20)).alias("v"))
    s = t.where(F.col("id").startswith("s")).select(F.col("id").alias("v"))
    extra = t.sparkSession.createDataFrame([("n1", "n2"), ("r0", "n24"), ("world", "c1"), ("c1", "c1")], "u string, v string")
    far = t.where(F.col("id").startswith("c") & (F.pmod("value", F.lit(3)) == 0)).select(F.col("id").alias("u"), F.col("parent").alias("p")).join(t.select(F.col("id").alias("p"), F.col("parent").alias("v")), "p").select("u", "v")
    return c.join(s, "v").select("u", "v").unionByName(extra).unionByName(far)


_PAIRS = """pairs AS (SELECT a.id AS u, b.id AS v FROM tree a JOIN tree b ON b.id = 's' || substr(a.id, 2) WHERE a.id LIKE 'c%'
  UNION ALL VALUES ('n1', 'n2'), ('r0', 'n24'), ('world', 'c1'), ('c1', 'c1') UNION ALL SELECT a.id, p.parent FROM tree a JOIN tree p ON p.id = a.parent WHERE a.id LIKE 'c%' AND ((a.value % 3) + 3) % 3 = 0),
meet AS (SELECT p.u, p.v, arg_max(a.ancestor, d.depth) AS lca, max(d.depth) AS depth FROM pairs p JOIN up a ON a.id = p.u JOIN up b ON b.id = p.v AND b.ancestor = a.ancestor JOIN depths d ON d.id = a.ancestor GROUP BY p.u, p.v)"""


@query("tree_closure", f"WITH RECURSIVE {TREE_SQL} SELECT id, ancestor, dist FROM up")
def tree_closure(spark, d):
    return trees.closure(trees.root_paths(geography_tree(spark, d)))


@query(
    "tree_lca",
    f"WITH RECURSIVE {TREE_SQL}, {_PAIRS} SELECT m.u, m.v, m.lca, a.depth + b.depth - 2 * m.depth AS distance FROM meet m JOIN depths a ON a.id = m.u JOIN depths b ON b.id = m.v",
)
def tree_lca(spark, d):
    t = geography_tree(spark, d)
    return trees.lca(trees.root_paths(t), _pairs(t)).drop("error")


@query(
    "tree_path_aggregates",
    f"""WITH RECURSIVE {TREE_SQL}, {_PAIRS}, onpath AS (
  SELECT DISTINCT m.u, m.v, a.ancestor AS id FROM meet m JOIN (SELECT u AS e, u, v FROM meet UNION ALL SELECT v, u, v FROM meet) x ON x.u = m.u AND x.v = m.v
  JOIN up a ON a.id = x.e JOIN depths d ON d.id = a.ancestor WHERE d.depth >= m.depth)
SELECT u, v, sum(value)::BIGINT AS sum, min(value) AS min, max(value) AS max, list_reduce(list_distinct(list(abs(value))), lambda a, b: gcd(a, b)) AS gcd FROM onpath JOIN tree USING (id) GROUP BY u, v""",
)
def tree_path_aggregates(spark, d):
    t = geography_tree(spark, d)
    return trees.path_aggregate(trees.root_paths(t), t.select("id", "value"), _pairs(t))


@query(
    "tree_path_segments",
    f"""WITH RECURSIVE {TREE_SQL}, {_PAIRS}, onpath AS (
  SELECT DISTINCT m.u, m.v, a.ancestor AS id FROM meet m JOIN (SELECT u AS e, u, v FROM meet UNION ALL SELECT v, u, v FROM meet) x ON x.u = m.u AND x.v = m.v
  JOIN up a ON a.id = x.e JOIN depths d ON d.id = a.ancestor WHERE d.depth >= m.depth),
sizes AS (SELECT ancestor AS id, count(*) AS size FROM up GROUP BY ancestor),
heavy AS (SELECT id FROM (SELECT t.id, row_number() OVER (PARTITION BY t.parent ORDER BY s.size DESC, t.id) AS rn FROM tree t JOIN sizes s USING (id) WHERE t.parent IS NOT NULL) WHERE rn = 1),
heads AS (SELECT u.id, arg_min(u.ancestor, u.dist) AS head FROM up u WHERE u.ancestor NOT IN (SELECT id FROM heavy) GROUP BY u.id)
SELECT u, v, count(*)::BIGINT AS nodes, sum(value)::BIGINT AS sum, min(value) AS min, max(value) AS max, count(DISTINCT head) AS segments FROM onpath JOIN tree USING (id) JOIN heads USING (id) GROUP BY u, v""",
)
def tree_path_segments(spark, d):
    """The paths of tree_path_aggregates from stretches of heavy chains, and how many each took."""
    t = geography_tree(spark, d)
    return chains.segment_aggregate(chains.heavy_chains(t), t.select("id", "value"), _pairs(t))


@query("tree_subtree_aggregates", f"WITH RECURSIVE {TREE_SQL} SELECT u.ancestor AS id, count(*) AS nodes, sum(t.value)::BIGINT AS sum, min(t.value) AS min, max(t.value) AS max, list_reduce(list_distinct(list(abs(t.value))), lambda a, b: gcd(a, b)) AS gcd FROM up u JOIN tree t ON t.id = u.id GROUP BY u.ancestor")
def tree_subtree_aggregates(spark, d):
    t = geography_tree(spark, d)
    return trees.subtree_aggregate(trees.root_paths(t), t.select("id", "value"))


@query("tree_gcd", f"WITH RECURSIVE {TREE_SQL} SELECT u.ancestor AS id, list_reduce(list_distinct(list(abs(t.value))), lambda a, b: gcd(a, b)) AS gcd FROM up u JOIN tree t ON t.id = u.id GROUP BY u.ancestor")
def tree_gcd(spark, d):
    t = geography_tree(spark, d)
    return trees.subtree_aggregate(trees.root_paths(t), t.select("id", "value")).select("id", "gcd")


@query(
    "euler_tour",
    f"""WITH RECURSIVE {TREE_SQL}, sizes AS (SELECT ancestor AS id, count(*) AS size FROM up GROUP BY ancestor),
b AS (SELECT t.id, t.parent, s.size, coalesce(sum(s.size) OVER (PARTITION BY t.parent ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN t.parent IS NULL THEN 0 ELSE 1 END AS step FROM tree t JOIN sizes s USING (id)),
i AS (SELECT u.id, sum(b.step)::BIGINT AS tin FROM up u JOIN b ON b.id = u.ancestor GROUP BY u.id),
h AS (SELECT parent AS id, arg_min(id, (-size, id)) AS heavy FROM b WHERE parent IS NOT NULL GROUP BY parent),
tops AS (SELECT b.id FROM b LEFT JOIN h ON h.id = b.parent WHERE h.heavy IS NULL OR h.heavy <> b.id), c AS (SELECT u.id, arg_min(u.ancestor, u.dist) AS head FROM up u JOIN tops t ON t.id = u.ancestor GROUP BY u.id)
SELECT b.id, b.parent, d.depth, b.size, i.tin, i.tin + b.size - 1 AS tout, h.heavy, c.head FROM b JOIN i USING (id) JOIN depths d USING (id) LEFT JOIN h USING (id) JOIN c USING (id)""",
)
def euler_tour(spark, d):
    return trees.euler_tour(trees.root_paths(geography_tree(spark, d)))


@query(
    "range_aggregates",
    """WITH v AS (SELECT o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders), r AS (SELECT c_custkey * 7 AS lo, c_custkey * 7 + 20 AS hi FROM customer)
SELECT lo, hi, coalesce(sum(value), 0)::BIGINT AS sum, coalesce(min(value), 9223372036854775807) AS min, coalesce(max(value), -9223372036854775808) AS max FROM r LEFT JOIN v ON pos BETWEEN lo AND hi GROUP BY lo, hi""",
)
def range_aggregates(spark, d):
    v = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").cast("long").alias("value"))
    r = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") * 7).alias("lo"), (F.col("c_custkey") * 7 + 20).alias("hi"))
    return trees.range_aggregate_binned(v, r, 64).drop("gcd")


@query(
    "range_updates",
    """WITH v AS (SELECT o_orderkey AS pos, 0::BIGINT AS value FROM orders), u AS (SELECT c_custkey * 3 AS lo, c_custkey * 3 + 50 AS hi, c_nationkey::BIGINT AS delta FROM customer)
SELECT pos, (value + coalesce((SELECT sum(delta) FROM u WHERE pos BETWEEN lo AND hi), 0))::BIGINT AS value FROM v""",
)
def range_updates(spark, d):
    v = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.lit(0).cast("long").alias("value"))
    u = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") * 3).alias("lo"), (F.col("c_custkey") * 3 + 50).alias("hi"), F.col("c_nationkey").cast("long").alias("delta"))
    return trees.range_update(v, u)


def _order_values(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").cast("long").alias("value"))


def _long_ranges(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("lo"), (F.col("c_custkey") * (F.col("c_nationkey") + 1)).alias("hi"))


_LONG_SQL = """v AS (SELECT o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders), r AS (SELECT DISTINCT c_custkey AS lo, c_custkey * (c_nationkey + 1) AS hi FROM customer)"""


@query(
    "dyadic_ranges",
    f"WITH {_LONG_SQL} SELECT lo, hi, count(value) AS n, sum(value)::BIGINT AS sum, min(value) AS min, max(value) AS max FROM r LEFT JOIN v ON pos BETWEEN lo AND hi GROUP BY lo, hi",
)
def dyadic_ranges(spark, d):
    """Ranges of up to the whole table of orders, each from at most two nodes a level."""
    v = _order_values(spark, d)
    levels = dyadic.levels_of(v)
    return dyadic.range_aggregate(dyadic.dyadic_nodes(v, levels), _long_ranges(spark, d), levels)


@query(
    "dyadic_pending_sums",
    f"""WITH {_LONG_SQL}, u AS (SELECT c_custkey AS lo, c_custkey * (c_nationkey + 1) AS hi, CAST(floor(c_acctbal) AS BIGINT) AS delta FROM customer),
w AS (SELECT pos, value + coalesce((SELECT sum(delta) FROM u WHERE pos BETWEEN lo AND hi), 0) AS value FROM v)
SELECT lo, hi, count(value) AS n, sum(value)::BIGINT AS sum FROM r LEFT JOIN w ON pos BETWEEN lo AND hi GROUP BY lo, hi""",
)
def dyadic_pending_sums(spark, d):
    """The same ranges after additions to each, which wait on nodes: no order is rewritten."""
    v, r = _order_values(spark, d), _long_ranges(spark, d)
    levels = dyadic.levels_of(v)
    delta = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("lo"), (F.col("c_custkey") * (F.col("c_nationkey") + 1)).alias("hi"), F.floor("c_acctbal").cast("long").alias("delta"))
    return dyadic.updated_sums(dyadic.dyadic_nodes(v, levels), dyadic.lazy_updates(delta, levels), r, levels)


_DOM = f"""{FLOW_SQL}, sup AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
part_of AS (SELECT f.dst AS id, count(DISTINCT s.id) AS s, min(s.id) AS s1, count(DISTINCT s.n) AS n, min(s.n) AS n1, count(DISTINCT s.r) AS r, min(s.r) AS r1 FROM flow f JOIN sup s ON s.id = f.src GROUP BY f.dst),
dom AS (SELECT dst AS id, src AS idom FROM flow WHERE dst NOT LIKE 'p%' UNION ALL SELECT 'world', 'world'
  UNION ALL SELECT id, CASE WHEN s = 1 THEN s1 WHEN n = 1 THEN n1 WHEN r = 1 THEN r1 ELSE 'world' END FROM part_of)"""


def _flow(spark, d):
    """The flow graph, worked out once for all that reads it."""
    return write_table(flow_graph(spark, d), "flow")


@query("dominators_flow", f"WITH {_DOM} SELECT id, idom FROM dom")
def dominators_flow(spark, d):
    return dm.dominators(_flow(spark, d), "world").select("id", "idom")


@query(
    "dominance_frontier_flow",
    f"""WITH RECURSIVE {_DOM}, anc AS (SELECT id, id AS a FROM dom UNION SELECT x.id, d.idom FROM anc x JOIN dom d ON d.id = x.a)
SELECT DISTINCT x.a AS id, f.dst AS frontier FROM flow f JOIN anc x ON x.id = f.src WHERE NOT EXISTS (SELECT 1 FROM anc y WHERE y.id = f.dst AND y.a = x.a AND y.a <> f.dst)""",
)
def dominance_frontier_flow(spark, d):
    e = _flow(spark, d)
    return dm.dominance_frontier(e, dm.dominators(e, "world"))


@query("edge_classes_flow", f"WITH RECURSIVE {_DOM}, anc AS (SELECT id, id AS a FROM dom UNION SELECT x.id, d.idom FROM anc x JOIN dom d ON d.id = x.a) SELECT f.src, f.dst, CASE WHEN EXISTS (SELECT 1 FROM anc x WHERE x.id = f.src AND x.a = f.dst) THEN 'back' WHEN EXISTS (SELECT 1 FROM anc x WHERE x.id = f.dst AND x.a = f.src) THEN 'forward' ELSE 'cross' END AS class FROM flow f")
def edge_classes_flow(spark, d):
    e = _flow(spark, d)
    return dm.edge_classes(e, dm.dominators(e, "world"))


@query("reducibility_flow")
def reducibility_flow(spark, d):
    e = _flow(spark, d)
    return dm.reducibility(e, dm.dominators(e, "world"))


@query("post_dominators_flow")
def post_dominators_flow(spark, d):
    return dm.post_dominators(_flow(spark, d)).select("id", "idom")


#: Control flow of each user's events, from "start" to "end", and dominance by its definition: without the dominator, the node isn't reached.
_CFG = f"""{SESSION_SQL}, places AS (SELECT package AS u, arg_min(id, (ts, event_id)) AS first, arg_max(id, (ts, event_id)) AS last FROM (SELECT *, CAST(user_id AS VARCHAR) AS package FROM ev) GROUP BY package),
users AS (SELECT package AS u, id FROM nodes), steps AS (SELECT n.package AS u, e.src, e.dst FROM edges e JOIN nodes n ON n.id = e.src UNION ALL SELECT u, 'start', first FROM places),
cfg AS (SELECT DISTINCT * FROM steps), back_cfg AS (SELECT * FROM cfg UNION SELECT u, last, 'end' FROM places),
fw AS (SELECT u, id AS gone, 'start' AS id FROM users UNION SELECT f.u, f.gone, c.dst FROM fw f JOIN cfg c ON c.u = f.u AND c.src = f.id WHERE c.dst <> f.gone),
dom AS (SELECT a.u, d.id AS d, a.id AS n FROM users a JOIN users d ON d.u = a.u AND d.id <> a.id WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.u = a.u AND fw.gone = d.id AND fw.id = a.id)
  UNION ALL SELECT u, 'start', id FROM users),
doms AS (SELECT u, n, d, (SELECT count(*) FROM dom y WHERE y.u = x.u AND y.n = x.d) AS depth FROM dom x),
bw AS (SELECT u, id AS gone, 'end' AS id FROM users UNION SELECT f.u, f.gone, c.src FROM bw f JOIN back_cfg c ON c.u = f.u AND c.dst = f.id WHERE c.src <> f.gone),
pdom AS (SELECT a.u, d.id AS d, a.id AS n FROM users a JOIN users d ON d.u = a.u AND d.id <> a.id WHERE NOT EXISTS (SELECT 1 FROM bw WHERE bw.u = a.u AND bw.gone = d.id AND bw.id = a.id)
  UNION ALL SELECT u, 'end', id FROM users),
pdoms AS (SELECT u, n, d, (SELECT count(*) FROM pdom y WHERE y.u = x.u AND y.n = x.d) AS depth FROM pdom x),
ipdom AS (SELECT u, n, arg_max(d, depth) AS d FROM pdoms GROUP BY u, n)"""


def _loops(spark, d):
    """Transitions of the events of each user, entered at each user's first event."""
    return _session_flow(spark, d)[0]


def _session_flow(spark, d):
    """Transitions from "start" on, and the same with "end" after each user's last event."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("u"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("id"), F.struct("ts", "event_id").alias("at"))
    ends = e.groupBy("u").agg(F.min_by("id", "at").alias("first"), F.max_by("id", "at").alias("last"))
    flow = session_graph(spark, d).edges.select("src", "dst").unionByName(ends.select(F.lit("start").alias("src"), F.col("first").alias("dst")))
    return flow, flow.unionByName(ends.select(F.col("last").alias("src"), F.lit("end").alias("dst")))


@query("dominators_sessions", f"WITH RECURSIVE {_CFG} SELECT n AS id, arg_max(d, depth) AS idom FROM doms GROUP BY u, n UNION ALL SELECT 'start', 'start'")
def dominators_sessions(spark, d):
    return dm.dominators(_loops(spark, d), "start").select("id", "idom")


@query("post_dominators_sessions", f"WITH RECURSIVE {_CFG} SELECT n AS id, d AS idom FROM ipdom UNION ALL SELECT 'start', 'end' UNION ALL SELECT 'end', 'end'")
def post_dominators_sessions(spark, d):
    return dm.post_dominators(_session_flow(spark, d)[1], "end").select("id", "idom")


@query(
    "control_dependence_sessions",
    f"""WITH RECURSIVE {_CFG}, all_steps AS (SELECT * FROM steps UNION ALL SELECT u, last, 'end' FROM places), branch AS (SELECT src FROM all_steps GROUP BY src HAVING count(*) >= 2),
up AS (SELECT u, n, d FROM pdom UNION ALL SELECT u, id, id FROM users)
SELECT DISTINCT p.d AS id, c.src AS depends_on FROM back_cfg c JOIN branch USING (src) JOIN up p ON p.u = c.u AND p.n = c.dst
WHERE p.d <> 'end' AND NOT EXISTS (SELECT 1 FROM pdom q WHERE q.u = c.u AND q.n = c.src AND q.d = p.d)""",
)
def control_dependence_sessions(spark, d):
    e = _session_flow(spark, d)[1]
    return dm.control_dependence(e, dm.post_dominators(e, "end"))


@query(
    "sese_regions_sessions",
    f"""WITH RECURSIVE {_CFG}, down AS (SELECT u, d, n FROM dom UNION ALL SELECT u, id, id FROM users), up AS (SELECT u, d, n FROM pdom UNION ALL SELECT u, id, id FROM users)
SELECT p.n AS entry, p.d AS exit, (SELECT count(*) FROM down a JOIN up b ON b.u = a.u AND b.n = a.n WHERE a.u = p.u AND a.d = p.n AND b.d = p.d) AS size FROM ipdom p JOIN dom x ON x.u = p.u AND x.d = p.n AND x.n = p.d
UNION ALL SELECT 'start', 'end', (SELECT count(*) FROM users) + 2""",
)
def sese_regions_sessions(spark, d):
    e = _session_flow(spark, d)[1]
    return dm.sese_regions(e, dm.dominators(e, "start"), dm.post_dominators(e, "end"))


@query(
    "reducibility_sessions",
    f"""WITH RECURSIVE {_CFG}, down AS (SELECT u, d, n FROM dom UNION ALL SELECT u, id, id FROM users UNION ALL SELECT u, 'start', 'start' FROM places),
k AS (SELECT s.u, s.src, s.dst, CASE WHEN EXISTS (SELECT 1 FROM down x WHERE x.u = s.u AND x.d = s.dst AND x.n = s.src) THEN 'back' WHEN EXISTS (SELECT 1 FROM down x WHERE x.u = s.u AND x.d = s.src AND x.n = s.dst) THEN 'forward' ELSE 'cross' END AS class FROM steps s),
live AS (SELECT DISTINCT src, dst FROM k WHERE class <> 'back'), t AS (SELECT src, dst FROM live UNION SELECT t.src, l.dst FROM t JOIN live l ON l.src = t.dst),
cyc AS (SELECT src AS id FROM t WHERE src = dst), stuck AS ((SELECT id FROM cyc) UNION (SELECT a.dst FROM t a JOIN cyc c ON c.id = a.src JOIN t b ON b.src = a.dst JOIN cyc e ON e.id = b.dst)),
n AS (SELECT count(*) AS s FROM stuck), v AS (SELECT count(*) + 1 AS v FROM users)
SELECT s = 0 AS is_reducible, count(*) FILTER (class = 'back') AS back_edges, count(*) FILTER (class = 'forward') AS forward_edges, count(*) FILTER (class = 'cross') AS cross_edges, s AS irreducible_nodes, round(1 - s / v, 4) AS score FROM k, n, v GROUP BY s, v""",
)
def reducibility_sessions(spark, d):
    e = _loops(spark, d)
    return dm.reducibility(e, dm.dominators(e, "start"))


@query(
    "natural_loops_sessions",
    f"""WITH RECURSIVE {_CFG}, down AS (SELECT u, d, n FROM dom UNION ALL SELECT u, id, id FROM users),
back AS (SELECT s.u, s.src AS tail, s.dst AS header FROM steps s JOIN down x ON x.u = s.u AND x.d = s.dst AND x.n = s.src),
body AS (SELECT header, header AS id FROM back UNION SELECT header, tail FROM back UNION SELECT b.header, c.src FROM body b JOIN cfg c ON c.dst = b.id WHERE b.id <> b.header),
sizes AS (SELECT header, count(*) AS size, (SELECT count(*) FROM back k WHERE k.header = b.header) AS back_edges FROM body b GROUP BY header),
nest AS (SELECT s.header, arg_min(o.header, (o.size, o.header)) AS parent FROM sizes s JOIN body b ON b.id = s.header AND b.header <> s.header JOIN sizes o ON o.header = b.header WHERE o.size > s.size OR o.size = s.size AND o.header < s.header GROUP BY s.header),
levels AS (SELECT header, 1 AS depth FROM sizes WHERE header NOT IN (SELECT header FROM nest) UNION ALL SELECT n.header, l.depth + 1 FROM levels l JOIN nest n ON n.parent = l.header)
SELECT s.header, size, back_edges, parent, depth FROM sizes s LEFT JOIN nest USING (header) JOIN levels USING (header)""",
)
def natural_loops_sessions(spark, d):
    e = _loops(spark, d)
    return dm.natural_loops(e, dm.dominators(e, "start"))[0]


@query(
    "dominators_deep",
    """SELECT 'o' || a.o_orderkey AS id, 'o' || CASE WHEN c.o_orderkey % 7 = 0 THEN c.o_orderkey ELSE b.o_orderkey END AS parent
FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 LEFT JOIN orders c ON c.o_orderkey = a.o_orderkey - 2""",
)
def dominators_deep(spark, d):
    """All orders as one chain: each key leads to the next and every seventh also to the one after it, so the graph is as deep as the table is long."""
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    steps = keys.select("k", F.explode(F.when(F.col("k") % 7 == 0, F.array(F.col("k") + 1, F.col("k") + 2)).otherwise(F.array(F.col("k") + 1))).alias("to"))
    steps = steps.join(keys.withColumnRenamed("k", "to"), "to", "left_semi")
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    return dm.dominator_tree(steps.select(name("k").alias("src"), name("to").alias("dst")), "o" + str(keys.agg(F.min("k")).first()[0]))


@query("control_dependence_flow")
def control_dependence_flow(spark, d):
    e = _flow(spark, d)
    return dm.control_dependence(e, dm.post_dominators(e))


@query("sese_regions_flow")
def sese_regions_flow(spark, d):
    e = _flow(spark, d)
    return dm.sese_regions(e, dm.dominators(e, "world"), dm.post_dominators(e))


@query("critical_path_flow", f"WITH RECURSIVE {_DOM}, up AS (SELECT id, idom, 0 AS back FROM dom WHERE id = 'p1' UNION ALL SELECT d.id, d.idom, u.back + 1 FROM up u JOIN dom d ON d.id = u.idom WHERE u.idom <> u.id) SELECT (max(back) OVER () - back)::INTEGER AS at, id FROM up")
def critical_path_flow(spark, d):
    return dm.critical_path(dm.dominators(_flow(spark, d), "world"), "p1")


@query("weighted_criticality_flow")
def weighted_criticality_flow(spark, d):
    e = _flow(spark, d)
    dom = dm.dominators(e, "world")
    return dm.weighted_criticality(dom, an.pagerank(CodeGraph(dom.select("id"), e)))
