"""Impact and code findings over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import analytics as an
from graphloom.operators import code, explore, impact
from graphloom.registry import query
from graphloom.sources.graphs import SESSION_SQL, SUPPLY_SQL, CodeGraph, session_graph, supply_graph


_BLAST = """w AS (SELECT id AS root, id, 0 AS depth FROM t UNION SELECT w.root, e.src, w.depth + 1 FROM w JOIN edges e ON e.dst = w.id AND e.etype = 'calls' WHERE w.depth < 3),
f AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id), i AS (SELECT DISTINCT e.dst AS root, e.src AS id FROM edges e JOIN t ON t.id = e.dst WHERE e.etype IN ('implements', 'embeds')),
h AS (SELECT root, n.file_path FROM (SELECT root, id FROM f WHERE depth > 0 UNION SELECT root, id FROM i) JOIN nodes n USING (id)),
c AS (SELECT t.id, (SELECT count(*) FROM f WHERE root = t.id AND depth = 1) AS direct, (SELECT count(*) FROM f WHERE root = t.id AND depth > 1) AS indirect, (SELECT count(*) FROM i WHERE root = t.id) AS implementers,
  (SELECT count(DISTINCT file_path) FROM h WHERE root = t.id) AS files, 0::BIGINT AS tests FROM t)
SELECT *, CASE WHEN direct >= 20 THEN 'critical' WHEN direct >= 10 THEN 'high' WHEN direct >= 4 THEN 'medium' ELSE 'low' END AS risk FROM c"""


@query("blast_radius_orders", f"WITH RECURSIVE {SUPPLY_SQL}, t AS (SELECT id FROM nodes WHERE package = 'statusP'), {_BLAST}")
def blast_radius_orders(spark, d):
    g = supply_graph(spark, d)
    return impact.blast_radius(g, g.nodes.where("package = 'statusP'").select("id"))


@query("blast_radius_parts", f"WITH RECURSIVE {SUPPLY_SQL}, t AS (SELECT id FROM nodes WHERE package = 'Brand#11'), {_BLAST}")
def blast_radius_parts(spark, d):
    """Parts have implementers and no callers."""
    g = supply_graph(spark, d)
    return impact.blast_radius(g, g.nodes.where("package = 'Brand#11'").select("id"))


@query("blast_radius_sessions", f"WITH RECURSIVE {SESSION_SQL}, t AS (SELECT id FROM nodes WHERE name = 'purchase'), {_BLAST}")
def blast_radius_sessions(spark, d):
    g = session_graph(spark, d)
    return impact.blast_radius(g, g.nodes.where("name = 'purchase'").select("id"))


@query(
    "coverage_sessions",
    f"""WITH RECURSIVE {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT id, 0 AS depth FROM nodes WHERE name = 'signup' AND package < '3' UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.id WHERE w.depth < 4),
f AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT n.id, f.depth, CASE WHEN f.depth = 1 THEN 'direct' WHEN f.depth > 1 THEN 'indirect' WHEN f.depth = 0 THEN 'test' ELSE 'none' END AS coverage FROM nodes n LEFT JOIN f USING (id)""",
)
def coverage_sessions(spark, d):
    g = session_graph(spark, d)
    return impact.coverage(g, g.nodes.where("name = 'signup' AND package < '3'").select("id"), 4)


def _taint_sql(depth: int) -> str:
    """States level by level: clicks sanitize completely, views in part."""
    level = "CASE b.name WHEN 'click' THEN 2 WHEN 'view' THEN 1 END"
    steps = ["t0 AS (SELECT id AS source, id, 0 AS state, 0 AS came, 0 AS depth FROM nodes WHERE name = 'signup')"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT source, id FROM t{i}" for i in range(k))
        steps.append(
            f"t{k} AS (SELECT t.source, e.dst AS id, min(coalesce({level}, t.state)) AS state, min(t.state) AS came, {k} AS depth FROM t{k - 1} t JOIN e ON e.src = t.id JOIN nodes b ON b.id = e.dst"
            f" WHERE (t.source, e.dst) NOT IN (SELECT (source, id) FROM ({before})) GROUP BY t.source, e.dst)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(depth + 1))
    return (
        f"WITH {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), {', '.join(steps)}, seen AS ({every}) "
        "SELECT s.source, s.id AS sink, 'CWE-89' AS cwe, s.depth, CASE s.state WHEN 0 THEN 'untrusted' WHEN 1 THEN 'mixed' ELSE 'clean' END AS state, "
        "s.came < 2 AND NOT EXISTS (SELECT 1 FROM seen c JOIN nodes m ON m.id = c.id AND m.name = 'click' WHERE c.source = s.source AND c.depth < s.depth) AS vulnerable "
        "FROM seen s JOIN nodes n ON n.id = s.id WHERE n.name IN ('purchase', 'error') AND s.depth > 0"
    )


@query("taint_sessions", _taint_sql(4))
def taint_sessions(spark, d):
    g = session_graph(spark, d)
    at = lambda *names: g.nodes.where(F.col("name").isin(*names)).select("id", "name")
    clean = at("view", "click").select("id", (F.col("name") == "click").alias("complete"))
    return impact.taint(g, at("signup").select("id"), clean, at("purchase", "error").select("id", F.lit("CWE-89").alias("cwe")), 4).drop("truncated")


@query(
    "zone_crossings",
    f"""WITH {SUPPLY_SQL} SELECT e.src, e.dst, a.kind AS src_zone, b.kind AS dst_zone, NOT (a.kind = 'function' AND b.kind = 'struct') AS violation FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.kind <> b.kind""",
)
def zone_crossings(spark, d):
    g = supply_graph(spark, d)
    allowed = spark.createDataFrame([("function", "struct")], "src_zone string, dst_zone string")
    return impact.zone_crossings(g, g.nodes.select("id", F.col("kind").alias("zone")), allowed)


@query(
    "circular_packages",
    f"""WITH RECURSIVE {SUPPLY_SQL}, e AS (SELECT DISTINCT a.package AS src, b.package AS dst FROM edges x JOIN nodes a ON a.id = x.src JOIN nodes b ON b.id = x.dst WHERE a.package <> b.package),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
c AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT component, count(*) AS length, CASE WHEN count(*) > 5 THEN 'error' WHEN count(*) > 2 THEN 'warning' ELSE 'info' END AS severity FROM c GROUP BY component""",
)
def circular_packages(spark, d):
    return impact.circular_dependencies(supply_graph(spark, d), "package")


@query(
    "topological_levels",
    """WITH n AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END AS level FROM nation)
SELECT 'r' || n_regionkey AS id, max(level) + 1 AS level FROM n GROUP BY n_regionkey UNION ALL SELECT 'n' || n_nationkey, level FROM n UNION ALL SELECT 's' || s_suppkey, 0 FROM supplier""",
)
def topological_levels(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"))
    return impact.topological_levels(n.unionByName(s))[0]


@query(
    "rule_actions",
    """WITH f AS (SELECT c_custkey AS id, list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END], lambda x: x IS NOT NULL)) AS rules FROM customer)
SELECT id, CASE WHEN list_contains(rules, 'debt') THEN 'block' WHEN list_contains(rules, 'rich') THEN 'review' ELSE 'notify' END AS action, rules FROM f WHERE len(rules) > 0""",
)
def rule_actions(spark, d):
    f = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    return impact.apply_rules(f, [("debt", "c_acctbal < 0", "block"), ("rich", "c_acctbal > 5000", "review"), ("segment", "c_mktsegment = 'BUILDING'", "notify")])


@query(
    "module_api",
    f"""WITH {SUPPLY_SQL} SELECT b.package AS community, e.dst AS id, count(DISTINCT e.src) AS external_callers FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.etype = 'calls' AND a.package <> b.package GROUP BY ALL""",
)
def module_api(spark, d):
    g = supply_graph(spark, d)
    return impact.module_api(g, g.nodes.select("id", F.col("package").alias("community")))


@query(
    "federated_edges",
    """WITH r AS (SELECT DISTINCT 'n' || s_nationkey AS target, CAST(s_suppkey AS VARCHAR) AS path FROM supplier), i AS (SELECT 'n' || c_nationkey AS repo, CAST(l_suppkey AS VARCHAR) AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT repo, target, count(*) AS edges, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM i JOIN r USING (path) WHERE repo <> target GROUP BY repo, target""",
)
def federated_edges(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    repos = t("supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("repo"), F.col("s_suppkey").cast("string").alias("path"))
    i = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return impact.federation(repos, i.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"), F.col("l_suppkey").cast("string").alias("path")))


@query(
    "change_impact_parts",
    """WITH f AS (SELECT l_partkey AS id, count(*) AS callers FROM lineitem GROUP BY l_partkey),
s AS (SELECT p_partkey AS id, round(0.30 * (p_size > 40)::INT + 0.25 * least(coalesce(callers, 0) / 20, 1.0) + 0.20 * CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 0.5 ELSE 1 END + 0.15 * CASE WHEN p_size % 4 > 0 THEN least(1.0, 0.5 + 0.25 * (p_size % 4 - 1)) ELSE 0 END + 0.10 * (p_retailprice > 1000)::INT, 9) AS score FROM part LEFT JOIN f ON f.id = p_partkey)
SELECT id, score, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM s""",
)
def change_impact_parts(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("callers"))
    p = spark.read.parquet(f"{d}/part.parquet").join(n, "p_partkey", "left").na.fill(0, ["callers"])
    tests = F.when(F.col("p_size") % 3 == 0, "direct").when(F.col("p_size") % 3 == 1, "indirect").otherwise("none")
    score = F.round(impact.change_impact(F.col("p_size") > 40, F.col("callers"), tests, F.col("p_size") % 4, F.col("p_retailprice") > 1000), 9)
    return p.select(F.col("p_partkey").alias("id"), score.alias("score")).withColumn("level", impact.impact_level(F.col("score")))


@query(
    "secret_scan_documents",
    r"""WITH p(rule, severity, pattern) AS (VALUES ('assigned_token', 'high', '(?i)\b(token|secret|password|api_key)\s*=\s*["''][^"'']{8,}["'']'), ('email', 'low', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}'))
SELECT doc_id AS id, rule, severity, len(regexp_extract_all(text, pattern))::BIGINT AS hits FROM documents, p WHERE regexp_matches(text, pattern)""",
)
def secret_scan_documents(spark, d):
    p = spark.createDataFrame(code.SECRET_PATTERNS, "rule string, severity string, pattern string").where("rule IN ('assigned_token', 'email')")
    return code.scan_patterns(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), p)


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_RULES_SQL = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in code.SECRET_PATTERNS)


@query(
    "secret_scan_all_documents",
    f"""WITH p(rule, severity, pattern) AS (VALUES {_RULES_SQL})
SELECT doc_id AS id, rule, severity, len(regexp_extract_all(text, pattern))::BIGINT AS hits FROM documents, p WHERE regexp_matches(text, pattern)""",
)
def secret_scan_all_documents(spark, d):
    """All rules; secret_scan_documents, whose SQL has two, is the part of them that it was."""
    p = spark.createDataFrame(code.SECRET_PATTERNS, "rule string, severity string, pattern string")
    return code.scan_patterns(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), p)


@query(
    "naming_conventions",
    f"""WITH {SUPPLY_SQL}, s AS (SELECT kind, CASE WHEN regexp_matches(name, '^[A-Z][A-Z0-9_]+$') THEN 'UPPER' WHEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') THEN 'Pascal' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(name, '^[a-z][A-Za-z0-9]*$') THEN 'camel' ELSE 'other' END AS style FROM nodes),
c AS (SELECT kind, style, count(*) AS n FROM s GROUP BY ALL) SELECT 'go' AS language, kind, style, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM c QUALIFY share >= 0.3""",
)
def naming_conventions(spark, d):
    return code.naming_conventions(supply_graph(spark, d).nodes)


@query(
    "satisfied_interfaces",
    """WITH m AS (SELECT DISTINCT l_orderkey AS type, p_brand AS method FROM lineitem JOIN part ON p_partkey = l_partkey),
i AS (SELECT DISTINCT n_name AS interface, p_brand AS method FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_size = s_nationkey + 1 AND p_retailprice > 990), z AS (SELECT interface, count(*) AS n FROM i GROUP BY interface)
SELECT 'o' || m.type AS type, i.interface FROM m JOIN i USING (method) JOIN z USING (interface) GROUP BY m.type, i.interface, n HAVING count(DISTINCT method) = n""",
)
def satisfied_interfaces(spark, d):
    """Orders that have a part of each brand that a nation asks for."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    go = F.lit("go").alias("language")
    types = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("type"), go, F.col("p_brand").alias("method"))
    asked = t("supplier").select("s_nationkey").distinct().join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("part").where("p_retailprice > 990"), F.col("p_size") == F.col("s_nationkey") + 1)
    return code.satisfied_interfaces(types, asked.select(F.col("n_name").alias("interface"), go, F.col("p_brand").alias("method")))


def _named_sessions(spark, d, names: dict[str, str]):
    """The session graph with other names for its event types."""
    g = session_graph(spark, d)
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return CodeGraph(g.nodes.withColumn("name", F.coalesce(name[F.col("name")], F.col("name"))), g.edges)


@query(
    "design_patterns",
    f"""WITH {SESSION_SQL}, p(name, pattern, base) AS (VALUES ('signup', 'factory', 0.7), ('purchase', 'repository', 0.6), ('error', 'middleware', 0.8), ('view', 'builder', 0.8), ('click', 'observer', 0.6))
SELECT id, pattern, round(least(1, base + CASE WHEN id IN (SELECT dst FROM edges) THEN 0.2 ELSE 0 END), 4)::DOUBLE AS confidence FROM nodes JOIN p USING (name)""",
)
def design_patterns(spark, d):
    g = _named_sessions(spark, d, {"signup": "NewSession", "purchase": "PurchaseRepository", "error": "ErrorMiddleware", "view": "ViewBuilder", "click": "OnClick"})
    return code.design_patterns(g.nodes, g.edges)


@query(
    "data_flow_roles",
    f"""WITH RECURSIVE {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT min(id) AS id, 0 AS depth FROM nodes UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.id WHERE w.depth < 5)
SELECT id, min(depth) AS depth, CASE name WHEN 'view' THEN 'source' WHEN 'purchase' THEN 'sink' WHEN 'click' THEN 'transform' ELSE 'other' END AS role FROM w JOIN nodes USING (id) GROUP BY id, name""",
)
def data_flow_roles(spark, d):
    """Views read, purchases save, clicks format."""
    g = _named_sessions(spark, d, {"view": "read_view", "purchase": "save_purchase", "click": "format_click"})
    return explore.data_flow(g, g.nodes.agg(F.min("id")).first()[0])


@query(
    "error_flow_of_sessions",
    f"""WITH RECURSIVE {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE dst NOT IN (SELECT id FROM nodes WHERE name = 'signup')),
w AS (SELECT id AS origin, id, 0 AS depth FROM nodes WHERE name = 'error' UNION SELECT w.origin, e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.id WHERE w.depth < 5),
f AS (SELECT origin, id, min(depth) AS depth FROM w GROUP BY origin, id)
SELECT origin, id, depth, CASE name WHEN 'error' THEN 'origin' WHEN 'signup' THEN 'handler' ELSE 'passes' END AS role, id NOT IN (SELECT dst FROM edges) AND name <> 'signup' AS escapes FROM f JOIN nodes USING (id)""",
)
def error_flow_of_sessions(spark, d):
    return explore.error_flow(_named_sessions(spark, d, {"error": "raise_error", "signup": "recover"}))


@query("api_of_communities")
def api_of_communities(spark, d):
    g = session_graph(spark, d)
    return impact.module_api(g, an.communities(g))


@query(
    "api_coverage_of_sessions",
    f"""WITH RECURSIVE {SESSION_SQL}, c AS (SELECT id, package || CASE WHEN name IN ('click', 'purchase', 'view') THEN ' a' ELSE ' b' END AS community FROM nodes),
k AS (SELECT DISTINCT e.src, e.dst, a.community AS ca, b.community AS cb FROM edges e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst WHERE e.etype = 'calls'),
api AS (SELECT cb AS community, dst AS id, count(DISTINCT src) AS external_callers FROM k WHERE ca <> cb GROUP BY ALL),
r AS (SELECT id AS root, id FROM api UNION SELECT r.root, k.dst FROM r JOIN k ON k.src = r.id AND k.ca = k.cb)
SELECT community, api.id, external_callers, dominated, dominated / size AS coverage FROM api
JOIN (SELECT root, count(*) AS dominated FROM r GROUP BY root) d ON d.root = api.id JOIN (SELECT community, count(*) AS size FROM c GROUP BY community) s USING (community)""",
)
def api_coverage_of_sessions(spark, d):
    g = session_graph(spark, d)
    half = F.when(F.col("name").isin("click", "purchase", "view"), " a").otherwise(" b")
    return impact.api_coverage(g, g.nodes.select("id", F.concat("package", half).alias("community")))
