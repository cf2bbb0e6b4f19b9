"""Graphs over the supplied tables: ``nodes`` and ``edges`` with one schema each.

nodes: id, name, kind, package, file_path, start_line, end_line, exported, language
edges: src, dst, etype, file_path, line (parallel edges are legal)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ["id", "name", "kind", "package", "file_path", "start_line", "end_line", "exported", "language"]
EDGE_COLUMNS = ["src", "dst", "etype", "file_path", "line"]


@dataclass(frozen=True)
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame

    def of_type(self, *etypes: str) -> DataFrame:
        return self.edges.where(F.col("etype").isin(*etypes)) if etypes else self.edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def package_of(package: Column, file_path: Column) -> Column:
    """The package of a node: its own, else the directory of its file, else empty."""
    return F.when(F.coalesce(package, F.lit("")) != "", package).otherwise(
        F.when(file_path.contains("/"), F.regexp_extract(file_path, r"^(.*)/[^/]*$", 1)).otherwise("")
    )


def _node(id: Column, name: Column, kind: str, package: Column, exported: Column) -> list[Column]:
    return [
        id.alias("id"), name.alias("name"), F.lit(kind).alias("kind"), package.alias("package"),
        F.concat(package, F.lit(f"/{kind}.go")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        exported.alias("exported"), F.lit("go").alias("language"),
    ]


def _edge(src: Column, dst: Column, etype: str, line: Column) -> list[Column]:
    return [src.alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"), F.lit("").alias("file_path"), line.cast("int").alias("line")]


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def supply_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Customers call orders; orders implement parts and reference suppliers, once a line item."""
    t = lambda n: table(spark, sf_dir, n)
    nodes = (
        t("customer").select(*_node(_id("c", "c_custkey"), F.col("c_name"), "function", _id("nation", "c_nationkey"), F.col("c_acctbal") > 0))
        .unionByName(t("orders").select(*_node(_id("o", "o_orderkey"), F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")), "struct", F.concat(F.lit("status"), F.col("o_orderstatus")), F.col("o_totalprice") > 100000)))
        .unionByName(t("part").select(*_node(_id("p", "p_partkey"), F.col("p_name"), "interface", F.col("p_brand"), F.col("p_size") > 10)))
        .unionByName(t("supplier").select(*_node(_id("s", "s_suppkey"), F.col("s_name"), "class", _id("nation", "s_nationkey"), F.col("s_acctbal") > 0)))
    )
    li = t("lineitem")
    edges = (
        t("orders").select(*_edge(_id("c", "o_custkey"), _id("o", "o_orderkey"), "calls", F.lit(1)))
        .unionByName(li.select(*_edge(_id("o", "l_orderkey"), _id("p", "l_partkey"), "implements", F.col("l_linenumber"))))
        .unionByName(li.select(*_edge(_id("o", "l_orderkey"), _id("s", "l_suppkey"), "references", F.col("l_linenumber"))))
    )
    return CodeGraph(nodes, edges)


SUPPLY_SQL = """
nodes AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, 'function' AS kind, 'nation' || c_nationkey AS package, 'nation' || c_nationkey || '/function.go' AS file_path, c_acctbal > 0 AS exported FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'Order' || o_orderkey, 'struct', 'status' || o_orderstatus, 'status' || o_orderstatus || '/struct.go', o_totalprice > 100000 FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_name, 'interface', p_brand, p_brand || '/interface.go', p_size > 10 FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, 'class', 'nation' || s_nationkey, 'nation' || s_nationkey || '/class.go', s_acctbal > 0 FROM supplier
), edges AS (
  SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'calls' AS etype, 1 AS line FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'implements', l_linenumber FROM lineitem
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'references', l_linenumber FROM lineitem
)"""


def geography_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, parent, value``: world, regions, nations, then customers and suppliers; values are keys (balances, rounded, for leaves)."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(100).cast("long").alias("value"))
        .unionByName(t("region").select(_id("r", "r_regionkey").alias("id"), F.lit("world").alias("parent"), (F.col("r_regionkey") + 10).cast("long").alias("value")))
        .unionByName(t("nation").select(_id("n", "n_nationkey").alias("id"), _id("r", "n_regionkey").alias("parent"), (F.col("n_nationkey") + 1).cast("long").alias("value")))
        .unionByName(t("customer").select(_id("c", "c_custkey").alias("id"), _id("n", "c_nationkey").alias("parent"), F.floor("c_acctbal").cast("long").alias("value")))
        .unionByName(t("supplier").select(_id("s", "s_suppkey").alias("id"), _id("n", "s_nationkey").alias("parent"), F.floor("s_acctbal").cast("long").alias("value")))
    )


TREE_SQL = """
tree AS (
  SELECT 'world' AS id, CAST(NULL AS VARCHAR) AS parent, CAST(100 AS BIGINT) AS value
  UNION ALL SELECT 'r' || r_regionkey, 'world', r_regionkey + 10 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(floor(c_acctbal) AS BIGINT) FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(floor(s_acctbal) AS BIGINT) FROM supplier
), up AS (
  SELECT id, id AS ancestor, 0 AS dist FROM tree
  UNION ALL SELECT u.id, t.parent, u.dist + 1 FROM up u JOIN tree t ON t.id = u.ancestor WHERE t.parent IS NOT NULL
), depths AS (SELECT id, max(dist) AS depth FROM up GROUP BY id)"""


def flow_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst`` of a graph with one entry, ``world``: regions, nations, suppliers, and the parts that each supplies."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("region").select(F.lit("world").alias("src"), _id("r", "r_regionkey").alias("dst"))
        .unionByName(t("nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst")))
        .unionByName(t("supplier").select(_id("n", "s_nationkey").alias("src"), _id("s", "s_suppkey").alias("dst")))
        .unionByName(t("lineitem").select("l_suppkey", "l_partkey").distinct().select(_id("s", "l_suppkey").alias("src"), _id("p", "l_partkey").alias("dst")))
    )


FLOW_SQL = """
flow AS (
  SELECT 'world' AS src, 'r' || r_regionkey AS dst FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem
)"""


def session_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """One node for each user and event type; one edge for each pair of consecutive events of a user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("id"))
    nodes = e.select("user_id", "event_type", "id").distinct().select(
        "id", F.col("event_type").alias("name"), F.lit("function").alias("kind"), F.col("user_id").cast("string").alias("package"),
        F.concat(F.col("user_id").cast("string"), F.lit("/events.py")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        (F.col("event_type") != "error").alias("exported"), F.lit("python").alias("language"),
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = e.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst IS NOT NULL").select(*_edge(F.col("src"), F.col("dst"), "calls", F.lit(1)))
    return CodeGraph(nodes, edges)


SESSION_SQL = """
ev AS (SELECT user_id, event_type, ts, event_id, user_id || '/' || event_type AS id FROM events),
nodes AS (SELECT DISTINCT id, event_type AS name, 'function' AS kind, CAST(user_id AS VARCHAR) AS package, user_id || '/events.py' AS file_path, event_type <> 'error' AS exported FROM ev),
edges AS (
  SELECT src, dst, 'calls' AS etype FROM (SELECT id AS src, lead(id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev) WHERE dst IS NOT NULL
)"""


def web_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Pages and their links; a link to no page of the table is an external placeholder."""
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    own = p.select("page_id", rest.alias("at"), F.regexp_extract(rest, r"^[^/]*", 0).alias("host"), F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1).alias("hrefs"))
    links = own.select(F.col("at").alias("src"), F.posexplode("hrefs").alias("line", "href"), "host").select("src", F.concat("host", "href").alias("target"), "line")
    pages = own.groupBy(F.col("at").alias("id")).agg(F.first("host").alias("host"))
    known = links.join(pages.select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left")
    dst = F.when(F.col("known"), F.col("target")).otherwise(F.concat(F.lit("external:"), F.col("target")))
    edges = known.select(*_edge(F.col("src"), dst, "imports", F.col("line")))
    outside = edges.where(F.col("dst").startswith("external:")).select(F.col("dst").alias("id")).distinct()
    make = lambda d, kind, host: d.select(
        "id", F.regexp_extract("id", r"[^/]*/?$", 0).alias("name"), F.lit(kind).alias("kind"), host.alias("package"), F.col("id").alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("exported"), F.lit("html").alias("language"),
    )
    return CodeGraph(make(pages, "file", F.col("host")).unionByName(make(outside, "external", F.lit(""))), edges)


WEB_SQL = r"""
own AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS loc, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hrefs FROM pages
), links AS (
  SELECT loc AS src, regexp_extract(loc, '^[^/]*') || unnest(hrefs) AS target FROM own
), page_nodes AS (SELECT DISTINCT loc AS id FROM own),
edges AS (
  SELECT src, CASE WHEN p.id IS NOT NULL THEN target ELSE 'external:' || target END AS dst, 'imports' AS etype FROM links LEFT JOIN page_nodes p ON p.id = target
), nodes AS (
  SELECT id, 'file' AS kind, regexp_extract(id, '^[^/]*') AS package FROM page_nodes UNION ALL SELECT DISTINCT dst, 'external', '' FROM edges WHERE starts_with(dst, 'external:')
)"""
