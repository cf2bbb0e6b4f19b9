"""Flows, summaries, resolution, fingerprints and fixpoints over symbols and calls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.search import fuzzy_search, query_terms
from graphloom.operators.analytics import entry_point
from graphloom.operators.similarity import dot, minhash, token_shingles
from graphloom.operators.structural import UNLIMITED
from graphloom.operators.traversal import bfs
from graphloom.plans.tables import write_table
from graphloom.sources.graphs import CodeGraph

FLOW_PATTERNS = [
    ("source", r"(?i)^(read|get|fetch|load|input|recv|receive|query|parse)"),
    ("sink", r"(?i)^(write|save|send|exec|insert|update|delete|print|log|render|put)"),
    ("transform", r"(?i)^(convert|format|map|to|encode|decode|transform|build|make)"),
]
ERROR_PATTERNS = [("origin", r"(?i)(^new.*error$|errorf$|raise|throw|panic)"), ("handler", r"(?i)(recover|handle.*error|on_?error|catch|except)")]


def labelled(nodes: DataFrame, patterns: list[tuple[str, str]], default: str) -> DataFrame:
    """``id, role``: the first pattern that a name fits, else ``default``."""
    role = F.lit(default)
    for name, pattern in reversed(patterns):
        role = F.when(F.col("name").rlike(pattern), name).otherwise(role)
    return nodes.select("id", role.alias("role"))


def data_flow(g: CodeGraph, start: str, max_depth: int = 5, reverse: bool = False, cap: int | None = None) -> DataFrame:
    """``id, depth, role``: what data reaches along calls from ``start`` (or, in reverse, where it comes from), as sources, transforms, sinks or others; with ``cap``, the first by depth and id."""
    starts = g.edges.sparkSession.createDataFrame([(start, start)], "root string, id string")
    reach = bfs(g.of_type("calls"), starts, max_depth, reverse)
    out = reach.join(labelled(g.nodes, FLOW_PATTERNS, "other"), "id").select("id", "depth", "role")
    return out if cap is None else out.orderBy("depth", "id").limit(cap)


def error_flow(g: CodeGraph, max_depth: int = 5) -> DataFrame:
    """``origin, id, depth, role, escapes``: callers of error origins up to the first handlers; an origin escapes if a caller without callers is reached that handles nothing."""
    roles = write_table(labelled(g.nodes, ERROR_PATTERNS, "passes"), "roles")
    calls = g.of_type("calls").join(roles.where("role = 'handler'").select(F.col("id").alias("dst")), "dst", "left_anti")
    origins = roles.where("role = 'origin'").select(F.col("id").alias("root"), "id")
    reach = bfs(calls, origins, max_depth, reverse=True).join(roles, "id")
    called = g.of_type("calls").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    out = reach.join(called, "id", "left")
    return out.select(F.col("root").alias("origin"), "id", "depth", "role", (F.col("called").isNull() & (F.col("role") != "handler")).alias("escapes"))


def file_summary(g: CodeGraph) -> DataFrame:
    """``file_path, symbols, exported, kinds, incoming, outgoing``: one row for each file, with its edges to and from others."""
    n = g.nodes.groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    p = g.nodes.select("id", F.col("file_path").alias("f"))
    e = g.edges.select("src", "dst").join(p.withColumnsRenamed({"id": "src", "f": "a"}), "src").join(p.withColumnsRenamed({"id": "dst", "f": "b"}), "dst").where("a <> b")
    i, o = e.groupBy(F.col("b").alias("file_path")).agg(F.count("*").alias("incoming")), e.groupBy(F.col("a").alias("file_path")).agg(F.count("*").alias("outgoing"))
    return n.join(i, "file_path", "left").join(o, "file_path", "left").na.fill(0, ["incoming", "outgoing"])


def public_api(g: CodeGraph, package: str) -> DataFrame:
    """``id, kind, users``: exported symbols of a package with the number of other packages that use them."""
    p = g.nodes.select("id", "package")
    e = g.edges.select("src", "dst").join(p.withColumnsRenamed({"id": "src", "package": "user"}), "src").where(F.col("user") != package)
    used = e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("user").alias("users"))
    return g.nodes.where((F.col("package") == package) & F.col("exported")).join(used, "id", "left").na.fill(0, ["users"]).select("id", "kind", "users")


def dead_code_findings(g: CodeGraph, reflected: DataFrame | None = None) -> DataFrame:
    """``id, confidence``: symbols that nothing refers to. Entry points, implementers of interfaces and names that occur in strings (``reflected``: ``name``) are left out; exported symbols and methods are less sure."""
    used = g.edges.where("src <> dst").select(F.col("dst").alias("id")).distinct()
    impl = g.of_type("implements").select(F.col("src").alias("id")).distinct()
    free = g.nodes.where("kind NOT IN ('external', 'file')").where(~entry_point(F.col("name"), F.col("kind"), F.col("file_path"))).join(used, "id", "left_anti").join(impl, "id", "left_anti")
    if reflected is not None:
        free = free.join(reflected.select("name").distinct(), "name", "left_anti")
    return free.select("id", F.round(F.lit(0.95) - F.when(F.col("exported"), 0.35).otherwise(0.0) - F.when(F.col("kind") == "method", 0.2).otherwise(0.0), 4).alias("confidence"))


def simulate_change(g: CodeGraph, changes: DataFrame) -> DataFrame:
    """``id, caller, file_path, line, edit``: call sites to edit for ``changes`` (``id, change``)."""
    c = g.of_type("calls").join(changes.select(F.col("id").alias("dst"), "change"), "dst")
    edit = F.when(F.col("change") == "removed", "replace the call").when(F.col("change").startswith("required parameter"), "pass the new argument").when(F.col("change") == "result changed", "use the new result").otherwise("check the call")
    return c.select(F.col("dst").alias("id"), F.col("src").alias("caller"), "file_path", "line", edit.alias("edit"))


def resolve_query(g: CodeGraph, text: str) -> DataFrame:
    """``term, what, target``: each term of a query as a package, else a symbol's name, else a file, else the best match of a search."""
    spark = g.nodes.sparkSession
    terms = write_table(spark.createDataFrame([(text,)], "t string").select(F.explode(query_terms(F.col("t"))).alias("term")), "terms")
    find = lambda what, key, value: g.nodes.select(F.lower(key).alias("term"), F.lit(what).alias("what"), F.col(value).alias("target")).distinct()
    tail = F.regexp_extract("file_path", r"[^/]*$", 0)
    hits = find("package", F.col("package"), "package").withColumn("o", F.lit(0)).unionByName(find("symbol", F.col("name"), "id").withColumn("o", F.lit(1)))
    hits = hits.unionByName(find("file", F.col("file_path"), "file_path").withColumn("o", F.lit(2))).unionByName(find("file", tail, "file_path").withColumn("o", F.lit(3)))
    found = terms.join(hits, "term")
    best = found.groupBy("term").agg(F.min("o").alias("o"))
    exact = write_table(found.join(best, ["term", "o"]).select("term", "what", "target"), "resolved")
    left = [r["term"] for r in terms.join(exact, "term", "left_anti").where(F.col("term").rlike(r"^[a-z0-9_]{3,}$")).collect()]
    for term in left:  # a query has a handful of terms
        exact = exact.unionByName(fuzzy_search(g.nodes, term, 1).select(F.lit(term).alias("term"), F.lit("similar").alias("what"), F.col("id").alias("target")))
    return exact


def fingerprints(symbols: DataFrame) -> DataFrame:
    """``id, fp``: structural fingerprints of symbols (``id, signature, code``) for :func:`graphloom.operators.similarity.fingerprint_similarity`."""
    from graphloom.operators.code import n_parameters

    flow = F.array_distinct(F.regexp_extract_all(F.col("code"), F.lit(r"\b(if|for|while|switch|try|return|go|defer|raise|throw|await|yield)\b"), 1))
    complexity = 1 + F.regexp_count("code", F.lit(r"\b(if|for|while|case|catch|except|and|or)\b|&&|\|\|"))
    tail = F.regexp_extract("signature", r"\)\s*(?:->|:)?\s*([^){]*)$", 1)
    returns = F.when(F.trim(tail) == "", 0).otherwise(F.size(F.split(tail, ",")))
    return symbols.select("id", F.struct(minhash(token_shingles(F.col("code"), 3)).alias("signature"), n_parameters(F.col("signature")).alias("params"), returns.alias("returns"), complexity.alias("complexity"), flow.alias("flow")).alias("fp"))


def hybrid_similarity(structural: Column, a: Column, b: Column, weight: float = 0.6) -> Column:
    """Structural similarity and the cosine of unit vectors, weighted."""
    return weight * structural + (1 - weight) * dot(a, b)


def dependency_index(edges: DataFrame) -> DataFrame:
    """``id, depends_on, depended_by``: distinct neighbours each way."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    o, i = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("depends_on")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("depended_by"))
    return o.join(i, "id", "full").na.fill(0)


def disproof(edges: DataFrame, refuted: DataFrame, max_depth: int = 3) -> DataFrame:
    """``id, depth``: what depends on ``refuted`` (``id``), within ``max_depth`` steps."""
    return bfs(edges, refuted.select(F.lit("x").alias("root"), "id"), max_depth, reverse=True).select("id", "depth")


def package_blast(dependencies: DataFrame, package: str) -> DataFrame:
    """``package, depth``: packages that need ``package`` (``src_package, dst_package``), directly or not."""
    e = write_table(dependencies.select(F.col("src_package").alias("src"), F.col("dst_package").alias("dst")), "dependencies")
    starts = e.sparkSession.createDataFrame([(package, package)], "root string, id string")
    return bfs(e, starts, UNLIMITED, reverse=True).select(F.col("id").alias("package"), "depth").where("depth > 0")


def arc_consistent(domains: DataFrame, constraints: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``variable, value`` after removing values without support: ``constraints`` (``x, a, y, b``) list the pairs allowed for two variables. Rounds of semi-joins to a fixpoint."""
    both = constraints.unionByName(constraints.select(F.col("y").alias("x"), F.col("b").alias("a"), F.col("x").alias("y"), F.col("a").alias("b")))
    both = write_table(both.distinct(), "constraints")
    need = both.select("x", "y").distinct()
    now = write_table(domains.select("variable", "value").distinct(), "domains")
    n = now.count()
    for _ in range(max_rounds):
        live = both.join(now.select(F.col("variable").alias("y"), F.col("value").alias("b")), ["y", "b"], "left_semi").select("x", "a", "y").distinct()
        lack = now.join(need, now["variable"] == need["x"]).select("variable", "value", "y").join(live.select(F.col("x").alias("variable"), F.col("a").alias("value"), "y"), ["variable", "value", "y"], "left_anti")
        now = write_table(now.join(lack.select("variable", "value").distinct(), ["variable", "value"], "left_anti"), "domains")
        m = now.count()
        if m == n:
            return now
        n = m
    raise RuntimeError("domains did not settle")


def unit_propagation(clauses: DataFrame, max_rounds: int = 1000) -> tuple[DataFrame, bool]:
    """Literals (``literal``) that unit clauses force in ``clauses`` (``clause, literal``; a negative literal is a negation), and whether they contradict."""
    left = write_table(clauses.distinct(), "clauses")
    forced = write_table(left.select("literal").where("false"), "literals")
    for _ in range(max_rounds):
        unit = left.groupBy("clause").agg(F.count("*").alias("n"), F.first("literal").alias("literal")).where("n = 1").select("literal").distinct()
        new = write_table(unit.join(forced, "literal", "left_anti"), "literals")
        if new.isEmpty():
            return forced, False
        forced = write_table(forced.unionByName(new), "literals")
        if not forced.join(forced.select((-F.col("literal")).alias("literal")), "literal", "left_semi").isEmpty():
            return forced, True
        met = left.join(new, "literal", "left_semi").select("clause").distinct()
        before = left.select("clause").distinct().count() - met.count()
        left = write_table(left.join(met, "clause", "left_anti").join(new.select((-F.col("literal")).alias("literal")), "literal", "left_anti").select("clause", "literal"), "clauses")
        if left.select("clause").distinct().count() < before:
            return forced, True
    raise RuntimeError("propagation did not settle")


def sample_size(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows a group for a two-sided comparison of means to find ``effect`` deviations, by the normal approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    return math.ceil(2 * ((z(1 - alpha / 2) + z(power)) / effect) ** 2)


def achieved_power(effect: float, n: int, alpha: float = 0.05) -> float:
    from statistics import NormalDist

    d = NormalDist()
    return d.cdf(abs(effect) * math.sqrt(n / 2) - d.inv_cdf(1 - alpha / 2))
