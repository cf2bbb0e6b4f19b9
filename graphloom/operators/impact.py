"""What a change reaches: blast radius, impact, coverage, taint, zones, plans and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.search import is_test_file
from graphloom.operators.analytics import strongly_connected
from graphloom.operators.structural import UNLIMITED
from graphloom.operators.traversal import bfs
from graphloom.plans.tables import GrowingTable, write_table
from graphloom.sources.graphs import CodeGraph

#: Direct callers from which on a change is of critical, high or medium risk.
RISK_CALLERS = (20, 10, 4)


def risk_of(callers: Column) -> Column:
    return F.when(callers >= RISK_CALLERS[0], "critical").when(callers >= RISK_CALLERS[1], "high").when(callers >= RISK_CALLERS[2], "medium").otherwise("low")


def blast_radius(g: CodeGraph, targets: DataFrame, max_hops: int = 3) -> DataFrame:
    """``id, direct, indirect, implementers, files, tests, risk`` for each of ``targets`` (``id``): distinct callers at one hop and beyond, implementers, and the files of all of them."""
    reach = write_table(bfs(g.of_type("calls"), targets.select(F.col("id").alias("root"), "id"), max_hops, reverse=True), "blast")
    callers = reach.where("depth > 0")
    impl = g.of_type("implements", "embeds").join(targets.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("root"), F.col("src").alias("id")).distinct()
    hit = callers.select("root", "id").unionByName(impl).distinct().join(g.nodes.select("id", "file_path"), "id")
    files = hit.groupBy("root").agg(F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(is_test_file(F.col("file_path")), F.col("file_path"))).alias("tests"))
    near = callers.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))
    n_impl = impl.groupBy("root").agg(F.count("*").alias("implementers"))
    out = targets.select(F.col("id").alias("root"))
    for part in (near, n_impl, files):
        out = out.join(part, "root", "left")
    return out.na.fill(0).select(F.col("root").alias("id"), "direct", "indirect", "implementers", "files", "tests", risk_of(F.col("direct")).alias("risk"))


def enrich(base: DataFrame, enrichers: list[DataFrame]) -> DataFrame:
    """``base`` (``id``, ...) with the columns of each enricher (``id``, ...), in order; symbols that one doesn't know keep nulls."""
    for e in enrichers:
        base = base.join(e, "id", "left")
    return base


def change_class(old: Column, new: Column) -> Column:
    """How a signature changed."""
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old == new, "body").otherwise("signature")


def churn(commits: DataFrame) -> DataFrame:
    """``file_path, commits, authors, lines`` of ``file_path, author, added, deleted``."""
    return commits.groupBy("file_path").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.sum(F.col("added") + F.col("deleted")).alias("lines"))


def owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``file_path, owner``: that of the last rule (``at, pattern, owner``) whose glob fits the path. Rules are few and go to every task."""
    from graphloom.sources.files import glob_regex_column

    hit = files.join(F.broadcast(rules), F.rlike(F.col("file_path"), glob_regex_column(F.col("pattern"))), "left")
    return hit.groupBy("file_path").agg(F.max_by("owner", "at").alias("owner"))


def predictive_risk(bugs: Column, changes: Column, callers: Column, complexity: Column) -> Column:
    """0 to 95: up to 30 for past bugs (10 each), 25 for changes (2.5 each), 20 for callers (1 each), 20 for complexity (1 a point)."""
    return F.least(bugs * 10, F.lit(30)) + F.least(changes * 2.5, F.lit(25)) + F.least(callers, F.lit(20)) + F.least(complexity, F.lit(20))


def change_impact(breaking: Column, callers: Column, coverage: Column, effects: Column, exported: Column) -> Column:
    """.30 if breaking, .25 by callers to 20, .20 by lack of tests (direct 0, indirect .5, none 1), .15 by side effects (.5 and .25 for each beyond one), .10 if exported."""
    tests = F.when(coverage == "direct", 0.0).when(coverage == "indirect", 0.5).otherwise(1.0)
    side = F.when(effects > 0, F.least(F.lit(1.0), 0.5 + 0.25 * (effects - 1))).otherwise(0.0)
    return 0.30 * breaking.cast("int") + 0.25 * F.least(callers / 20, F.lit(1.0)) + 0.20 * tests + 0.15 * side + 0.10 * exported.cast("int")


def impact_level(score: Column) -> Column:
    return F.when(score >= 0.7, "critical").when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")


def coverage(g: CodeGraph, tests: DataFrame, max_depth: int = 10) -> DataFrame:
    """``id, depth, coverage`` of every node: direct at one call from a test (``id``), indirect beyond, else none."""
    reach = bfs(g.of_type("calls"), tests.select(F.lit("tests").alias("root"), "id"), max_depth).select("id", "depth")
    kind = F.when(F.col("depth") == 1, "direct").when(F.col("depth") > 1, "indirect").when(F.col("depth") == 0, "test").otherwise("none")
    return g.nodes.select("id").join(reach, "id", "left").select("id", "depth", kind.alias("coverage"))


def side_effects(g: CodeGraph, patterns: DataFrame) -> DataFrame:
    """``id, effects, pure``: the kinds of effect (``pattern, effect`` on names) of what a node calls, directly or not; pure without any."""
    own = g.nodes.select("id", "name").join(F.broadcast(patterns), F.expr("name rlike pattern")).select(F.col("effect").alias("root"), "id").distinct()
    reach = bfs(g.of_type("calls").select("src", "dst").distinct(), own, UNLIMITED, reverse=True)
    got = reach.groupBy("id").agg(F.countDistinct("root").alias("effects"))
    return g.nodes.select("id").join(got, "id", "left").na.fill(0, ["effects"]).select("id", "effects", (F.col("effects") == 0).alias("pure"))


def taint(g: CodeGraph, sources: DataFrame, sanitizers: DataFrame, sinks: DataFrame, max_depth: int = 20) -> DataFrame:
    """``source, sink, cwe, depth, state, vulnerable, truncated``: tainted data along calls, traced from each of ``sources`` (``id``) on its own.

    Data starts untrusted; a partial sanitizer (``id, complete``, perhaps ``cwe``) makes it mixed, a complete one clean. A node has the
    worst state that reaches it at its first level. A sink (``id, cwe``) is vulnerable if what reaches it from before is untrusted or mixed and the
    trace of its source met no complete sanitizer at an earlier level: one for all kinds of sinks, or, if ``sanitizers`` has a ``cwe``, one for the sink's.
    ``truncated``: the trace of the source would go on beyond ``max_depth`` calls, so sinks may be missing; with UNLIMITED none is.
    """
    calls = g.of_type("calls").select("src", "dst").distinct()
    kinds = sanitizers if "cwe" in sanitizers.columns else sanitizers.withColumn("cwe", F.lit(None).cast("string"))
    cleaned = kinds.groupBy(F.col("id").alias("dst")).agg(F.max(F.when(F.col("complete"), 2).otherwise(1)).alias("level"))
    first = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("state"), F.lit(0).alias("came"), F.lit(0).alias("depth")).distinct()
    table = GrowingTable(first, "taint")
    frontier = table.read()
    for d in range(1, max_depth + 1):
        step = (
            frontier.join(calls.withColumnRenamed("src", "id"), "id").join(cleaned, "dst", "left")
            .groupBy("source", F.col("dst").alias("id")).agg(F.min(F.coalesce("level", "state")).alias("state"), F.min("state").alias("came"))
            .join(table.read().select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(d))
        )
        frontier = table.add(step)
        if frontier.isEmpty():
            break
    seen = table.read()
    on = frontier.where(F.lit(max_depth) == F.col("depth")).join(calls.withColumnRenamed("src", "id"), "id").select("source", F.col("dst").alias("id"))
    on = on.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", F.lit(True).alias("truncated")).distinct()
    name = F.when(F.col("state") == 0, "untrusted").when(F.col("state") == 1, "mixed").otherwise("clean")
    met = seen.join(kinds.where("complete").select("id", F.col("cwe").alias("safe_for")), "id").groupBy("source", "safe_for").agg(F.min("depth").alias("met"))
    own = seen.where("depth > 0").join(sinks.select("id", "cwe"), "id")
    cleared = own.join(met, "source").where("met < depth AND (safe_for IS NULL OR safe_for = cwe)").select("source", "id", "cwe").distinct().withColumn("cleared", F.lit(True))
    return own.join(cleared, ["source", "id", "cwe"], "left").join(on, "source", "left").select(
        "source", F.col("id").alias("sink"), "cwe", "depth", name.alias("state"), ((F.col("came") < 2) & F.col("cleared").isNull()).alias("vulnerable"), F.coalesce("truncated", F.lit(False)).alias("truncated")
    )


def zone_crossings(g: CodeGraph, zones: DataFrame, allowed: DataFrame) -> DataFrame:
    """``src, dst, src_zone, dst_zone, violation`` of edges between zones (``id, zone``); a violation if the pair isn't ``allowed`` (``src_zone, dst_zone``)."""
    z = zones.select("id", "zone")
    e = g.edges.select("src", "dst").join(z.withColumnsRenamed({"id": "src", "zone": "src_zone"}), "src").join(z.withColumnsRenamed({"id": "dst", "zone": "dst_zone"}), "dst").where("src_zone <> dst_zone")
    ok = allowed.select("src_zone", "dst_zone", F.lit(True).alias("ok"))
    return e.join(F.broadcast(ok), ["src_zone", "dst_zone"], "left").select("src", "dst", "src_zone", "dst_zone", F.col("ok").isNull().alias("violation"))


def circular_dependencies(g: CodeGraph, level: str) -> DataFrame:
    """``component, length, severity`` of cycles among packages, types (implements, embeds, references) or functions (calls); long cycles are worse."""
    if level == "package":
        p = g.nodes.select("id", "package")
        e = g.edges.join(p.withColumnsRenamed({"id": "src", "package": "a"}), "src").join(p.withColumnsRenamed({"id": "dst", "package": "b"}), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        e = write_table(e, "dependencies")
    elif level == "type":
        e = g.of_type("implements", "embeds", "references").select("src", "dst")
    else:
        e = g.of_type("calls").select("src", "dst")
    n = F.col("length")
    severity = F.when(n > 5, "error").when(n > 2, "warning").otherwise("info")
    return strongly_connected(e).groupBy("component").agg(F.count("*").alias("length")).where("length > 1").select("component", "length", severity.alias("severity"))


def topological_levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, level`` of what can be ordered, prerequisites first (an edge leads from what needs to what is needed), and the edges left in cycles."""
    live = write_table(edges.where("src <> dst").select("src", "dst").distinct(), "levels")
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    left = write_table(ids, "levels")
    done, level = None, 0
    while not left.isEmpty():
        free = left.join(live.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        free = write_table(free.withColumn("level", F.lit(level)), "levels")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = write_table(left.join(free.select("id"), "id", "left_anti"), "levels")
        live = write_table(live.join(free.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "levels")
        level += 1
    empty = ids.where("false").withColumn("level", F.lit(0))
    return done if done is not None else empty, live


def apply_rules(facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``id, action, rules``: the strictest action of the rules (``name, SQL condition, action``) that hold, and their names; actions are block, review, warn and notify."""
    order = ["block", "review", "warn", "notify"]
    hits = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(order.index(a)).alias("o"), F.lit(n).alias("n"))) for n, c, a in rules)))
    out = facts.withColumn("hits", hits).where(F.size("hits") > 0)
    names = F.array_sort(F.transform("hits", lambda h: h["n"]))
    return out.select("id", F.element_at(F.array(*map(F.lit, order)), F.array_min(F.transform("hits", lambda h: h["o"])) + 1).alias("action"), names.alias("rules"))


def module_api(g: CodeGraph, communities: DataFrame) -> DataFrame:
    """``community, id, external_callers``: nodes of a community that others call: its interface."""
    c = communities.select("id", "community")
    e = g.of_type("calls").join(c.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "community": "b"}), "dst").where("a <> b")
    return e.groupBy(F.col("b").alias("community"), F.col("dst").alias("id")).agg(F.countDistinct("src").alias("external_callers"))


def api_coverage(g: CodeGraph, communities: DataFrame) -> DataFrame:
    """``community, id, external_callers, dominated, coverage``: :func:`module_api` and how much of its community each node is the way into.

    In the community's own calls every node that an interface node reaches is dominated by it, itself included, so ``dominated`` counts what
    it reaches without leaving the community; coverage is its share of the community. Walks start at interface nodes
    alone, with one join and aggregation a level.
    """
    api = write_table(module_api(g, communities), "module-api")
    c = communities.select("id", "community").distinct()
    inner = g.of_type("calls").select("src", "dst").distinct().join(c.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "community": "b"}), "dst").where("a = b")
    reach = bfs(write_table(inner.select("src", "dst"), "module-calls"), api.select(F.col("id").alias("root"), "id"), UNLIMITED)
    size = c.groupBy("community").agg(F.count("*").alias("size"))
    return api.join(reach.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("dominated")), "id").join(size, "community").select("community", "id", "external_callers", "dominated", (F.col("dominated") / F.col("size")).alias("coverage"))


def federation(repos: DataFrame, imports: DataFrame) -> DataFrame:
    """``repo, target, edges, risk``: edges between repositories, from exported symbols (``repo, path``) and imports (``repo, path``)."""
    owned = repos.select(F.col("repo").alias("target"), "path").distinct()
    e = imports.join(owned, "path").where("repo <> target").groupBy("repo", "target").agg(F.count("*").alias("edges"))
    return e.withColumn("risk", F.when(F.col("edges") > 10, "high").when(F.col("edges") > 5, "medium").otherwise("low"))
