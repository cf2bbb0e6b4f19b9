"""Centrality, dead code, coupling, cycles and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.operators.communities import communities
from graphloom.operators.sequential import fits, in_one_task
from graphloom.plans.tables import GrowingTable, drop_table, write_table
from graphloom.sources.graphs import CodeGraph

__all__ = ["communities"]


def degrees(g: CodeGraph) -> DataFrame:
    """``id, in_degree, out_degree`` of every node; parallel edges count each."""
    ends = g.edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        g.edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return g.nodes.select("id", "kind").join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def hot_spots(g: CodeGraph, top: int) -> DataFrame:
    """``rank, id, in_degree, out_degree, score``: the ``top`` nodes by twice the in-degree plus the out-degree, external ones left out; ties by id. Empty if ``top`` < 1."""
    scored = degrees(g).where("kind <> 'external'").withColumn("score", 2 * F.col("in_degree") + F.col("out_degree"))
    best = scored.orderBy(F.desc("score"), "id").limit(max(top, 0))
    w = Window.orderBy(F.desc("score"), "id")
    return best.select(F.row_number().over(w).alias("rank"), "id", "in_degree", "out_degree", "score")


def entry_point(name: Column, kind: Column, file_path: Column) -> Column:
    """Names that a runtime, a test runner or a package calls by itself."""
    return (
        name.isin("main", "init", "Main", "__main__", "__init__")
        | name.rlike(r"^(Test|Benchmark|Fuzz|Example)([A-Z_].*)?$")
        | name.rlike(r"^test_|^__\w+__$|Handler$")
        | file_path.rlike(r"(_test\.go|(^|/)test_[^/]*\.py|\.(test|spec)\.[jt]sx?)$")
    )


def dead_code(g: CodeGraph, include_exported: bool = True) -> DataFrame:
    """``id, name, file_path, reason``: nodes without incoming edges that are neither external, methods nor entry points."""
    used = g.edges.select(F.col("dst").alias("used"))
    free = g.nodes.join(used, F.col("id") == F.col("used"), "left_anti").where("kind NOT IN ('external', 'method')")
    free = free.where(~entry_point(F.col("name"), F.col("kind"), F.col("file_path")))
    if not include_exported:
        free = free.where("NOT exported")
    return free.select("id", "name", "file_path", F.when(F.col("exported"), "exported but unreferenced").otherwise("unreferenced").alias("reason"))


def package_coupling(g: CodeGraph) -> DataFrame:
    """``package, afferent, efferent, instability, abstractness``.

    Afferent are the other packages with edges into it, efferent those it has edges to;
    instability is efferent by both, abstractness interfaces by interfaces, structs and classes; 0 where nothing divides.
    """
    from graphloom.operators.structural import with_packages

    pairs = with_packages(g).where("src_package <> dst_package").select("src_package", "dst_package").distinct()
    ce = pairs.groupBy(F.col("src_package").alias("package")).agg(F.count("*").alias("efferent"))
    ca = pairs.groupBy(F.col("dst_package").alias("package")).agg(F.count("*").alias("afferent"))
    types = g.nodes.where("kind <> 'external'").groupBy("package").agg(
        F.count_if(F.col("kind") == "interface").alias("i"), F.count_if(F.col("kind").isin("interface", "struct", "class")).alias("t")
    )
    both = F.col("afferent") + F.col("efferent")
    return (
        types.join(ce, "package", "left").join(ca, "package", "left").na.fill(0, ["efferent", "afferent"])
        .select(
            "package", "afferent", "efferent",
            F.when(both > 0, F.col("efferent") / both).otherwise(0.0).alias("instability"),
            F.when(F.col("t") > 0, F.col("i") / F.col("t")).otherwise(0.0).alias("abstractness"),
        )
    )


def entry_nodes(g: CodeGraph) -> DataFrame:
    """``id, first``: nodes without incoming edges; ``first`` marks main and init."""
    used = g.edges.select(F.col("dst").alias("used"))
    return g.nodes.join(used, F.col("id") == F.col("used"), "left_anti").select("id", F.col("name").isin("main", "init").alias("first"))


def exit_nodes(g: CodeGraph) -> DataFrame:
    used = g.edges.select(F.col("src").alias("used"))
    return g.nodes.join(used, F.col("id") == F.col("used"), "left_anti").select("id")


def _power_iteration(damping: float, max_iterations: int, tolerance: float, small_graph: int):
    def walk(src, dst, ids):
        """Rows with a target are edges, those without are nodes."""
        import numpy as np
        import pandas as pd

        node = np.zeros(len(ids), bool)
        node[src[dst < 0]] = True
        s, d = src[dst >= 0], dst[dst >= 0]
        out = np.bincount(s, minlength=len(ids))
        real = node[s] & node[d]
        share = 1.0 / out[s[real]]
        s, d = s[real], d[real]
        n, sink = int(node.sum()), node & (out == 0)
        rank = np.where(node, 1.0 / max(n, 1), 0.0)
        for _ in range(max_iterations if n else 0):
            given = np.bincount(d, weights=rank[s] * share, minlength=len(ids))
            new = np.where(node, (1 - damping) / n + damping * rank[sink].sum() / n + damping * given, 0.0)
            moved, rank = np.abs(new - rank).max(), new
            if moved < tolerance or n < small_graph:
                break
        found = np.flatnonzero(node)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pd.DataFrame({"id": [ids[i] for i in part], "rank": rank[part]})

    return walk


#: Steps of walks that PageRank takes apart, and iterations whose change is looked at in one job.
WALKS, CHECKED = 3, 10


def _walks(edges: DataFrame, base: DataFrame, steps: int) -> tuple[DataFrame, list[float], bool]:
    """``id, out, w0, w1, ...``, the sums of the last over nodes without outgoing edges, and whether walks end within ``steps``.

    ``wj`` of a node is the sum, over the walks of ``j`` edges that end there, of the share of its start that a walk carries. Ranks start alike and get the same from
    outside, so that after any iteration they are the same combination of these columns for all nodes.
    """
    walks, sinks = base.withColumn("w0", F.lit(1.0)), []
    for j in range(steps + 1):
        w = F.col(f"w{j}")
        found = walks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), w)), F.lit(0.0)), F.count_if(F.col("out").isNotNull() & (w > 0))).first()
        sinks.append(float(found[0]))
        if not found[1]:
            return walks, sinks, True
        if j == steps:
            break
        part = walks.where(F.col("out").isNotNull() & (w > 0)).select(F.col("id").alias("src"), (w / F.col("out")).alias("part"))
        more = edges.select("src", "dst").join(part.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("more"))
        walks = write_table(walks.join(more, "id", "left").withColumn(f"w{j + 1}", F.coalesce("more", F.lit(0.0))).drop("more"), "pagerank-walks")
    return walks, sinks, False


def pagerank(g: CodeGraph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, small_graph: int = 10, sequential: bool = False) -> DataFrame:
    """``id, rank`` after power iteration.

    Ranks start at 1/N; a node passes ``damping`` of its rank over its edges,
    parallel edges each their share; nodes without outgoing edges pass it to all nodes alike.
    Ends when no rank moves by ``tolerance`` or more, after ``max_iterations``, or after one
    iteration on graphs of fewer than ``small_graph`` nodes. The first iterations are taken apart by the length of walks
    (:func:`_walks`): where those end, as in graphs without cycles, all further ones follow from numbers and need no edges. Else edges are pre-aggregated
    to weights once, and an iteration is one join and one aggregation. With ``sequential``, a graph that fits one task (checked) is iterated there.
    """
    if not 0 <= damping <= 1:
        raise ValueError("damping must lie between 0 and 1")
    ids = g.nodes.select(F.col("id").alias("src"), F.lit(None).cast(dict(g.nodes.dtypes)["id"]).alias("dst"))
    rows = g.edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").unionByName(ids.where("src IS NOT NULL"))
    if sequential and fits(rows):
        return in_one_task(rows, _power_iteration(damping, max_iterations, tolerance, small_graph), f"id {dict(ids.dtypes)['src']}, rank double")
    out = g.edges.groupBy("src").agg(F.count("*").alias("out"))
    base = write_table(g.nodes.select("id").distinct().join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "out"), "pagerank-nodes")
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    walks, sinks, ended = _walks(g.edges, base, min(WALKS, max_iterations))
    last = 1 if n < small_graph else max_iterations
    last = min(last, max_iterations) if ended else min(last, len(sinks) - 1)
    given = [1.0 / n]
    while len(given) <= last:
        t = len(given) - 1
        sunk = sum(given[t - j] * damping**j * sinks[j] for j in range(min(t + 1, len(sinks))))
        given.append((1 - damping) / n + damping * sunk / n)
    weight = lambda t, j: given[t - j] * damping**j if t >= j else 0.0
    total = lambda factors: sum((F.lit(f) * F.col(f"w{j}") for j, f in enumerate(factors)), F.lit(0.0))
    stop, settled = last, n < small_graph or last == max_iterations
    for at in range(1, last + 1, CHECKED):
        ts = range(at, min(at + CHECKED, last + 1))
        moved = walks.agg(*(F.max(F.abs(total(weight(t, j) - weight(t - 1, j) for j in range(len(sinks))))).alias(f"m{t}") for t in ts)).first()
        found = next((t for t in ts if moved[f"m{t}"] < tolerance), None)
        if found is not None:
            stop, settled = found, True
            break
    ranks = walks.select("id", F.col("out").isNull().alias("sink"), total(weight(stop, j) for j in range(len(sinks))).alias("rank"))
    if settled:
        return ranks.select("id", "rank")
    ranks = write_table(ranks, "pagerank")
    links = g.edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))
    links = write_table(links, "pagerank-links")
    sunk = float(ranks.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0])
    for _ in range(max_iterations - stop):
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        new = ranks.withColumnRenamed("rank", "old").join(given, "id", "left").select(
            "id", "sink", (F.lit((1 - damping) / n + damping * sunk / n) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("rank"), "old"
        )
        seen = Observation()
        change = F.abs(F.col("rank") - F.col("old"))
        new = write_table(new.observe(seen, F.max(change).alias("moved"), F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("sunk")), "pagerank")
        moved, sunk = seen.get["moved"], seen.get["sunk"]
        drop_table(ranks)
        path = new._table_path
        ranks = new.drop("old")
        ranks._table_path = path
        if moved < tolerance or n < small_graph:
            break
    return ranks.select("id", "rank")


def pagerank_top(g: CodeGraph, top: int, **options) -> DataFrame:
    """``position, id, rank, score``: the best by rank, then id, with the hot-spot score."""
    best = pagerank(g, **options).orderBy(F.desc("rank"), "id").limit(max(top, 0))
    d = degrees(g).select("id", (2 * F.col("in_degree") + F.col("out_degree")).alias("score"))
    w = Window.orderBy(F.desc("rank"), "id")
    return best.withColumn("position", F.row_number().over(w)).join(d, "id").select("position", "id", "rank", "score")


def strongly_connected(edges: DataFrame, max_rounds: int = 200, patience: int = 4) -> DataFrame:
    """``id, component`` of every end of an edge: components are named by their least id.

    Nodes that nothing reaches or that reach nothing are trimmed first. Then colours spread forward
    (a node takes the least id that reaches it) and, within its colour, what reaches the colour's
    own node is its component; these leave and the rest repeats.
    """
    kind = dict(edges.dtypes)["src"]
    live = write_table(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    done = write_table(edges.sparkSession.createDataFrame([], f"id {kind}, component {kind}"), "scc-done")
    for _ in range(max_rounds):
        # trim until nothing more falls off
        size = live.count()
        while size:
            kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            kept = write_table(kept.select("src", "dst"), "scc")
            new = kept.count()
            live, size, before = kept, new, size
            if new == before:
                break
        if not size:
            break
        colors = write_table(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("color", F.col("id")), "scc-colors")
        while True:
            got = live.join(colors.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("got"))
            new = write_table(colors.join(got, "id", "left").select("id", F.least("color", F.coalesce("got", "color")).alias("color"), F.col("color").alias("old")), "scc-colors")
            still = new.where("color <> old").isEmpty()
            colors = new.drop("old")
            if still:
                break
        back = live.join(colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst").where("c1 = c2")
        back = write_table(back.select("src", "dst", F.col("c1").alias("color")), "scc-back")
        table = GrowingTable(colors.where("id = color").select("id", "color"), "scc-found")
        frontier = table.read()
        while not frontier.isEmpty():
            step = back.join(frontier.select(F.col("id").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("id"), "color").distinct().join(table.read(), ["id", "color"], "left_anti")
            frontier = table.add(step)
        found = table.read()
        done = write_table(done.unionByName(found.select("id", F.col("color").alias("component"))), "scc-done")
        gone = found.select("id")
        live = write_table(
            live.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc"
        )
    else:
        raise RuntimeError("strongly connected components did not settle")
    # the colour is the least id that reaches the component: name components by their own least id
    least = done.groupBy("component").agg(F.min("id").alias("least"))
    named = done.join(least, "component").select("id", F.col("least").alias("component"))
    return nodes.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cyclic_dependencies(g: CodeGraph) -> DataFrame:
    """``component, length, packages``: strongly connected components of two or more nodes over all edges, with their distinct packages in order."""
    scc = strongly_connected(g.edges)
    return (
        scc.join(g.nodes.select("id", "package"), "id", "left").groupBy("component")
        .agg(F.countDistinct("id").alias("length"), F.array_sort(F.collect_set("package")).alias("packages"))
        .where("length > 1")
    )


def modularity(g: CodeGraph, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``modularity`` of ``communities`` (``id, community``): the sum over communities of the share of edges inside, less ``resolution`` times the squared share of edge ends."""
    c = communities.select("id", "community")
    m = g.edges.agg(F.count("*").alias("m"))
    inside = (
        g.edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        .where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("inner"))
    )
    ends = g.edges.select(F.col("src").alias("id")).unionByName(g.edges.select(F.col("dst").alias("id")))
    deg = ends.groupBy("id").agg(F.count("*").alias("d")).join(c, "id").groupBy("community").agg(F.sum("d").alias("deg"))
    return (
        deg.join(inside, "community", "left").crossJoin(F.broadcast(m))
        .agg(F.coalesce(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("deg") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("modularity"))
    )


def community_summary(g: CodeGraph, found: DataFrame, min_size: int = 1) -> DataFrame:
    """``community, size, package, internal, external, connectivity`` of communities of ``min_size`` or more; the package is the most frequent one, the least of ties; a single node has connectivity 1."""
    own = found.select("id", "community")
    e = g.edges.join(own.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    e = write_table(e.groupBy("a", "b").agg(F.count("*").alias("n")), "communities-met")
    inner = e.where("a = b").select(F.col("a").alias("community"), F.col("n").alias("internal"))
    outer = e.where("a <> b").select(F.explode(F.array("a", "b")).alias("community"), "n").groupBy("community").agg(F.sum("n").alias("external"))
    packs = own.join(g.nodes.select("id", "package"), "id").groupBy("community", "package").agg(F.count("*").alias("n"))
    main = packs.groupBy("community").agg(F.sum("n").alias("size"), F.min_by("package", F.struct(-F.col("n"), F.col("package"))).alias("package"))
    both = F.col("internal") + F.col("external")
    return (
        main.where(F.col("size") >= min_size).join(inner, "community", "left").join(outer, "community", "left").na.fill(0, ["internal", "external"])
        .select("community", "size", "package", "internal", "external", F.when(F.col("size") == 1, 1.0).when(both > 0, F.col("internal") / both).otherwise(0.0).alias("connectivity"))
    )


#: Words that mark symbols of test code, in any case.
TEST_WORDS = ("assert", "test", "mock", "stub", "fixture", "setup", "teardown", "benchmark", "expect", "verify", "fake", "spy")


def file_classes(g: CodeGraph, passes: int = 5, overrides: dict[str, bool] | None = None) -> DataFrame:
    """``file_path, production``: whether files are production code.

    By the share of incoming among all cross-file edges: below .05 a file isn't, from .15 on and without
    cross-file edges it is; one between is unless over half of its symbols are tests, and then stays. Test names of files,
    and test words (TEST_WORDS) in over .60 of three symbols or more, decide
    against; then up to ``passes`` rounds, without the files between, count only edges from and to production files: below .10 of
    the sum, none left of some, or over 20 incoming edges of which fewer than .10 come from production files, decides against. ``overrides`` prevail.
    """
    f = g.nodes.where("kind <> 'external'").select("id", "file_path", "name")
    e = g.edges.join(f.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst").where("a <> b")
    cross = write_table(e.groupBy("a", "b").agg(F.count("*").alias("n")), "file-edges")
    test_file = F.col("file_path").rlike(r"(_test\.go|_test\.py|(^|/)test_[^/]*\.py|(^|/)conftest\.py|\.(test|spec)\.[jt]sx?)$|(^|/)(tests?|__tests__|testdata|fixtures)/")
    is_test, wordy = F.col("name").rlike(r"^(Test|Benchmark|Fuzz|Example)[A-Z_]|^test_"), F.lower("name").rlike("|".join(TEST_WORDS))
    names = f.groupBy("file_path").agg(F.avg(is_test.cast("int")).alias("tests"), F.avg(wordy.cast("int")).alias("words"), F.count("*").alias("symbols"))
    into, out = cross.groupBy(F.col("b").alias("file_path")).agg(F.sum("n").alias("i")), cross.groupBy(F.col("a").alias("file_path")).agg(F.sum("n").alias("o"))
    base = names.join(into, "file_path", "left").join(out, "file_path", "left").na.fill(0, ["i", "o"])
    ratio = F.when(F.col("i") + F.col("o") > 0, F.col("i") / (F.col("i") + F.col("o"))).otherwise(1.0)
    between = (ratio >= 0.05) & (ratio < 0.15)
    dense = (F.col("symbols") >= 3) & (F.col("words") > 0.60)
    good = ~test_file & ~dense & (ratio >= 0.05) & ~(between & (F.col("tests") > 0.5))
    state = write_table(base.select("file_path", "i", "o", good.alias("production"), between.alias("settled")), "file-classes")
    for _ in range(passes):
        ok = state.where("production").select("file_path")
        real = cross.join(ok.withColumnRenamed("file_path", "a"), "a").groupBy(F.col("b").alias("file_path")).agg(F.sum("n").alias("r"))
        sent = cross.join(ok.withColumnRenamed("file_path", "b"), "b").groupBy(F.col("a").alias("file_path")).agg(F.sum("n").alias("s"))
        total = F.col("r") + F.col("s")
        fails = F.when(total == 0, F.col("i") + F.col("o") > 0).otherwise((F.col("r") / total < 0.10) | ((F.col("i") > 20) & (F.col("r") / F.greatest("i", F.lit(1)) < 0.10)))
        keep = F.col("production") & (F.col("settled") | ~fails)
        joined = state.join(real, "file_path", "left").join(sent, "file_path", "left").na.fill(0, ["r", "s"])
        new = write_table(joined.select("file_path", "i", "o", keep.alias("production"), "settled"), "file-classes")
        same = new.where("production").count() == state.where("production").count()
        drop_table(state)
        state = new
        if same:
            break
    result = F.col("production")
    for path, value in (overrides or {}).items():
        result = F.when(F.col("file_path") == path, F.lit(value)).otherwise(result)
    return state.select("file_path", result.alias("production"))
