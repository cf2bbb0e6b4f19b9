"""Hand-built graphs with known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import search, stats
from graphloom.operators import analytics as an
from graphloom.operators import articulation, code, components, impact, similarity, structural, traversal, trees
from graphloom.operators import dominators as dm
from graphloom.sources.graphs import CodeGraph
from graphloom.streaming import journal

NODES = "id string, name string, kind string, package string, file_path string, start_line int, end_line int, exported boolean, language string"
EDGES = "src string, dst string, etype string, file_path string, line int"


def graph(spark, nodes, edges) -> CodeGraph:
    n = [(i, i.split(":")[-1], k, p, f"{p}/{i}.go", 1, 10, i[0].isupper(), "go") for i, k, p in nodes]
    return CodeGraph(spark.createDataFrame(n, NODES), spark.createDataFrame([(a, b, t, "", 1) for a, b, t in edges], EDGES))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def structural_graph(spark):
    f = [(n, "function", "app") for n in ("main", "setup", "run", "handleAgent", "helper")]
    t = [("Reader", "interface", "io"), ("FileReader", "struct", "io"), ("Config", "struct", "cfg"), ("Server", "struct", "app")]
    e = [("main", "setup", "calls"), ("main", "run", "calls"), ("setup", "handleAgent", "calls"), ("run", "helper", "calls"), ("FileReader", "Reader", "implements"), ("Server", "Config", "embeds")]
    return graph(spark, f + t, e)


def test_structural(structural_graph, spark):
    g = structural_graph
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    assert rows(structural.callers(g, one("setup")), "caller") == [("main",)]
    assert rows(structural.callers(g, one("nobody")), "caller") == []
    assert rows(structural.implementations(g, one("Reader")), "implementation") == [("FileReader",)]
    assert rows(structural.implementations(g, one("Config")), "implementation") == [("Server",)]
    tree = traversal.call_graph(g, "main").collect()
    assert len(tree) == 5 and max(r["depth"] for r in tree) == 2 and sum(r["parent"] is not None for r in tree) == 4
    assert traversal.shortest_path(g, "main", "helper") == (2, ["main", "run", "helper"])
    assert traversal.shortest_path(g, "helper", "main") == (-1, [])
    with pytest.raises(KeyError):
        traversal.call_graph(g, "nobody")
    assert traversal.call_chain(g, "main").where("id = 'helper'").first()["chain"] == ["main", "run", "helper"]
    assert structural.clamp_limit(0) == 1000 and structural.clamp_limit(99_999) == 10_000 and structural.clamp_depth(0) == 0 and structural.clamp_depth(-1) == 10
    assert structural.dangling_edges(g).count() == 0
    less = structural.remove_file(g, "app/run.go")
    assert less.nodes.count() == 8 and less.edges.count() == 4


def test_hot_spots_and_dead_code(spark):
    g = graph(spark, [("Hub", "function", "p"), ("c1", "function", "p"), ("c2", "function", "p"), ("c3", "function", "p"), ("iso", "function", "p"), ("external:x", "external", "")], [(f"c{i}", "Hub", "calls") for i in (1, 2, 3)] + [("c1", "external:x", "calls")] * 9)
    top = an.hot_spots(g, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in top][:2] == [("c1", 9 + 1), ("Hub", 6)]
    assert an.hot_spots(g, 0).count() == 0
    d = graph(spark, [("main", "function", "p"), ("Used", "function", "p"), ("Unused", "function", "p"), ("TestUsed", "function", "p")], [("main", "Used", "calls")])
    assert rows(an.dead_code(d), "id", "reason") == [("Unused", "exported but unreferenced")]


def test_coupling(spark):
    g = graph(spark, [("I", "interface", "stable"), ("S", "struct", "unstable"), ("f", "function", "middle")], [("S", "I", "implements"), ("f", "I", "references"), ("S", "f", "calls")])
    assert rows(an.package_coupling(g), "package", "afferent", "efferent", "instability", "abstractness") == [("middle", 1, 1, 0.5, 0.0), ("stable", 2, 0, 0.0, 1.0), ("unstable", 0, 2, 1.0, 0.0)]


def test_cycles_and_components(spark):
    g = graph(spark, [(x, "function", "cycle") for x in "ABCDE"], [("A", "B", "calls"), ("B", "C", "calls"), ("C", "A", "calls"), ("C", "D", "calls"), ("E", "E", "calls")])
    assert [(r["component"], r["length"], r["packages"]) for r in an.cyclic_dependencies(g).collect()] == [("A", 3, ["cycle"])]
    assert rows(components.connected_components(g.edges), "id", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "A"), ("E", "E")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert components.connected_components(chain).select("component").distinct().collect() == [(0,)]
    assert impact.circular_dependencies(g, "function").count() == 1


def test_hierarchy(spark):
    g = graph(spark, [("Validate", "function", "auth"), ("Token", "struct", "auth"), ("AuthHandler", "function", "auth"), ("Service", "struct", "core"), ("Config", "struct", "core")], [("AuthHandler", "Validate", "calls"), ("Validate", "Token", "references"), ("Service", "Config", "references")])
    assert rows(structural.edge_partition(g), "crossing", "edges") == [(False, 1), (False, 2)]
    assert rows(structural.package_overview(g), "package", "files") == [("auth", 3), ("core", 2)]
    two = graph(spark, [("FuncA", "function", "a"), ("FuncB", "function", "b")], [("FuncA", "FuncB", "calls")])
    assert rows(structural.package_dependencies(two), "src_package", "dst_package", "edges") == [("a", "b", 1)]


def test_pagerank(spark):
    n = 100
    e = [(f"n{i:03d}", f"n{t:03d}", "calls") for i in range(n) for j in range(3 + i % 3) if (t := (i + 17 * j + 7) % n) != i]
    g = graph(spark, [(f"n{i:03d}", "function", "p") for i in range(n)], e)
    r = {x["id"]: x["rank"] for x in an.pagerank(g).collect()}
    assert sum(r.values()) == pytest.approx(1, abs=1e-9)
    rank = dict.fromkeys(r, 1 / n)
    out = {i: [b for a, b, _ in e if a == i] for i in r}
    for _ in range(100):
        new = dict.fromkeys(r, 0.15 / n)
        for a, targets in out.items():
            for b in targets:
                new[b] += 0.85 * rank[a] / len(targets)
        rank = new
    assert all(r[i] == pytest.approx(rank[i], abs=1e-5) for i in r)
    small = graph(spark, [("a", "function", "p"), ("b", "function", "p")], [("a", "b", "calls")])
    one = {x["id"]: x["rank"] for x in an.pagerank(small).collect()}
    assert one["b"] == pytest.approx(0.075 + 0.425 * 0.5 + 0.425) and one["a"] == pytest.approx(0.075 + 0.425 * 0.5)


def test_communities_beat_singletons(spark):
    e = [(f"{c}{i}", f"{c}{j}", "calls") for c in "xy" for i in range(5) for j in range(5) if i != j] + [("x0", "y0", "calls")]
    g = graph(spark, [(f"{c}{i}", "function", c) for c in "xy" for i in range(5)], e)
    found = an.communities(g)
    q = an.modularity(g, found).first()[0]
    assert q > 0.4 and found.select("community").distinct().count() == 2
    assert an.modularity(g, g.nodes.select("id", F.col("id").alias("community"))).first()[0] < 0


TREE = {1: None, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 5, 9: 5}
VALUES = dict(zip(range(1, 10), (5, 10, 2, 8, 3, 7, 4, 1, 6), strict=True))


def test_trees(spark):
    t = spark.createDataFrame([(i, p, VALUES[i]) for i, p in TREE.items()], "id long, parent long, value long")
    paths = trees.root_paths(t)
    v = t.select("id", "value")
    p = spark.createDataFrame([(8, 6), (8, 7), (6, 3), (5, 5), (3, 4), (1, 9), (8, 42)], "u long, v long")
    got = {(r["u"], r["v"]): r for r in trees.lca(paths, p).collect()}
    assert (got[8, 6]["lca"], got[8, 7]["lca"], got[8, 7]["distance"]) == (2, 1, 5)
    assert got[8, 42]["error"] == "unknown node"
    s = {(r["u"], r["v"]): r for r in trees.path_aggregate(paths, v, p.where("v <> 42")).collect()}
    assert [s[k]["sum"] for k in ((8, 7), (6, 3), (8, 6), (5, 5), (3, 4))] == [31, 24, 21, 3, 15] and s[8, 6]["min"] == 1
    assert s[8, 6]["gcd"] == math.gcd(1, 3, 10, 7)
    sub = {r["id"]: r for r in trees.subtree_aggregate(paths, v).collect()}
    assert (sub[2]["sum"], sub[4]["sum"], sub[1]["sum"], sub[2]["max"]) == (27, 12, 46, 10)
    tour = {r["id"]: r for r in trees.euler_tour(paths).collect()}
    assert tour[1]["tin"] == 0 and tour[1]["tout"] == 8 and tour[9]["head"] == 9 and tour[8]["head"] == 1
    assert trees.is_tree(t) and not trees.is_tree(t.where("id <> 5"))
    forest = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "id long, parent long")
    r = trees.lca(trees.root_paths(forest), spark.createDataFrame([(3, 5)], "u long, v long")).first()
    assert r["error"] == "different trees"
    big = spark.createDataFrame([(1, (1 << 63) - 1), (1, 5)], "k int, value long").groupBy("k").agg(*trees.monoids(F.col("value")).values()).first()
    assert big["sum"] == (1 << 63) - 1
    moved = trees.range_update(spark.createDataFrame([(i, 0) for i in range(6)], "pos long, value long"), spark.createDataFrame([(1, 3, 5), (3, 9, 1)], "lo long, hi long, delta long"))
    assert rows(moved, "pos", "value") == [(0, 0), (1, 5), (2, 5), (3, 6), (4, 1), (5, 1)]


def plain_edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_diamond(spark):
    e = plain_edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])
    dom = dm.dominators(e, "A")
    assert rows(dom, "id", "idom") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "A")]
    front = dm.dominance_frontier(e, dom)
    assert rows(front, "id", "frontier") == [("B", "D"), ("C", "D")]
    assert rows(dm.merge_points(e, front), "id", "degree") == [("D", 2)]
    post = dm.post_dominators(e)
    assert {r["id"]: r["idom"] for r in post.collect()} == {"A": "D", "B": "D", "C": "D", "D": None}
    assert rows(dm.control_dependence(e, post), "id", "depends_on") == [("B", "A"), ("C", "A")]
    assert rows(dm.sese_regions(e, dom, post), "entry", "exit", "size")[0] == ("A", "D", 4)
    r = dm.reducibility(e, dom).first()
    assert r["is_reducible"] and r["cross_edges"] == 0 or r["forward_edges"] + r["cross_edges"] == 4
    assert articulation.articulation(e).count() == 0
    assert dm.lowest_common_dominator(dom, ["B", "C"]) == "A" and dm.lowest_common_dominator(dom, ["B", "Z"]) is None
    line = plain_edges(spark, [("A", "B"), ("B", "C")])
    assert rows(articulation.articulation(line), "kind", "a") == [("bridge", "A"), ("bridge", "B"), ("point", "B")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dominators_by_definition(spark, seed):
    import random

    r = random.Random(seed)
    pairs = [("0", str(r.randint(1, 14)))] + [(str(r.randint(0, 14)), str(r.randint(0, 14))) for _ in range(30)]

    def reach(without):
        seen, todo = {"0"} - {without}, ["0"] if without != "0" else []
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b != without and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    every = reach(None)
    dom = {x["id"]: set(x["path"]) for x in dm.dominators(plain_edges(spark, pairs), "0").collect()}
    assert set(dom) == every
    for d in every:
        cut = every - reach(d)
        for n in every:
            assert (d in dom[n]) == (n in cut or n == d), (d, n)


def test_loops_and_irreducible(spark):
    e = plain_edges(spark, [("s", "h"), ("h", "a"), ("a", "b"), ("b", "a"), ("b", "h"), ("h", "x"), ("x", "x")])
    loops, body = dm.natural_loops(e, dm.dominators(e, "s"))
    got = {r["header"]: r for r in loops.collect()}
    assert (got["h"]["size"], got["a"]["size"], got["a"]["parent"], got["a"]["depth"], got["x"]["size"]) == (3, 2, "h", 2, 1)
    bad = plain_edges(spark, [("s", "a"), ("s", "b"), ("a", "b"), ("b", "a")])
    assert not dm.reducibility(bad, dm.dominators(bad, "s")).first()["is_reducible"]


def test_search_and_similarity(spark):
    g = graph(spark, [("Process", "function", "p"), ("ProcessData", "struct", "p"), ("getDatesToProcess", "function", "p"), ("reprocessor", "function", "p"), ("Procss", "variable", "p"), ("other", "function", "p")], [])
    got = [(r["name"], r["match"]) for r in search.fuzzy_search(g.nodes, "process", 10).collect()]
    assert got == [("Process", "exact"), ("ProcessData", "prefix"), ("getDatesToProcess", "word"), ("reprocessor", "substring"), ("Procss", "fuzzy")]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "id int, v array<float>")
    c = v.alias("a").join(v.alias("b"), F.col("a.id") < F.col("b.id")).select(similarity.cosine(F.col("a.v"), F.col("b.v")).alias("c")).orderBy("c").collect()
    assert [r["c"] for r in c] == [0.0, 0.0, pytest.approx(1.0)]
    d = spark.createDataFrame([(1, "a b c d e f\n1\n2\n3\n4"), (2, "a b c d e f\n1\n2\n3\n4"), (3, "x y z w v u\n9\n8\n7\n6"), (4, "short")], "id int, text string")
    assert rows(similarity.clones(d), "a", "b", "kind") == [(1, 2, "exact")]
    s = spark.createDataFrame([(["a", "b"], ["b", "c"])], "x array<string>, y array<string>").select(similarity.jaccard(F.col("x"), F.col("y")), similarity.signature_similarity(similarity.minhash(F.col("x")), similarity.minhash(F.col("x")))).first()
    assert s[0] == pytest.approx(1 / 3) and s[1] == 1.0
    tri = plain_edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert similarity.motif(tri, [("x", "y"), ("y", "z"), ("z", "x")]).count() == 3
    hist = lambda e: sorted(r["n"] for r in similarity.color_histogram(similarity.color_refinement(spark.createDataFrame([(x, "l") for x in "abc"], "id string, label string"), e)).collect())
    assert hist(tri) == [3] and hist(plain_edges(spark, [("a", "b"), ("b", "c")])) != [3]
    q = spark.createDataFrame([('find `parseConfig` in pkg/auth/token.go for getUserName',)], "t string").select(search.query_terms(F.col("t"))).first()[0]
    assert {"parseconfig", "pkg/auth/token.go", "token.go", "getusername", "user"} <= set(q) and "find" not in q


def test_memory_and_packing(spark):
    m = spark.createDataFrame([(1, 0.9), (2, 0.3)], "id int, confidence double")
    f = spark.createDataFrame([(1, 3, 0), (2, 0, 1)], "id int, validations int, contradictions int")
    assert rows(search.memory_feedback(m, f), "id", "confidence") == [(1, 1.0)]
    items = spark.createDataFrame([("q", "a", 0.9, 60), ("q", "b", 0.8, 50), ("q", "c", 0.7, 30)], "query_id string, id string, score double, tokens long")
    assert rows(search.pack_greedy(items, 100), "id", "used") == [("a", 60), ("c", 90)]


def test_code_findings(spark):
    deep = "func f() { if a { if b { for { if c { if d { x = 12345 } } } } } }"
    s = [("f", "f", "function", None, "func f(a int, b, c, d, e, g string)", 1, 80, deep), ("I", "I", "interface", None, "type I interface {}", 1, 1, "type I interface {}")] + [(f"m{i}", f"m{i}", "method", "God", "func m()", 1, 2, "") for i in range(21)]
    df = spark.createDataFrame(s, "id string, name string, kind string, receiver string, signature string, start_line int, end_line int, code string")
    assert {(r["id"], r["smell"]) for r in code.smells(df).collect()} == {("f", "long_function"), ("f", "many_parameters"), ("f", "deep_nesting"), ("f", "magic_number"), ("I", "empty_interface"), ("God", "god_object")}
    assert code.metrics(df).where("id = 'f'").first()["cyclomatic"] == 12
    assert code.breaking_changes("func (s *S) F(a int) error", "func (s *S) F(a int, b string) error") == ["required parameter b added"]
    assert code.breaking_changes("def f(a: int) -> str", "def f(a: str, b=1) -> str") == ["type of a changed"]
    assert code.breaking_changes("func F(a int, b int)", "func F(a int) error") == ["parameter b removed", "result changed"]
    pairs = spark.createDataFrame([("x", "func F(a int)", "func F(a int)")], "id string, old string, new string")
    assert code.signature_changes(pairs).first()["breaking"] is False


def test_impact(spark):
    g = graph(spark, [("src", "function", "p"), ("clean", "function", "p"), ("sink", "function", "p"), ("sink2", "function", "p"), ("TestX", "function", "p")], [("src", "sink", "calls"), ("src", "clean", "calls"), ("clean", "sink2", "calls"), ("TestX", "src", "calls")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    none = spark.createDataFrame([], "id string, complete boolean")
    sinks = spark.createDataFrame([("sink", "CWE-78"), ("sink2", "CWE-89")], "id string, cwe string")
    got = {r["sink"]: (r["state"], r["vulnerable"]) for r in impact.taint(g, ids("src"), none, sinks).collect()}
    assert got == {"sink": ("untrusted", True), "sink2": ("untrusted", True)}
    part = spark.createDataFrame([("clean", False)], "id string, complete boolean")
    assert impact.taint(g, ids("src"), part, sinks).where("sink = 'sink2'").first()["state"] == "mixed"
    cov = {r["id"]: r["coverage"] for r in impact.coverage(g, ids("TestX")).collect()}
    assert cov["src"] == "direct" and cov["sink2"] == "indirect" and cov["TestX"] == "test"
    b = impact.blast_radius(g, ids("sink2")).first()
    assert (b["direct"], b["indirect"], b["risk"]) == (1, 2, "low")
    levels, left = impact.topological_levels(g.edges)
    assert {r["id"]: r["level"] for r in levels.collect()} == {"sink": 0, "sink2": 0, "clean": 1, "src": 2, "TestX": 3} and left.count() == 0


def test_journal(spark, tmp_path):
    j = spark.createDataFrame([(1, "a", "put", 1), (2, "b", "put", 2), (3, "a", "delete", 0)], "seq long, key string, op string, value int")
    assert rows(journal.state(j), "key", "value") == [("b", 2)] and rows(journal.state(j, 2), "key", "value") == [("a", 1), ("b", 2)]
    journal.append(j, f"file://{tmp_path}/j")
    journal.follow(spark, f"file://{tmp_path}/j", "seq long, key string, op string, value int", f"file://{tmp_path}/feed").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/feed").count() == 3
    g = graph(spark, [("A", "function", "p"), ("B", "function", "p"), ("C", "function", "p")], [("A", "B", "calls"), ("B", "C", "calls")])
    fresh = graph(spark, [("B", "function", "p")], [])
    new, how = journal.refresh(g, spark.createDataFrame([("p/B.go", "modified")], "file_path string, op string"), fresh)
    assert rows(new.edges, "src", "dst") == [("A", "B")] and how == "full"
    d = journal.snapshot_diff(g, CodeGraph(g.nodes.where("id <> 'C'"), g.edges.where("dst <> 'C'")))
    assert rows(d, "what", "change", "key") == [("edge", "removed", "B>C>calls"), ("node", "edges", "B"), ("node", "removed", "C")]


def test_trends(spark):
    day = 86_400_000
    h = spark.createDataFrame([("s", 1 * day, 10), ("s", 2 * day, 20), ("s", 20 * day, 60), ("t", 1, 0), ("t", 2, 0), ("t", 3, 5), ("u", 1, 1)], "symbol_id string, timestamp_ms long, direct_callers int")
    got = {r["symbol_id"]: (r["baseline"], r["growth"], r["rapid"]) for r in stats.trend(h, 20 * day).collect()}
    assert got["s"] == (20, 200.0, True) and "u" not in got
    assert stats.alerts(stats.trend(h, 20 * day)).where("symbol_id = 's'").count() == 2
    gate = stats.regression_gate(*(spark.createDataFrame(x, "measure string, value double") for x in ([("p50", 100.0), ("throughput", 10.0)], [("p50", 106.0), ("throughput", 9.9)])))
    assert {r["measure"]: r["failed"] for r in gate.collect()} == {"p50": True, "throughput": False}


def test_exploration(spark):
    from graphloom.operators import explore

    g = graph(spark, [("main", "function", "p"), ("readInput", "function", "p"), ("toJson", "function", "q"), ("writeFile", "function", "q"), ("newParseError", "function", "q")], [("main", "readInput", "calls"), ("readInput", "toJson", "calls"), ("toJson", "writeFile", "calls"), ("readInput", "newParseError", "calls")])
    assert rows(explore.data_flow(g, "main"), "id", "role") == [("main", "other"), ("newParseError", "other"), ("readInput", "source"), ("toJson", "transform"), ("writeFile", "sink")]
    err = {r["id"]: r["escapes"] for r in explore.error_flow(g).collect()}
    assert err == {"newParseError": False, "readInput": False, "main": True}
    assert rows(explore.public_api(graph(spark, [("A", "function", "p"), ("b", "function", "q")], [("b", "A", "calls")]), "p"), "id", "users") == [("A", 1)]
    c = spark.createDataFrame([(1, 1), (2, -1), (2, 2), (3, -2), (3, -3)], "clause int, literal int")
    forced, bad = explore.unit_propagation(c)
    assert not bad and {r[0] for r in forced.collect()} == {1, 2, -3}
    assert explore.unit_propagation(spark.createDataFrame([(1, 1), (2, -1)], "clause int, literal int"))[1]
    assert explore.sample_size(0.5) == 63 and explore.achieved_power(0.5, 64) == pytest.approx(0.807, abs=0.01)
    s = spark.createDataFrame([("f", "func f(a int) error", "if a { return b }"), ("g", "func g(a int) error", "if a { return b }"), ("h", "func h(a, b, c int)", "for x { y }")], "id string, signature string, code string")
    fp = explore.fingerprints(s)
    pairs = fp.selectExpr("id AS i", "fp AS a").crossJoin(fp.selectExpr("id AS j", "fp AS b")).where("i < j")
    got = {(r["i"], r["j"]): r["s"] for r in pairs.select("i", "j", similarity.fingerprint_similarity("a", "b").alias("s")).collect()}
    assert got["f", "g"] == pytest.approx(1.0) and got["f", "h"] < 0.5


def modularity_of(edges, label):
    m, q = len(edges), 0.0
    for c in set(label.values()):
        inner = sum(label[a] == c == label[b] for a, b in edges)
        ends = sum((label[a] == c) + (label[b] == c) for a, b in edges)
        q += inner / m - (ends / (2 * m)) ** 2
    return q


def one_level(nodes, edges):
    """Local moves in sequence until none gains: what one level can reach."""
    label = {v: v for v in nodes}
    moved = True
    while moved:
        moved = False
        for v in nodes:
            best, now = label[v], modularity_of(edges, label)
            for c in sorted({label[b] if a == v else label[a] for a, b in edges if v in (a, b)}):
                label[v], old = c, label[v]
                q = modularity_of(edges, label)
                label[v] = old
                if q > now + 1e-9:
                    best, now = c, q
            moved |= best != label[v]
            label[v] = best
    return label


def test_communities_on_several_levels(spark):
    """A ring of small cliques, a random graph and a lone node, as components of one graph; cliques in pairs only join on a second level."""
    import random

    r = random.Random(2)
    edges = [(f"k{c:02}.{i}", f"k{c:02}.{j}") for c in range(24) for i in range(4) for j in range(i)] + [(f"k{c:02}.0", f"k{(c + 1) % 24:02}.1") for c in range(24)]
    edges += [(f"r{r.randrange(12)}", f"r{r.randrange(12)}") for _ in range(30)]
    nodes = sorted({v for e in edges for v in e} | {"lone"})
    g = graph(spark, [(v, "function", "p") for v in nodes], [(a, b, "calls") for a, b in edges])
    found = an.communities(g)
    label = {x["id"]: x["community"] for x in found.collect()}
    assert set(label) == set(nodes) and all(label[c] == c and c == min(v for v in nodes if label[v] == c) for c in label.values())
    q = modularity_of(edges, label)
    assert an.modularity(g, found).first()[0] == pytest.approx(q)
    assert q >= modularity_of(edges, one_level(nodes, edges)) - 1e-9
    sizes = [sum(x == c for x in label.values()) for c in set(label.values()) if c.startswith("k")]
    assert max(sizes) >= 8 and all(s % 4 == 0 for s in sizes)
    for c in set(label.values()):  # connected
        own = {v for v in nodes if label[v] == c}
        reached, todo = {c}, [c]
        while todo:
            v = todo.pop()
            for w in {b if a == v else a for a, b in edges if v in (a, b)} & own - reached:
                reached.add(w)
                todo.append(w)
        assert reached == own
    assert an.communities(graph(spark, [("a", "function", "p")], [])).collect()[0]["community"] == "a"
