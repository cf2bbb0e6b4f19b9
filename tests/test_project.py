"""Batches, contexts, cycles, policies and staged runs on small tables, against plain definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import search
from graphloom.operators import project as pj
from graphloom.operators import similarity as sim
from graphloom.operators import trees
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph

NODES = ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, ["string"] * 5 + ["int", "int", "boolean", "string"], strict=True))
EDGES = ", ".join(f"{c} {t}" for c, t in zip(EDGE_COLUMNS, ["string"] * 4 + ["int"], strict=True))


def node(i, name="x", start=1, end=1, kind="function"):
    return (i, name, kind, "p", "p/f.go", start, end, True, "go")


def test_batches_are_added_whole_or_not_at_all(spark):
    index = spark.createDataFrame([node("a"), node("b")], NODES)
    batch = lambda *rows: spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], NODES + ", at int")
    more, bad = pj.add_batch(index, batch(node("c"), node("d")))
    assert {r["id"] for r in more.collect()} == {"a", "b", "c", "d"} and not bad.collect()
    same, bad = pj.add_batch(index, batch(node("c"), node("c"), node(None), node("e", ""), node("f", "f", 5, 2), node("a")))
    assert same.count() == 2 and {(r["at"], r["reason"]) for r in bad.collect()} == {(1, "repeated in the batch"), (2, "invalid"), (3, "invalid"), (4, "invalid")}
    same, bad = pj.add_batch(index, batch(node("c"), node("a")))
    assert same.count() == 2 and [(r["at"], r["reason"]) for r in bad.collect()] == [(1, "in the index")]


def test_minimal_context_by_hand(spark):
    nodes = [node("t", end=4), *(node(f"s{i:02d}", kind="struct", end=2 + 100 * (i == 3)) for i in range(12)), node("i1", kind="interface"), node("f1"), node("f2")]
    edges = [("t", f"s{i:02d}", "references", "", 1) for i in range(12)] + [("t", "i1", "implements", "", 1), ("t", "f1", "calls", "", 1), ("t", "f2", "calls", "", 1), ("t", "f2", "calls", "", 2), ("t", "t", "calls", "", 1)]
    g = CodeGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    rows = sorted((r["total"], r["part"], r["id"]) for r in pj.minimal_context(g, spark.createDataFrame([("t",), ("f1",)], "id string"), 340).where("target = 't'").collect())
    kept = [f"s{i:02d}" for i in range(12) if i != 3][:10]
    assert rows == [(50, "target", "t"), *((50 + 25 * (k + 1), "type", s) for k, s in enumerate(kept)), (312, "interface", "i1"), (324, "callee", "f2"), (336, "callee", "f1")]


def brute_cycle(pairs, start):
    best, level, seen = None, [[start]], {start}
    while level and best is None:
        nxt = []
        for way in sorted(level):
            for a, b in sorted(pairs):
                if a == way[-1]:
                    if b == start:
                        best = best or [*way, start]
                    elif b not in seen:
                        seen.add(b)
                        nxt.append([*way, b])
        level = nxt
    return best or []


def test_shortest_cycle_both_ways(spark):
    r = random.Random(2)
    for seed in range(3):
        pairs = sorted({(f"p{r.randrange(9)}", f"p{r.randrange(9)}") for _ in range(12)})
        d = spark.createDataFrame([p for p in pairs if p[0] != p[1]] or [("a", "b")], "src_package string, dst_package string")
        want = brute_cycle([p for p in pairs if p[0] != p[1]], "p1")
        assert len(pj.shortest_cycle(d, "p1")) == len(want), seed
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a2"), ("a2", "a3"), ("a3", "a")], "src_package string, dst_package string")
    for one in (True, False):
        assert pj.shortest_cycle(d, "a", one) == ["a", "b", "c", "a"] and pj.shortest_cycle(d, "zz", one) == []


def test_types_methods_and_plans(spark):
    want = {
        (" int", "int "): ("exact", 1.0, []), ("int", "int64"): ("builtin", 0.95, []), ("int64", "int"): ("builtin", 0.95, []), ("int32", "int64"): ("none", 0.8, ["int64(value)"]), ("int8", "int16"): ("none", 0.8, ["int16(value)"]),
        ("float64", "float32"): ("builtin", 0.95, []), ("byte", "uint8"): ("builtin", 0.95, []), ("uint8", "byte"): ("none", 0.8, []), ("rune", "int32"): ("builtin", 0.95, []), ("File", "Reader"): ("interface", 0.9, []), ("Reader", "File"): ("none", 0.8, []),
        ("*File", "File"): ("dereference", 0.7, []), ("File", "*File"): ("address", 0.6, []), ("**T", "T"): ("none", 0.8, ["*value (dereference)"]), ("[]T", "[]T"): ("exact", 1.0, []), ("[]T", "[2]T"): ("none", 0.8, []),
        ("T", "any"): ("anything", 0.95, []), ("T", "interface{}"): ("anything", 0.95, []), ("string", "[]rune"): ("none", 0.8, ["[]rune(value)"]), ("[]byte", "string"): ("none", 0.8, ["string(value)"]), ("A", "*B"): ("none", 0.8, ["&value (if addressable)"]), ("", "any"): ("invalid", None, []), (None, "x"): ("invalid", None, []),
    }
    pairs = spark.createDataFrame(list(want), "source string, target string")
    ok = spark.createDataFrame([("File", "Reader"), ("File", "Reader")], "type string, interface string")
    got = pj.type_compatibility(pairs, ok).collect()
    assert len(got) == len(want) and {(r["source"], r["target"]): (r["reason"], r["confidence"], r["conversions"]) for r in got} == want
    assert all(r["compatible"] == (r["reason"] not in ("none", "invalid")) for r in got)
    g = CodeGraph(spark.createDataFrame([node("a"), node("b")], NODES), spark.createDataFrame([], EDGES))
    bad = pj.invalid_changes(g, spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "x")], "id string, change string")).collect()
    assert {(r["id"], r["reason"]) for r in bad} == {("a", "conflicting changes"), ("z", "no such symbol")}


def test_policies(spark):
    i = spark.createDataFrame([("E501", 1), ("E999", 2), ("W1", 3), ("X", 4)], "rule string, at int")
    p = spark.createDataFrame([("E*", "error"), ("E5*", "ignore"), ("W1", "info")], "pattern string, level string")
    assert {r["rule"]: r["level"] for r in pj.apply_policy(i, p).collect()} == {"E999": "error", "W1": "info", "X": "warning"}
    assert {r["level"] for r in pj.apply_policy(i, None).collect()} == {"warning"}


def test_invariants(spark):
    d = spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 0.5)], "k int, x double")
    got = {r["property"]: r["holds"] for r in pj.check(d, {"u": pj.holds_unique("k"), "b": pj.holds_bounded("x", 0, 1), "d": pj.holds_distribution("x"), "i": pj.implies(pj.holds_unique("k"), pj.holds_distribution("x")), "one": pj.holds_unique("k", "x")}).collect()}
    assert got == {"u": False, "b": True, "d": False, "i": True, "one": False}
    assert pj.check(d.distinct(), {"u": pj.holds_unique("k")}).first()["holds"]
    assert all(r["holds"] for r in pj.check(d.limit(0), {"u": pj.holds_unique("k"), "b": pj.holds_bounded("x", 0, 1)}).collect())


def test_staged_runs_go_on_where_they_stopped(spark, tmp_path):
    runs = []

    def stage(name, fails=0):
        def make(*inputs):
            runs.append(name)
            if runs.count(name) <= fails:
                raise RuntimeError("not yet")
            return spark.range(1 + sum(i.count() for i in inputs))

        return make

    root = f"file://{tmp_path}/run"
    stages = [("c", ["a", "b"], stage("c", 9)), ("a", [], stage("a")), ("b", ["a"], stage("b", 1))]
    with pytest.raises(RuntimeError):
        pj.run_stages(spark, stages, root, attempts=2)
    assert runs == ["a", "b", "b", "c", "c"]
    stages[0] = ("c", ["a", "b"], stage("c"))
    runs.clear()
    assert pj.run_stages(spark, stages, root)["c"].count() == 4 and runs == ["c"]
    with pytest.raises(ValueError, match="can't run"):
        pj.run_stages(spark, [("x", ["y"], stage("x"))], root)
    assert pj.kept(spark, root, "k", "g1", stage("k")).count() == pj.kept(spark, root, "k", "g1", stage("k")).count() == 1 and runs.count("k") == 1


def test_search_for_the_best_is_exact(spark):
    r = random.Random(4)
    words = ["the"] * 30 + ["of"] * 20 + [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(6))) for i in range(12)] + [(90, "none such"), (91, "")], "query_id long, text string")
    full = {}
    for x in search.bm25(docs, asked).collect():
        full.setdefault(x["query_id"], []).append((-round(x["score"], 8), x["doc_id"]))
    got = {}
    for x in search.bm25_top(docs, asked, 7).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], -round(x["score"], 8), x["doc_id"]))
    assert {q: [s for _, s, _ in sorted(v)] for q, v in got.items()} == {q: [s for s, _ in sorted(v)[:7]] for q, v in full.items()}


def test_similar_texts_against_brute_force(spark):
    r = random.Random(6)
    base = [" ".join(f"w{r.randrange(50)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, " ".join("new" if k == i % 60 else w for k, w in enumerate(t.split()))) for i, t in enumerate(base)] + [(200, base[0]), (201, ""), (202, None), (203, "a b"), (204, "a b")]
    d = spark.createDataFrame(rows, "id long, text string")
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    asked = [i for i in grams if i % 2 == 0 or i == 203]
    want = {(a, b) for a in asked for b in grams if a != b and grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    got = {(x["query"], x["id"]) for x in sim.similar_texts(d, d.where(F.col("id").isin(asked))).collect()}
    assert got == want and len(want) > 10


def test_carries_over_many_blocks(spark):
    v = spark.createDataFrame([(p, 0) for p in (0, 4095, 4096, 20_000_000, 40_000_000, 70_000_000)], "pos long, value long")
    u = spark.createDataFrame([(0, 50_000_000, 1), (4096, 4096, 10), (20_000_000, 90_000_000, 100)], "lo long, hi long, delta long")
    assert {x["pos"]: x["value"] for x in trees.range_update(v, u).collect()} == {0: 1, 4095: 1, 4096: 11, 20_000_000: 101, 40_000_000: 101, 70_000_000: 100}
