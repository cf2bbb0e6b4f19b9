"""Deep graphs: no depth is cut where the answer needs all of it, and walks in one task equal rounds over the cluster."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import dominators as dm
from graphloom.operators import explore, impact, sequential
from graphloom.operators import structural as st
from graphloom.operators import traversal as tr
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph


def graph(spark, pairs, names=None, etype="calls"):
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, (names or {}).get(i, i), "function", "p", "p/f.go", 1, 2, True, "go") for i in ids], ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, ["string"] * 5 + ["int", "int", "boolean", "string"], strict=True)))
    edges = spark.createDataFrame([(a, b, etype, "p/f.go", 1) for a, b in pairs], ", ".join(f"{c} {t}" for c, t in zip(EDGE_COLUMNS, ["string"] * 4 + ["int"], strict=True)))
    return CodeGraph(nodes, edges)


def brute_idoms(pairs, entry):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def reach(gone):
        seen, todo = {entry} - {gone}, [entry] if entry != gone else []
        while todo:
            for w in near.get(todo.pop(), ()):
                if w not in seen and w != gone:
                    seen.add(w)
                    todo.append(w)
        return seen

    base = reach(None)
    doms = {v: {v} for v in base}
    for d in base:
        for v in base - reach(d):
            doms[v].add(d)
    return {v: v if v == entry else max(doms[v] - {v}, key=lambda d: len(doms[d])) for v in base}


@pytest.mark.parametrize("seed", range(40))
def test_dominators_in_one_task_by_definition(seed):
    import numpy as np

    r = random.Random(seed)
    n = r.randint(1, 14)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 40))}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    src, dst = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    got = sequential.immediate_dominators(sequential.adjacency(src, dst, n), sequential.adjacency(dst, src, n), 0)
    want = brute_idoms(pairs, 0)
    assert got == [want.get(v, -1) for v in range(n)]


def test_both_ways_give_the_same_dominators(spark):
    r = random.Random(3)
    pairs = sorted({(f"n{r.randrange(30):02d}", f"n{r.randrange(30):02d}") for _ in range(70)})
    e = spark.createDataFrame(pairs, "src string, dst string")
    want = brute_idoms([p for p in pairs if p[0] != p[1]], "n00")
    for one in (True, False):
        assert {x["id"]: x["idom"] for x in dm.dominators(e, "n00", sequential=one).collect()} == want
    alone = dm.dominators(e, "nowhere").collect()
    assert [(x["id"], x["idom"], x["path"]) for x in alone] == [("nowhere", "nowhere", ["nowhere"])]


def test_a_chain_of_a_thousand(spark):
    n = 1000
    e = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)], "src string, dst string")
    began = time.time()
    found = {x["id"]: (x["idom"], x["n"]) for x in dm.dominators(e, "n0000").select("id", "idom", F.size("path").alias("n")).collect()}
    assert found == {f"n{i:04d}": (f"n{max(i - 1, 0):04d}", i + 1) for i in range(n + 1)}
    assert time.time() - began < 60
    assert tr.shortest_path(graph(spark, [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)]), "n0000", f"n{n:04d}")[0] == n


def test_unlimited_walks(spark, monkeypatch):
    monkeypatch.setattr(st, "MAX_DEPTH", 11)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(14)]
    g = graph(spark, chain, {"n014": "write_file"})
    reach = tr.bfs(g.edges, tr.one_start(g.edges, "n000"), st.UNLIMITED)
    assert reach.count() == 15 and tr.bfs(g.edges, tr.one_start(g.edges, "n000")).count() == 11 and tr.bfs(g.edges, tr.one_start(g.edges, "n000"), 50).count() == 12
    for one in (True, False):
        assert tr.shortest_path(g, "n000", "n014", sequential=one)[0] == 14
    assert tr.shortest_path(g, "n014", "n000") == (-1, []) and tr.shortest_path(g, "n000", "n000") == (0, ["n000"])


def test_side_effects_at_any_distance(spark):
    g = graph(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(16)] + [("free", "leaf")], {"n16": "write_file"})
    p = spark.createDataFrame([("^write", "io"), ("^send", "net")], "pattern string, effect string")
    got = {r["id"]: (r["effects"], r["pure"]) for r in impact.side_effects(g, p).collect()}
    assert got == {f"n{i:02d}": (1, False) for i in range(17)} | {"free": (0, True), "leaf": (0, True)}


def test_package_blast_at_any_distance(spark, monkeypatch):
    monkeypatch.setattr(st, "MAX_DEPTH", 5)
    d = spark.createDataFrame([(f"p{i:03d}", f"p{i + 1:03d}") for i in range(13)], "src_package string, dst_package string")
    assert explore.package_blast(d, "p013").count() == 13


def test_truncation_is_told(spark):
    g = graph(spark, [(f"c{i:04d}", "t") for i in range(1500)] + [("c0000", "u")])
    t = spark.createDataFrame([("t",), ("u",)], "id string")
    cut = st.references(g, t)
    assert cut.where("target = 't'").count() == 1000 and {(r["target"], r["truncated"]) for r in cut.select("target", "truncated").distinct().collect()} == {("t", True), ("u", False)}
    assert st.references(g, t, st.UNLIMITED).count() == 1501 and st.callers(g, t).count() == 1501
    some = st.callers(g, t, 3)
    assert some.columns == ["target", "caller", "truncated"] and some.count() == 4


def test_taint_is_traced_source_by_source(spark):
    """A complete sanitizer that one source's trace meets clears nothing on another's."""
    g = graph(spark, [("s1", "k"), ("k", "good"), ("s2", "z"), ("z", "bad"), ("s2", "m"), ("m", "mild"), ("s1", "x"), ("x", "shared"), ("s2", "shared")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    clean = spark.createDataFrame([("k", True), ("m", False)], "id string, complete boolean")
    sinks = spark.createDataFrame([(s, "CWE-89") for s in ("good", "bad", "mild", "shared")], "id string, cwe string")
    rows = impact.taint(g, ids("s1", "s2"), clean, sinks).collect()
    got = {(r["source"], r["sink"]): (r["depth"], r["state"], r["vulnerable"]) for r in rows}
    assert got == {
        ("s1", "good"): (2, "clean", False), ("s2", "bad"): (2, "untrusted", True), ("s2", "mild"): (2, "mixed", True),
        ("s1", "shared"): (2, "untrusted", False), ("s2", "shared"): (1, "untrusted", True),
    }
