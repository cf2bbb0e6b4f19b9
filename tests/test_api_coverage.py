"""Coverage of a module's interface: what each of its nodes reaches without leaving the module."""

from __future__ import annotations

import random

from graphloom.operators import impact
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph


def _graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(i, i, "function", "p", "p/f.go", 1, 2, True, "go") for i in ids], ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, ["string"] * 5 + ["int", "int", "boolean", "string"], strict=True)))
    edges = spark.createDataFrame([(a, b, "calls", "p/f.go", 1) for a, b in pairs], ", ".join(f"{c} {t}" for c, t in zip(EDGE_COLUMNS, ["string"] * 4 + ["int"], strict=True)))
    return CodeGraph(nodes, edges)


def test_coverage_by_walks(spark):
    r = random.Random(5)
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(110)]
    home = {i: r.choice("xyz") for i in ids[:-1]} | {ids[-1]: "alone"}
    pairs = [p for p in pairs if ids[-1] not in p]
    want = {}
    for i in ids:
        callers = {a for a, b in pairs if b == i and home[a] != home[i]}
        if callers:
            seen, todo = {i}, [i]
            while todo:
                at = todo.pop()
                for a, b in pairs:
                    if a == at and home[b] == home[i] and b not in seen:
                        seen.add(b)
                        todo.append(b)
            want[i] = (home[i], len(callers), len(seen), len(seen) / sum(h == home[i] for h in home.values()))
    got = impact.api_coverage(_graph(spark, ids, pairs + pairs[:9]), spark.createDataFrame(list(home.items()), "id string, community string"))
    assert {x["id"]: (x["community"], x["external_callers"], x["dominated"], x["coverage"]) for x in got.collect()} == want and want
    none = impact.api_coverage(_graph(spark, ["a", "b"], [("a", "b")]), spark.createDataFrame([("a", "x"), ("b", "x")], "id string, community string"))
    assert none.count() == 0
