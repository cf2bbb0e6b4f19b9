"""Limits are stated or gone: colour refinement, recall of clones, depth of taint, repeated stream batches."""

from __future__ import annotations

import random

from graphloom.operators import impact, similarity
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph


def test_colours_of_a_long_path(spark):
    n = 40
    nodes = spark.createDataFrame([(i, "l") for i in range(n)], "id long, label string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    whole = similarity.color_refinement(nodes, edges, None).collect()
    colour = {r["id"]: r["color"] for r in whole}
    assert all(r["settled"] for r in whole) and len(set(colour.values())) == n // 2
    assert all(colour[i] == colour[n - 1 - i] for i in range(n))
    few = similarity.color_refinement(nodes, edges).collect()
    assert not any(r["settled"] for r in few) and len({r["color"] for r in few}) == 11


def test_recall_of_structural_clones(spark):
    """Pairs of one skeleton at a similarity of .6 to .95, against brute force."""
    r = random.Random(4)
    rows = []
    for g in range(60):
        words = [f"w{g}x{i}" for i in range(40)]
        other = list(words)
        for i in sorted(r.sample(range(8), r.choice([1, 2]))):
            other[5 * i + 2] = f"c{g}x{i}"
        for k, w in enumerate((words, other)):
            rows.append((2 * g + k, "\n".join(" ".join(w[j : j + 8]) for j in range(0, 40, 8))))

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for g in range(60):
        a, b = grams(rows[2 * g][1]), grams(rows[2 * g + 1][1])
        if 0.6 <= len(a & b) / len(a | b) < 0.95:
            want.add((2 * g, 2 * g + 1))
    found = similarity.clones(spark.createDataFrame(rows, "id long, text string")).collect()
    got = {(x["a"], x["b"]) for x in found if x["kind"] == "structural"}
    assert len(want) >= 25 and got <= want and len(got) >= 0.9 * len(want)


def test_taint_says_where_it_stopped(spark):
    nodes = [(f"n{i}", f"n{i}", "function", "p", "f.go", 1, 1, True, "go") for i in range(8)]
    g = CodeGraph(
        spark.createDataFrame(nodes, ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, ["string"] * 5 + ["int", "int", "boolean", "string"], strict=True))),
        spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls", "", 1) for i in range(7)], ", ".join(f"{c} {t}" for c, t in zip(EDGE_COLUMNS, ["string"] * 4 + ["int"], strict=True))),
    )
    source, none = spark.createDataFrame([("n0",)], "id string"), spark.createDataFrame([], "id string, complete boolean")
    sinks = spark.createDataFrame([("n2", "CWE-1"), ("n6", "CWE-1")], "id string, cwe string")
    flags = lambda depth: {r["sink"]: r["truncated"] for r in impact.taint(g, source, none, sinks, depth).collect()}
    assert flags(3) == {"n2": True} and flags(7) == {"n2": False, "n6": False} and flags(20) == {"n2": False, "n6": False}
