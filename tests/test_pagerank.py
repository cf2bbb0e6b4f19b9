"""Registered PageRanks against plain power iteration."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry
from graphloom.operators import dominators as dm
from graphloom.operators.analytics import pagerank
from graphloom.sources.graphs import CodeGraph, supply_graph
from graphloom.plans import catalog_flow
from graphloom.plans.catalog_flow import flow_graph


def brute(ids, edges, limit=100, tolerance=1e-6):
    ids, n = set(ids), len(set(ids))
    out = Counter(a for a, _ in edges)
    rank = dict.fromkeys(ids, 1 / n)
    for rounds in range(1, limit + 1):
        given = Counter()
        for a, b in edges:
            if a in ids:
                given[b] += rank[a] / out[a]
        sunk = sum(rank[i] for i in ids if i not in out)
        new = {i: 0.15 / n + 0.85 * sunk / n + 0.85 * given[i] for i in ids}
        moved = max(abs(new[i] - rank[i]) for i in ids)
        rank = new
        if moved < tolerance:
            break
    return rank, moved, rounds


def test_supply_converges(spark, sf):
    g = supply_graph(spark, sf)
    want, moved, rounds = brute([r["id"] for r in g.nodes.select("id").collect()], [tuple(r) for r in g.edges.select("src", "dst").collect()])
    assert moved < 1e-6 and rounds > 6
    got = {r["id"]: r["rank"] for r in entry.queries()["pagerank_converged_supply"](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-8


def test_both_ways_give_the_same_ranks(spark):
    """Parallel edges, self-loops, nodes without edges, sinks, and edges to and from what is no node."""
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a"), ("a", "gone"), ("lost", "a"), *((f"n{i}", f"n{(i * 3) % 9}") for i in range(9))]
    nodes = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "alone", *(f"n{i}" for i in range(9))]], "id string")
    g = CodeGraph(nodes, spark.createDataFrame(links, "src string, dst string"))
    one, many = ({r["id"]: r["rank"] for r in pagerank(g, sequential=s).collect()} for s in (True, False))
    assert one.keys() == many.keys() and one == pytest.approx(many, abs=1e-12)
    assert not pagerank(CodeGraph(nodes.limit(0), g.edges)).collect()


def test_weighted_criticality_runs_to_the_end(spark, sf, monkeypatch):
    """On a ring with one chord, ranks still move after 20 iterations."""
    links = [(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)] + [("world", "n0"), ("n0", "n5"), ("n3", "n0")]
    e = spark.createDataFrame(links, "src string, dst string")
    monkeypatch.setattr(catalog_flow, "flow_graph", lambda spark, d: e)
    dom = dm.dominators(e, "world")
    want, moved, rounds = brute([r["id"] for r in dom.select("id").collect()], links)
    assert moved < 1e-6 and rounds > 20
    ranks = spark.createDataFrame(list(want.items()), "id string, rank double")
    one = {r["id"]: tuple(r) for r in dm.weighted_criticality(dom, ranks).collect()}
    got = {r["id"]: tuple(r) for r in entry.queries()["weighted_criticality_flow"](spark, sf).collect()}
    assert got.keys() == one.keys()
    for i in one:
        assert got[i] == pytest.approx(one[i], abs=1e-8), i
