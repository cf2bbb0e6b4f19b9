"""Paths from segments of heavy chains equal paths node by node."""

from __future__ import annotations

import random

from graphloom.operators import chains, trees


def test_against_path_aggregate(spark):
    r = random.Random(3)
    parent = {0: None, 1000: None, 2000: None}
    parent |= {i: r.randrange(max(0, i - 6), i) for i in range(1, 120)} | {1000 + i: 1000 + i - 1 for i in range(1, 60)}  # a tree, a chain and a lone node
    value = {i: r.randint(-99, 99) for i in parent}
    tree = spark.createDataFrame(list(parent.items()), "id long, parent long")
    values = spark.createDataFrame(list(value.items()), "id long, value long")
    pairs = {tuple(r.choices(range(120), k=2)) for _ in range(60)} | {(1000 + a, 1000 + b) for a, b in ((0, 59), (59, 0), (20, 20), (7, 40))} | {(2000, 2000), (0, 1000), (5, 99999)}
    p = spark.createDataFrame(sorted(pairs), "u long, v long")
    heavy = chains.heavy_chains(tree)
    rows = {x["id"]: x for x in heavy.collect()}
    assert set(rows) == set(parent)
    tour = {x["id"]: x for x in trees.euler_tour(trees.root_paths(tree)).collect()}
    assert all((x["size"], x["head"]) == (tour[i]["size"], tour[i]["head"]) for i, x in rows.items())
    got = {(x["u"], x["v"]): x for x in chains.segment_aggregate(heavy, values, p).collect()}
    want = {(x["u"], x["v"]): x for x in trees.path_aggregate(trees.root_paths(tree), values, p).collect()}
    assert set(got) == set(want) == pairs - {(0, 1000), (5, 99999)}
    for k, x in got.items():
        assert (x["sum"], x["min"], x["max"]) == (want[k]["sum"], want[k]["min"], want[k]["max"])
        assert x["segments"] <= 2 * 8
    assert got[1000, 1059]["segments"] == 1 and got[1000, 1059]["nodes"] == 60
    for (u, v), x in got.items():
        up = lambda i: [i] + (up(parent[i]) if parent[i] is not None else [])
        a, b = up(u), up(v)
        top = next(i for i in a if i in b)
        path = {*a[: a.index(top) + 1], *b[: b.index(top) + 1]}
        assert x["nodes"] == len(path) and x["segments"] == len({rows[i]["head"] for i in path})
