"""Cut nodes, bridges, blocks, forests and dyadic ranges against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphloom.operators import articulation, dyadic, order, tours


def low_link(pairs):
    """Cut nodes and bridges by a depth-first walk."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    number, low, points, bridges = {}, {}, set(), set()
    for root in near:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack, kids = [(root, None, iter(near[root]))], 0
        while stack:
            v, up, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if up is not None:
                    low[up] = min(low[up], low[v])
                    if low[v] > number[up]:
                        bridges.add((min(up, v), max(up, v)))
                    if up != root and low[v] >= number[up]:
                        points.add(up)
                    kids += up == root
            elif w not in number:
                number[w] = low[w] = len(number)
                stack.append((w, v, iter(near[w])))
            elif w != up:
                low[v] = min(low[v], number[w])
        if kids > 1:
            points.add(root)
    return points, bridges


def graphs():
    r = random.Random(4)
    yield "random", [(r.randrange(90), r.randrange(90)) for _ in range(85)]
    yield "dense", [(r.randrange(40), r.randrange(40)) for _ in range(120)]
    yield "chain", [(i, i + 1) for i in range(300)]
    yield "ring and tail", [(i, (i + 1) % 50) for i in range(50)] + [(7, 100), (100, 101), (101, 102), (102, 100)]
    yield "star", [(0, i) for i in range(1, 200)] + [(1, 2), (2, 3), (5, 6)]
    yield "cliques", [(10 * k + i, 10 * k + j) for k in range(6) for i in range(5) for j in range(i)] + [(10 * k, 10 * k + 13) for k in range(5)] + [(3, 3), (4, 3)]


def test_against_low_link(spark):
    """All graphs at once, as components of one."""
    edges = [(1000 * k + a, 1000 * k + b) for k, (_, own) in enumerate(graphs()) for a, b in own]
    e = spark.createDataFrame([*edges, *edges[:3], (None, 1)], "src long, dst long")
    pairs = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    points, bridges = low_link(pairs)
    got = articulation.articulation(e).collect()
    assert sorted(r["a"] for r in got if r["kind"] == "point") == sorted(points)
    assert sorted((r["a"], r["b"]) for r in got if r["kind"] == "bridge") == sorted(bridges)
    blocks = {}
    for r in articulation.biconnected(e).collect():
        blocks.setdefault(r["block"], set()).add((r["a"], r["b"]))
    assert sorted(p for b in blocks.values() for p in b) == sorted(pairs)
    assert {next(iter(b)) for b in blocks.values() if len(b) == 1} == bridges
    nodes = [{x for p in b for x in p} for b in blocks.values()]
    assert {x for x in set().union(*nodes) if sum(x in n for n in nodes) > 1} == points
    assert all(not low_link(b)[0] for b in blocks.values())


def test_empty(spark):
    assert not articulation.articulation(spark.createDataFrame([(1, 1)], "src long, dst long")).collect()


def test_tour_of_a_forest(spark):
    r = random.Random(1)
    names = [f"n{i}" for i in range(120)]
    pairs = {tuple(sorted(r.sample(names[k : k + 40], 2))) for k in (0, 40, 80) for _ in range(70)}
    p = spark.createDataFrame(sorted(pairs), "a string, b string")
    forest = tours.spanning_forest(p)
    rows = tours.euler_tour(p, forest).collect()
    by = {x["id"]: x for x in rows}
    assert set(by) == {x for q in pairs for x in q} and len(by) == len(rows)
    kept = {(x["a"], x["b"]) for x in forest.collect()}
    assert kept <= pairs and {(min(i, x["parent"]), max(i, x["parent"])) for i, x in by.items() if x["parent"]} == kept
    for i, x in by.items():
        way, at = [], x
        while at["parent"]:
            at = by[at["parent"]]
            way.append(at["id"])
        assert (way[-1] if way else i) == x["root"]
        inside = {j for j, y in by.items() if y["root"] == x["root"] and y["tin"] <= x["tin"] <= y["tout"] and j != i}
        assert inside == set(way)


def test_next_in_order(spark):
    rows = [(i % 7, f"k{i:04}") for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r)[:2]: tuple(r["next"]) if r["next"] else None for r in order.with_next(spark.createDataFrame(rows, "g int, k string").repartition(3), "g", "k").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows)
    assert got == dict(zip(want, [*want[1:], None], strict=True))


def test_dyadic_ranges(spark):
    r = random.Random(9)
    base = {p: r.randint(-50, 50) for p in r.sample(range(1000), 400)}
    values = spark.createDataFrame(list(base.items()), "pos long, value long")
    levels = dyadic.levels_of(values)
    nodes = dyadic.dyadic_nodes(values, levels)
    spans = [(0, 1023), (5, 5), (-10, 2000), (7, 3), (1000, 1022), *(tuple(sorted((r.randrange(1000), r.randrange(1000)))) for _ in range(60))]
    ranges = spark.createDataFrame([*spans, spans[0]], "lo long, hi long")
    got = {(x["lo"], x["hi"]): (x["n"], x["sum"], x["min"], x["max"]) for x in dyadic.range_aggregate(nodes, ranges, levels).collect()}
    assert set(got) == set(spans)
    for lo, hi in spans:
        own = [v for p, v in base.items() if lo <= p <= hi]
        assert got[lo, hi] == (len(own), sum(own) if own else None, min(own, default=None), max(own, default=None))
    widest = ranges.where("lo <= hi AND lo >= 0").select(F.size(dyadic.covering(F.col("lo"), F.col("hi"), levels)).alias("n")).agg(F.max("n")).first()[0]
    assert widest <= 2 * levels
    updates = [(lo, hi, r.randint(-9, 9)) for lo, hi in spans[:30]]
    lazy = dyadic.lazy_updates(spark.createDataFrame(updates, "lo long, hi long, delta long"), levels)
    after = {p: v + sum(d for lo, hi, d in updates if lo <= p <= hi) for p, v in base.items()}
    assert {x["pos"]: x["value"] for x in dyadic.updated_values(values, lazy, levels).collect()} == after
    for x in dyadic.updated_sums(nodes, lazy, ranges, levels).collect():
        own = [v for p, v in after.items() if x["lo"] <= p <= x["hi"]]
        assert (x["n"], x["sum"]) == (len(own), sum(own) if own else None)
