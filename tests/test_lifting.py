"""Lifting tables: frontiers, control dependence, edge classes and back edges by definition, and on a deep chain."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import dominators as dm
from graphloom.operators.lifting import ancestor_at, is_ancestor, lift, subtree_sizes, ways_up


def _dominators(pairs, entry):
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
    return {v: {d for d in base if d == v or v not in reach(d)} for v in base}


def _table(spark, doms):
    rows = [(v, v if len(ds) == 1 else max(ds - {v}, key=lambda d: len(doms[d]))) for v, ds in doms.items()]
    return spark.createDataFrame(rows, "id string, idom string")  # no root paths


@pytest.mark.parametrize("seed", range(3))
def test_by_definition(spark, seed):
    r = random.Random(seed)
    n = r.randint(6, 24)
    pairs = sorted({(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(3 * n)} | {("far", "off"), ("off", "n01")})
    e = spark.createDataFrame(pairs + pairs[:5], "src string, dst string")
    dom, post = _dominators(pairs, "n00"), _dominators([(b, a) for a, b in pairs], "n03")
    d, p = _table(spark, dom), _table(spark, post)
    got = sorted(map(tuple, dm.dominance_frontier(e, d).select("id", "frontier").collect()))
    assert got == sorted({(x, w) for u, w in pairs if u != w and u in dom and w in dom for x in dom[u] if x not in dom[w] - {w}})
    out = {}
    for a, b in pairs + pairs[:5]:
        out[a] = out.get(a, 0) + 1
    got = sorted(map(tuple, dm.control_dependence(e, p).select("id", "depends_on").collect()))
    assert got == sorted({(x, a) for a, b in pairs if out[a] >= 2 and b in post for x in post[b] if x not in post.get(a, {a}) - {a}})
    kind = lambda a, b: "back" if b in dom.get(a, ()) else "forward" if a in dom.get(b, ()) else "cross"
    assert dict(map(tuple, subtree_sizes(lift(dm.immediate(d))).collect())) == {v: sum(v in ds for ds in dom.values()) for v in dom}
    assert sorted(map(tuple, dm.edge_classes(e, d).collect())) == sorted((a, b, kind(a, b)) for a, b in pairs + pairs[:5])


def test_jumps_of_a_chain(spark):
    n = 20_000
    tree = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    t = lift(tree)
    assert len(t.jumps) == 15 and t.levels.where("level = id").count() == n
    far = ancestor_at(t, tree.select("id"), "id", F.pmod("id", F.lit(7919)))
    assert far.where("at = id - id % 7919").count() == n
    pairs = spark.createDataFrame([(5, 19_999), (19_999, 5), (7, 7), (3, None), (99_999, 5)], "a long, b long")
    assert {(r["a"], r["b"]): r["yes"] for r in is_ancestor(t, pairs, "a", "b", "yes").collect()} == {(5, 19_999): True, (19_999, 5): False, (7, 7): True, (3, None): False, (99_999, 5): False}
    assert subtree_sizes(t).where(F.col("size") == n - F.col("id")).count() == n
    # ways of a key that overlap are listed once
    ways = spark.createDataFrame([("x", 19_999, 0), ("x", 15_000, 10), ("y", 100, 100), ("y", 50, 51), ("z", 70, 64)], "key string, id long, low long")
    assert {r["key"]: (r["n"], r["lo"], r["d"]) for r in ways_up(t, ways, "key").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.countDistinct("id").alias("d")).collect()} == {"x": (n, 0, n), "y": (1, 100, 1), "z": (7, 64, 7)}


def test_forests_and_cycles(spark):
    s = "id long, parent long"
    t = lift(spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 3)], s))
    assert dict(map(tuple, t.levels.collect())) == {1: 0, 2: 1, 3: 0, 4: 1}
    assert lift(spark.createDataFrame([], s)).levels.count() == 0
    with pytest.raises(ValueError, match="cycle"):
        lift(spark.createDataFrame([(1, 2), (2, 1)], s), 6)
