"""Linear sketches: parts add up to the whole, deletes cancel inserts, samples are uniform, components are those of what is left."""

from __future__ import annotations

import collections
import random

from graphloom.functions import sketches


def cells(df):
    return sorted(tuple(r) for r in df.collect())


def test_samples_of_what_is_left(spark):
    r = random.Random(3)
    live = {k * 7919 - 1000: r.choice([1, 2, 5, -3]) for k in range(12)}
    updates = [(k, d) for k, d in live.items()] + [(10**15 + i, s) for i in range(400) for s in (2, -1, -1)]
    r.shuffle(updates)
    df = spark.createDataFrame(updates, "key long, delta long")
    whole = sketches.l0_sketch(df, 600)
    a, b = spark.createDataFrame(updates[:500], "key long, delta long"), spark.createDataFrame(updates[500:], "key long, delta long")
    assert cells(sketches.merged(sketches.l0_sketch(a, 600), sketches.l0_sketch(b, 600))) == cells(whole)
    assert cells(sketches.merged(whole, sketches.l0_sketch(a, 600), -1)) == cells(sketches.l0_sketch(b, 600))
    got = sketches.l0_samples(whole).collect()
    assert all(live.get(x["key"]) == x["total"] for x in got) and len({x["sampler"] for x in got}) == len(got) > 360
    counts = collections.Counter(x["key"] for x in got)
    expected = len(got) / len(live)
    assert sum((counts[k] - expected) ** 2 / expected for k in live) < 31.3  # chi-squared with 11 degrees of freedom, one in a thousand
    assert not sketches.l0_samples(sketches.merged(whole, whole, -1)).collect()


def plain_components(nodes, edges):
    up = {v: v for v in nodes}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {v: top(v) for v in nodes}


def test_components_after_deletes(spark):
    r = random.Random(8)
    nodes = range(160)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(150)] + [(i, i + 1) for i in range(120, 150)]
    gone = r.sample(edges, 60)
    left = list(edges)
    for e in gone:
        left.remove(e)
    updates = [(a, b, 1) for a, b in edges] + [(b, a, -1) for a, b in gone]  # deleted the other way round
    schema = "src long, dst long, delta int"
    parts = [spark.createDataFrame(updates[k::2], schema) for k in (0, 1)]
    sketch = sketches.merged(*(sketches.agm_sketch(p, 18) for p in parts))
    assert cells(sketch) == cells(sketches.agm_sketch(spark.createDataFrame([(a, b, 1) for a, b in left], schema), 18))
    found, whole = sketches.agm_components(spark.createDataFrame([(v,) for v in nodes], "id long"), sketch)
    assert whole and {x["id"]: x["component"] for x in found.collect()} == plain_components(nodes, left)
    _, whole = sketches.agm_components(spark.createDataFrame([(v,) for v in nodes], "id long"), sketches.agm_sketch(spark.createDataFrame([(i, i + 1, 1) for i in range(150)], schema), 1))
    assert not whole  # one round can't join a chain
