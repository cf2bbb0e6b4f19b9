"""Large flow graphs: dominators of smaller graphs, and frontiers, control dependence and edge classes that shuffle edges once an end, with the same rows."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import dominators as dm
from graphloom.operators import lifting, sequential
from tests.test_contraction import tree_of
from tests.test_deep import brute_idoms
from tests.test_lifting import _dominators, _table


@pytest.fixture
def contracted(monkeypatch):
    """Edges of the graphs that are contracted, when few fit one task."""
    seen, real = [], dm.contract
    monkeypatch.setattr(sequential, "MAX_EDGES", 40)
    monkeypatch.setattr(dm, "contract", lambda pairs, entry: seen.append(pairs.count()) or real(pairs, entry))
    return seen


def layered(seed):
    """Few nodes in the middle and many at the end, each with several sources, as suppliers and parts have them."""
    r = random.Random(seed)
    inner = [("w", f"r{i}") for i in range(3)] + [(f"r{r.randrange(3)}", f"n{i}") for i in range(6)] + [(f"n{r.randrange(6)}", f"s{i}") for i in range(12)]
    return inner + [(f"s{r.randrange(12)}", f"p{i}") for i in range(60) for _ in range(r.randint(1, 5))]


def test_leaves_and_siblings_are_not_contracted(spark, contracted):
    """All edges were numbered and contracted, in a dozen shuffles."""
    pairs = layered(1)
    assert tree_of(spark, pairs, "w") == brute_idoms(pairs, "w")
    back = [(b, a) for a, b in pairs] + [("exit", p) for p in {b for _, b in pairs if b.startswith("p")}]
    assert tree_of(spark, back, "exit") == brute_idoms(back, "exit")
    assert all(n < len(set(pairs)) / 4 for n in contracted)


def test_smaller_graphs_have_the_same_dominators(spark, contracted):
    """Loops, back edges into the entry and into single predecessors, nodes that aren't reached, parallel edges."""
    r = random.Random(0)
    pairs = [*layered(0), ("n1", "w"), ("p1", "n2"), ("p2", "s3"), ("x", "y"), ("y", "x"), ("y", "p3"), ("s1", "r1"), ("s2", "r1"), (None, "p4"), ("p5", "p5")]
    pairs += [(f"p{i}", f"q{r.randrange(40)}") for i in range(60)]
    real = [(a, b) for a, b in pairs if a]
    assert tree_of(spark, pairs + pairs[:9], "w") == brute_idoms(real, "w")
    assert tree_of(spark, [("w", "only")], "only") == {"only": "only"}


def test_deep_graphs_with_leaves(spark, contracted, monkeypatch):
    """Root paths of the inner graph would be too long: leaves are contracted with it."""
    monkeypatch.setattr(lifting, "SHALLOW", 2)
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    pairs = chain + [(f"c{(i * k) % 31:02d}", f"leaf{i:03d}") for i in range(90) for k in (1, 3, 7)]
    assert tree_of(spark, pairs, "c00") == brute_idoms(pairs, "c00") and contracted


@pytest.mark.parametrize("most", [1 << 20, 0])
@pytest.mark.parametrize("depth", [6, -1])
def test_frontiers_by_definition(spark, monkeypatch, most, depth):
    """Shallow and deep trees, keys dealt evenly or not."""
    monkeypatch.setattr(lifting, "SHALLOW", depth)
    monkeypatch.setattr(dm, "BUCKET_ROWS", most)
    if most == 0:
        monkeypatch.setattr(dm, "BUCKETS", 1 << 20)
    r = random.Random(7)
    pairs = sorted({(f"n{r.randrange(20):02d}", f"n{r.randrange(20):02d}") for _ in range(50)} | {("far", "off")})
    e = spark.createDataFrame(pairs + pairs[:5], "src string, dst string")
    dom, post = _dominators(pairs, "n00"), _dominators([(b, a) for a, b in pairs], "n03")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(dm.dominance_frontier(e, _table(spark, dom))) == sorted({(x, w) for u, w in pairs if u != w and u in dom and w in dom for x in dom[u] if x not in dom[w] - {w}})
    out = {}
    for a, _ in pairs + pairs[:5]:
        out[a] = out.get(a, 0) + 1
    assert rows(dm.control_dependence(e, _table(spark, post))) == sorted({(x, a) for a, b in pairs if out[a] >= 2 and b in post for x in post[b] if x not in post.get(a, {a}) - {a}})
    kind = lambda a, b: "back" if b in dom.get(a, ()) else "forward" if a in dom.get(b, ()) else "cross"
    assert rows(dm.edge_classes(e, _table(spark, dom))) == sorted((a, b, kind(a, b)) for a, b in pairs + pairs[:5])


def test_shallow_trees_need_no_jumps(spark, monkeypatch):
    """Edges were joined with each table of ancestors, up to a dozen times."""

    def jumped(*a, **k):
        raise AssertionError("a join a digit of the depth")

    monkeypatch.setattr(lifting, "ancestor_at", jumped)
    monkeypatch.setattr(dm, "ways_up", jumped)
    pairs = layered(3)
    e = spark.createDataFrame(pairs, "src string, dst string")
    doms = _dominators(pairs, "w")
    d = _table(spark, doms)
    plan = dm.dominance_frontier(e, d)
    assert plan.count() == len({(x, w) for u, w in pairs for x in doms[u] if x not in doms[w] - {w}})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[-1].count("Exchange hashpartitioning(dst") == 2 and "hashpartitioning(dst#0, id" not in text
    assert dm.edge_classes(e, d).count() == len(pairs) and dm.control_dependence(e, d).count() > 0


def test_reducibility_drops_what_leads_nowhere_first(spark, monkeypatch):
    """All forward edges were written, and looked at from both ends, before the first was dropped."""
    sizes, write = [], dm.write_table

    def spy(df, name, *a):
        out = write(df, name, *a)
        if name == "reducibility":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(dm, "write_table", spy)
    pairs = layered(4)
    e = spark.createDataFrame([*pairs, ("s1", "s1x"), ("s1x", "s2x"), ("s2x", "s1x"), ("s1", "s2x")], "src string, dst string")
    got = dm.reducibility(e, dm.dominators(e, "w")).first()
    assert got["irreducible_nodes"] == 2 and not got["is_reducible"] and got["back_edges"] == 0
    assert sizes[0] == e.count() and sizes[1] < 40
