"""Dominators by contraction: deep graphs beyond one task take few rounds, with the same rows."""

from __future__ import annotations

import pytest

from graphloom.operators import contraction, sequential
from graphloom.operators import dominators as dm
from tests.test_deep import brute_idoms


@pytest.fixture
def no_walks(monkeypatch):
    """Nothing fits one task, and no level is walked on its own."""

    def walked(*a, **k):
        raise AssertionError("a job a level")

    monkeypatch.setattr(sequential, "MAX_EDGES", 0)
    monkeypatch.setattr(dm, "bfs", walked)


def tree_of(spark, pairs, entry):
    rows = dm.dominator_tree(spark.createDataFrame(pairs, "src string, dst string"), entry).collect()
    found = {r["id"]: r["parent"] or r["id"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_deep_graphs_are_contracted(spark, no_walks):
    n = 150
    chain = [(f"n{i:03d}", f"n{j:03d}") for i in range(n) for j in ([i + 1, i + 2] if i % 7 == 0 else [i + 1]) if j < n]
    back = [("n090", "n040"), ("n141", "n140"), ("n005", "n000")]
    apart = [("x1", "x2"), ("x2", "x1"), ("x2", "x3"), ("z", "x3"), ("z", "y")]
    pairs = chain + back + apart
    assert tree_of(spark, pairs, "n000") == brute_idoms(pairs, "n000")


def test_what_stays_is_walked(spark):
    """An irreducible part stays: both ways into a loop, behind a chain, and a node that only unreached ones enter."""
    pairs = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "l"), ("e", "r"), ("l", "r"), ("r", "l"), ("l", "m"), ("r", "m"), ("m", "t"), ("u", "v"), ("v", "u"), ("u", "m")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = {r["id"]: r["parent"] or r["id"] for r in dm.dominator_tree(e, "a", sequential=False).collect()}
    assert got == brute_idoms(pairs, "a")


def test_edges_left_by_contraction(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    found, core = contraction.contract(e, 0)
    assert core is None and {tuple(r) for r in found.select("id", "parent").collect()} == {(1, 0), (2, 1), (3, 1), (4, 1), (5, 4)}
