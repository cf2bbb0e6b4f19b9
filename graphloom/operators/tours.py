"""Spanning forests and Euler tours of undirected graphs, in rounds of the logarithm of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.order import with_next
from graphloom.plans.tables import GrowingTable, drop_table, write_table


def _roots_of(picks: DataFrame, rows: int) -> DataFrame:
    """``id, up``: each node of ``picks`` (``id, up``) with the end of its way up, by doubling."""
    state = write_table(picks.select("id", "up", F.lit(True).alias("moved")), "forest-up", rows)
    while True:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        new = write_table(state.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "forest-up", rows)
        drop_table(state)
        state = new
        if new.where("moved").isEmpty():
            return state


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """``id, a, b``: the edges ``a, b`` of ``pairs`` (distinct, no loops) that span its components, each with the node ``id`` it was found for; the one node of a component that is no ``id`` is its root.

    In each round every group of nodes joins the neighbouring group of the least hash, if that is less than its own.
    Hashes change by round, so that at least half of the groups are expected to join, ways up are short, and
    parallel edges between groups are folded.
    """
    live = write_table(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b"), "forest-edges")
    found, r, rows = None, 0, live.count()
    while rows:
        mark = lambda c, r=r: F.xxhash64(F.col(c), F.lit(r))
        both = live.select("u", "v", "a", "b").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b"))
        best = both.groupBy("u").agg(F.min(F.struct(mark("v").alias("h"), F.col("v"), F.col("a"), F.col("b"))).alias("m"))
        picks = best.where(F.struct("m.h", "m.v") < F.struct(mark("u").alias("h"), F.col("u").alias("v"))).select(F.col("u").alias("id"), F.col("m.v").alias("up"), F.col("m.a").alias("a"), F.col("m.b").alias("b"))
        picks = picks.coalesce(1 + rows // 20_000) if rows < 160_000 else picks
        if found is None:
            found = GrowingTable(picks, "forest")
            new = found.read()
        else:
            new = found.add(picks)
        up = _roots_of(new, rows)
        ends = live
        for c in ("u", "v"):
            ends = ends.join(up.select(F.col("id").alias(c), F.col("up").alias(f"{c}2")), c, "left").withColumn(c, F.coalesce(f"{c}2", c)).drop(f"{c}2")
        fewer = ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "a", "b").groupBy("u", "v").agg(F.min(F.struct("a", "b")).alias("e"))
        fewer = write_table(fewer.select("u", "v", "e.a", "e.b"), "forest-edges", rows)
        for t in (live, up):
            drop_table(t)
        live, r, rows = fewer, r + 1, fewer.count()
    drop_table(live)
    return found.read().select("id", "a", "b") if found else pairs.select(F.col("a").alias("id"), "a", "b")


def euler_tour(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """``root, id, parent, tin, tout`` of every node of ``forest`` (:func:`spanning_forest` of ``pairs``): nodes below ``v`` are those whose ``tin`` lies between its ``tin`` and ``tout``.

    The two arcs of each edge are linked into one list a tree (an arc into a node is followed by the next one out of it in
    the circle of its neighbours); places in the list come from pointer doubling. A root has tin -1,
    tout beyond all others and no parent.
    """
    arcs = forest.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(forest.select(F.col("b").alias("v"), F.col("a").alias("u")))
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    roots = ends.join(forest.select("id"), "id", "left_anti")
    first = arcs.groupBy("v").agg(F.min("u").alias("first")).join(roots.select(F.col("id").alias("v"), F.lit(True).alias("root")), "v", "left")
    ring = with_next(arcs, "v", "u").join(first, "v")
    same = F.coalesce(F.col("next.v") == F.col("v"), F.lit(False))
    last = ~same & F.coalesce("root", F.lit(False))
    # the arc u -> v, the arc after it, and the arcs from here to there; the last of a list is followed by itself
    state = ring.select(
        "u", "v", F.when(last, F.col("u")).otherwise(F.col("v")).alias("nu"), F.when(last, F.col("v")).when(same, F.col("next.u")).otherwise(F.col("first")).alias("nv"),
        F.when(last, 0).otherwise(1).cast("long").alias("d"), last.alias("done"),
    )
    state = write_table(state, "tour")
    rows = state.count()
    while not state.where("NOT done").isEmpty():
        there = state.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("d").alias("e"), F.col("done").alias("end"))
        # a place is the next of one arc at most: no key is hot
        moved = state.where("NOT done").join(there, ["nu", "nv"]).select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), (F.col("d") + F.col("e")).alias("d"), F.col("end").alias("done"))
        new = write_table(state.where("done").unionByName(moved), "tour", rows)
        drop_table(state)
        state = new
    back = state.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("d").alias("e"))
    kids = state.join(back, ["u", "v"]).where("d > e").select(F.col("nv").alias("root"), F.col("v").alias("id"), F.col("u").alias("parent"), F.col("e").alias("tin"), F.col("d").alias("tout"))
    tops = roots.select(F.col("id").alias("root"), "id", F.lit(None).cast(dict(roots.dtypes)["id"]).alias("parent"), F.lit(-1).cast("long").alias("tin"), F.lit((1 << 62)).cast("long").alias("tout"))
    return kids.unionByName(tops)
