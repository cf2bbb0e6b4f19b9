"""Heavy chains of trees, and aggregates along paths from a few segments of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.dyadic import dyadic_nodes, levels_of, range_aggregate
from graphloom.operators.tours import euler_tour
from graphloom.plans.tables import GrowingTable, drop_table, write_table


def heavy_chains(tree: DataFrame) -> DataFrame:
    """``id, parent, size, head, pos, above`` of ``tree`` (``id, parent``; one row a node, roots have a null parent): the chain that a node lies on, named by its top node, its place there from 0 on, and the parent of the top node.

    A chain goes on to the child of the largest subtree, the least id of ties. Sizes come from an Euler tour, and heads by pointer
    doubling along chains: no root paths, whatever the depth.
    """
    kids = tree.where("parent IS NOT NULL").select("id", F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    kids = write_table(kids, "chain-edges")
    tour = euler_tour(kids.select("a", "b"), kids)
    sizes = tour.where("parent IS NOT NULL").select("id", ((F.col("tout") - F.col("tin") + 1) / 2).cast("long").alias("size"))
    own = write_table(tree.select("id", "parent").join(sizes, "id", "left"), "chain-sizes")
    heavy = own.where("parent IS NOT NULL").groupBy("parent").agg(F.min_by("id", F.struct(-F.col("size"), F.col("id"))).alias("id")).select("id", F.lit(True).alias("heavy"))
    total = F.coalesce("below", F.lit(0)) + 1
    below = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
    base = own.join(heavy, "id", "left").join(below, "id", "left").select("id", "parent", F.coalesce("size", total).alias("size"), F.coalesce("heavy", F.lit(False)).alias("heavy"))
    base = write_table(base, "chain-nodes")
    # a head points at itself
    state = write_table(base.select("id", F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("id")).alias("up"), F.col("heavy").cast("long").alias("pos"), (~F.col("heavy")).alias("done")), "chain-heads")
    while not state.where("NOT done").isEmpty():
        there = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("pos").alias("more"), F.col("done").alias("end"))
        moved = state.where("NOT done").join(there, "up").select("id", F.col("next").alias("up"), (F.col("pos") + F.col("more")).alias("pos"), F.col("end").alias("done"))
        new = write_table(state.where("done").unionByName(moved), "chain-heads")
        drop_table(state)
        state = new
    placed = base.join(state.select("id", F.col("up").alias("head"), "pos"), "id")
    tops = base.where("NOT heavy").select(F.col("id").alias("head"), F.col("parent").alias("above"))
    return placed.join(tops, "head").select("id", "parent", "size", "head", "pos", "above")


def path_segments(chains: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, head, lo, hi``: the path between the ends of each of ``pairs`` (``u, v``) as stretches of places on chains of :func:`heavy_chains`.

    A path has at most about twice the binary logarithm of the number of nodes of them. In each round every end that hasn't reached its
    root goes on to the chain above. Pairs in different trees, and with unknown nodes, have no rows.
    """
    chains = write_table(chains, "chains")
    asked = pairs.select("u", "v").distinct()
    at = chains.select(F.col("id").alias("at"), "head", "pos", "above")
    first = asked.select("u", "v", F.lit("u").alias("side"), F.col("u").alias("at")).unionByName(asked.select("u", "v", F.lit("v").alias("side"), F.col("v").alias("at")))
    table = GrowingTable(first.join(at, "at").select("u", "v", "side", "head", "pos", "above", F.lit(0).alias("step")), "segments")
    frontier, step = table.read(), 0
    while True:
        frontier = frontier.where("above IS NOT NULL")
        if frontier.isEmpty():
            break
        step += 1
        frontier = table.add(frontier.select("u", "v", "side", F.col("above").alias("at")).join(at, "at").select("u", "v", "side", "head", "pos", "above", F.lit(step).alias("step")))
    every = table.read()
    ways = every.groupBy("u", "v", "head").agg(
        F.min(F.when(F.col("side") == "u", F.col("step"))).alias("su"), F.min(F.when(F.col("side") == "v", F.col("step"))).alias("sv"),
        F.min(F.when(F.col("side") == "u", F.col("pos"))).alias("pu"), F.min(F.when(F.col("side") == "v", F.col("pos"))).alias("pv"),
    )
    # the first chain that both sides meet holds the common ancestor; those after it are above
    meet = ways.where("su IS NOT NULL AND sv IS NOT NULL").groupBy("u", "v").agg(F.min("su").alias("mu"), F.min("sv").alias("mv"))
    return ways.join(meet, ["u", "v"]).where("(su IS NOT NULL AND su <= mu AND (sv IS NULL OR su = mu)) OR (su IS NULL AND sv < mv)").select(
        "u", "v", "head", F.when(F.col("pu").isNotNull() & F.col("pv").isNotNull(), F.least("pu", "pv")).otherwise(0).cast("long").alias("lo"), F.greatest("pu", "pv").alias("hi")
    )


def segment_aggregate(chains: DataFrame, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, nodes, sum, min, max, segments`` of ``values`` (``id, value``) along each path, both ends and the common ancestor once; ``segments`` is what it cost: stretches of chains, each from a few dyadic nodes, not the path's nodes one by one."""
    chains = write_table(chains, "chains")
    segments = write_table(path_segments(chains, pairs), "path-segments")
    own = chains.join(values, "id").select("head", "pos", "value")
    levels = levels_of(chains)
    parts = range_aggregate(dyadic_nodes(own, levels, "head"), segments.select("head", "lo", "hi"), levels, "head")
    held: list[Column] = [F.sum(F.col("hi") - F.col("lo") + 1).alias("nodes"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.count("*").alias("segments")]
    return segments.join(parts, ["head", "lo", "hi"]).groupBy("u", "v").agg(*held)
