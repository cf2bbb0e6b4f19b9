"""Articulation points, bridges and biconnected blocks, over the whole cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.dyadic import dyadic_nodes, levels_of, range_aggregate
from graphloom.operators.tours import euler_tour, spanning_forest
from graphloom.plans.tables import drop_table, write_table


def _blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct pairs, the tour of a spanning forest with low, high and block of each node but roots, and the pairs outside the forest.

    After Tarjan and Vishkin: ``low`` and ``high`` are the least and greatest ``tin`` that edges outside the forest
    reach from below a node. Two forest edges (each named by its lower node) lie in one block if an edge joins
    their lower nodes, neither of which is above the other, or if one is above the other and an edge leads from below out of the upper node's subtree.
    """
    ends = edges.where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL")
    pairs = write_table(ends.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "cut-edges")
    forest = spanning_forest(pairs)
    tour = write_table(euler_tour(pairs, forest), "cut-tour")
    place = tour.select("id", "root", "tin", "tout")
    extra = pairs.join(forest.select("a", "b"), ["a", "b"], "left_anti")
    for c in ("a", "b"):
        extra = extra.join(place.select(F.col("id").alias(c), F.col("tin").alias(f"{c}_in"), F.col("tout").alias(f"{c}_out")), c)
    extra = write_table(extra, "cut-extra")
    reach = extra.select(F.col("a").alias("id"), F.col("b_in").alias("t")).unionByName(extra.select(F.col("b").alias("id"), F.col("a_in").alias("t")))
    reach = reach.groupBy("id").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    below = tour.where("parent IS NOT NULL")
    own = below.join(reach, "id", "left")
    # both extremes of a node are values at its place
    values = own.select("root", F.col("tin").alias("pos"), F.explode(F.array(F.col("tin"), F.coalesce("least", "tin"), F.coalesce("most", "tin"))).alias("value"))
    levels = levels_of(below, "tin")
    spans = range_aggregate(dyadic_nodes(values, levels, "root"), below.select("root", F.col("tin").alias("lo"), F.least("tout", F.lit((1 << levels) - 1)).alias("hi")), levels, "root")
    low = write_table(below.join(spans.select("root", F.col("lo").alias("tin"), F.col("min").alias("low"), F.col("max").alias("high")), ["root", "tin"]), "cut-low")
    across = extra.where("a_in >= 0 AND b_in >= 0 AND (a_out < b_in OR b_out < a_in)").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    upper = low.select(F.col("id").alias("parent"), F.col("tin").alias("up_in"), F.col("tout").alias("up_out"))
    along = low.join(upper, "parent").where("low < up_in OR high > up_out").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    part = connected_components(across.unionByName(along)).withColumnRenamed("component", "block")
    out = write_table(low.join(part, "id", "left").withColumn("block", F.coalesce("block", "id")), "cut-blocks")
    for t in (low, tour):
        drop_table(t)
    return pairs, out, extra


def articulation(edges: DataFrame) -> DataFrame:
    """``kind, a, b``: "point" rows with a cut node, "bridge" rows with the ends of a cut edge in order.

    The graph is read undirected, without self-loops and with parallel edges as one. Rounds are joins and aggregates, about
    as many as the graph's size has binary digits, however deep or large a component is.
    """
    _, nodes, _ = _blocks(edges)
    touched = nodes.select("id", "block").unionByName(nodes.select(F.col("parent").alias("id"), "block"))
    points = touched.groupBy("id").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select(F.lit("point").alias("kind"), F.col("id").alias("a"), F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("b"))
    bridges = nodes.where("low >= tin AND high <= tout").select(F.lit("bridge").alias("kind"), F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    return points.unionByName(bridges)


def biconnected(edges: DataFrame) -> DataFrame:
    """``a, b, block``: each pair of adjacent nodes, ends in order, with its biconnected block, named by one of its nodes; blocks share cut nodes, but no edge."""
    _, nodes, extra = _blocks(edges)
    own = nodes.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"), "block")
    lower = F.when(F.col("a_in") > F.col("b_in"), F.col("a")).otherwise(F.col("b"))
    return own.unionByName(extra.select("a", "b", lower.alias("id")).join(nodes.select("id", "block"), "id").select("a", "b", "block"))
