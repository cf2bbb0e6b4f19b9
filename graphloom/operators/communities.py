"""Communities of greatest modularity, on several levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.plans.tables import drop_table, write_table
from graphloom.sources.graphs import CodeGraph

#: Gains of modularity below this are rounding.
LEAST_GAIN = 1e-12
#: Rounds of a level end when at most one of so many nodes still moves or waits.
LAST_NODES = 50


def _told(df: DataFrame, name: str, rows: int, **what) -> tuple[DataFrame, dict]:
    """:func:`write_table`, and aggregates of the rows written, without another job."""
    seen = Observation()
    out = write_table(df.observe(seen, *(c.alias(n) for n, c in what.items())), name, rows)
    return out, seen.get


def _local_moves(nodes: DataFrame, links: DataFrame, m: int, n: int, resolution: float, max_rounds: int) -> DataFrame:
    """``id, community`` after rounds of moves of the nodes of one level.

    In a round each node beside a move (at first every node) looks for the neighbouring community of the greatest gain, the
    least on ties, and moves if that community's hash is less than its own's. Hashes change by round, so two neighbours
    never swap, and a node that has to wait soon may move.
    """
    state = write_table(nodes.select("id", "k", F.col("id").alias("community"), F.lit(False).alias("moved"), F.lit(True).alias("waits")), "community", n)
    for r in range(max_rounds):
        totals = state.groupBy("community").agg(F.sum("k").alias("total"))
        labels = state.select("id", "community")
        own = state.select(F.col("id").alias("a"), "k", F.col("community").alias("now"))
        near = links
        if r:
            beside = links.join(state.where("moved").select(F.col("id").alias("b")), "b", "left_semi").select("a")
            near = links.join(beside.unionByName(state.where("waits").select(F.col("id").alias("a"))).distinct(), "a", "left_semi")
        toward = near.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.sum("w").alias("e"))
        here = toward.select("a", F.col("community").alias("now"), F.col("e").alias("e_now"))
        gain = (F.col("e") - F.coalesce("e_now", F.lit(0))) / m - resolution * F.col("k") * (F.col("total") - (F.col("t_now") - F.col("k"))) / (2.0 * m * m)
        options = (
            toward.join(own, "a").where("community <> now").join(here, ["a", "now"], "left")
            .join(totals, "community").join(totals.select(F.col("community").alias("now"), F.col("total").alias("t_now")), "now")
            .withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
        )
        best = options.groupBy(F.col("a").alias("id")).agg(F.min_by("community", F.struct(-F.round("gain", 15), F.col("community"))).alias("to"))
        goes = F.col("to").isNotNull() & (F.xxhash64("to", F.lit(r)) < F.xxhash64("community", F.lit(r)))
        new = state.select("id", "k", "community").join(best, "id", "left").select("id", "k", F.when(goes, F.col("to")).otherwise(F.col("community")).alias("community"), goes.alias("moved"), (F.col("to").isNotNull() & ~goes).alias("waits"))
        new, seen = _told(new, "community", n, open=F.count_if(F.col("moved") | F.col("waits")))
        drop_table(state)
        state = new
        if seen["open"] <= n // LAST_NODES:
            break
    return state


def communities(g: CodeGraph, resolution: float = 1.0, max_rounds: int = 24, max_levels: int = 30, least_rise: float = 1e-6) -> DataFrame:
    """``id, community``: nodes grouped for a great modularity; each community is connected and named by its least node.

    On each level nodes move to neighbouring communities (at most ``max_rounds`` rounds, and until few still would); communities are then refined into their
    connected parts, and each part is contracted to one node of the next level, whose
    links carry the weight of those they stand for. Levels end when nothing is contracted or
    modularity rises by less than ``least_rise``, and a level that lowers it (moves of one round are made side by side)
    is undone, so the result is never below that of the first level.
    Every round is one job over the nodes beside a move; the tables of later levels are smaller.
    """
    pair = g.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = write_table(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("w")), "community-links")
    ends = g.edges.select(F.col("src").alias("id"), (F.col("src") == F.col("dst")).cast("long").alias("loop")).unionByName(g.edges.select(F.col("dst").alias("id"), (F.col("src") == F.col("dst")).cast("long").alias("loop")))
    ends = ends.groupBy("id").agg(F.count("*").alias("k"), F.sum("loop").alias("inner"))
    shares = {"n": F.count("*"), "k": F.coalesce(F.sum("k"), F.lit(0)), "inner": F.coalesce(F.sum("inner"), F.lit(0)), "squares": F.coalesce(F.sum(F.col("k").cast("double") * F.col("k")), F.lit(0.0))}
    base = g.nodes.select("id").distinct().join(ends, "id", "left").na.fill(0, ["k", "inner"])
    nodes, seen = _told(base, "community-nodes", 1 << 40, **shares)
    m = seen["k"] // 2
    found = nodes.select("id", F.col("id").alias("community"))
    if not m:
        return found
    value = lambda s: s["inner"] / (2.0 * m) - resolution * s["squares"] / (4.0 * m * m)
    n, q = seen["n"], value(seen)
    for level in range(max_levels):
        moved = _local_moves(nodes, links, m, n, resolution, max_rounds)
        label = moved.select("id", "community")
        both = links.join(label.withColumnsRenamed({"id": "a", "community": "x"}), "a").join(label.withColumnsRenamed({"id": "b", "community": "y"}), "b")
        parts = connected_components(both.where("x = y AND a < b"), "a", "b")
        part = write_table(nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part")), "community-parts", n)
        ends = links.join(part.withColumnsRenamed({"id": "a", "part": "x"}), "a").join(part.withColumnsRenamed({"id": "b", "part": "y"}), "b")
        fewer, across = _told(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "community-links", n, links=F.count_if(F.col("a") != F.col("b")))
        held = fewer.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("more"))
        merged = nodes.join(part, "id").groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
        merged = merged.join(held, "id", "left").select("id", "k", (F.col("inner") + F.coalesce("more", F.lit(0))).alias("inner"))
        merged, seen = _told(merged, "community-nodes", n, **shares)
        rise, shrunk = value(seen) - q, n - seen["n"]
        for t in (links, moved, *([nodes] if level else [])):  # the first nodes are those of the result
            drop_table(t)
        if not shrunk or rise < 0:
            break
        found = found.join(part.withColumnsRenamed({"id": "community", "part": "next"}), "community").select("id", F.col("next").alias("community"))
        links, nodes, n, q = fewer.where("a <> b"), merged, seen["n"], value(seen)
        links._table_path = fewer._table_path
        if rise < least_rise or not across["links"]:
            break
    named = found.groupBy("community").agg(F.min("id").alias("least"))
    return found.join(named, "community").select("id", F.col("least").alias("community"))
