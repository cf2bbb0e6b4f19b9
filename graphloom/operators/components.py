"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import drop_table, write_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over distinct edges ``(u, v)`` with ``u > v``."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for each endpoint of an edge; ``component`` is the least id it reaches.

    The direction of edges, self-loops, parallel edges and edges with a null
    end don't matter; a node whose only edges are self-loops is its own
    component. Each round writes a table of at most one row per distinct edge,
    so a lost executor costs one round. Hubs are handled by partial aggregation
    and by skew joins.
    """
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    table = write_table(
        ends.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "components",
    )
    before = None
    rows = table.count()
    for _ in range(max_rounds):
        new = write_table(_stars(_stars(table, True), False), "components", rows)
        drop_table(table)
        table = new
        mark = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, rows = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    stars = table.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = table.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    known = stars.unionByName(roots)
    loops = ends.where(F.col(src) == F.col(dst)).select(F.col(src).alias("id")).distinct()
    return known.unionByName(loops.join(known, "id", "left_anti").select("id", F.col("id").alias("component")))
