"""Dominators by contraction: a node all of whose predecessors lie in one cluster joins it, so that deep graphs take few rounds, not as many as they are deep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.trees import _shared, root_paths
from graphloom.plans.tables import GrowingTable, drop_table, shuffled, write_table

#: A round that merges less than one in so many of the clusters is the last.
LEAST_MERGED = 50


def _tops(merged: DataFrame) -> tuple[DataFrame, bool]:
    """``id, top`` of ``merged`` (``id, up``): the end of the way up, by pointer doubling; and whether rows are missing, as their ways end in a cycle."""
    state, n, doublings = merged, None, 0
    while True:
        seen = Observation()
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        new = state.join(shuffled(above), "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("open"))
        new = write_table(new.observe(seen, F.count("*").alias("n"), F.count_if("open").alias("open")), "contract-tops")
        n, left = seen.get["n"], seen.get["open"]
        if doublings:
            drop_table(state)
        doublings += 1
        if not left or 1 << (doublings - 1) > n:
            return new.where("NOT open").select("id", F.col("up").alias("top")), bool(left)
        state = new.select("id", "up")
        state._table_path = new._table_path


def meets(tree: DataFrame, links: DataFrame) -> DataFrame:
    """``id, parent``: the deepest common ancestor in ``tree`` (``id, parent``; null parents for roots) of the sources of each target of ``links`` (``src, dst``).

    Nodes are ranked by their root paths; what is common to all sources is common to the paths of the least and the greatest rank, so a target's sources are folded to two numbers before they are shuffled.
    """
    paths = root_paths(tree)
    used = links.select(F.col("src").alias("id")).distinct()
    ranked = write_table(paths.join(used, "id", "left_semi").orderBy("path").withColumn("rank", F.monotonically_increasing_id()), "contract-ranks")
    drop_table(paths)
    ends = links.join(shuffled(ranked.select(F.col("id").alias("src"), "rank")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    side = lambda c: ranked.select(F.col("rank").alias(c), F.col("path").alias(f"{c}_path"))
    both = ends.join(shuffled(side("lo")), "lo").join(shuffled(side("hi")), "hi")
    return both.select("id", F.get("lo_path", _shared(F.col("lo_path"), F.col("hi_path")) - 1).alias("parent"))


def contract(pairs: DataFrame, entry: int) -> tuple[DataFrame, DataFrame | None]:
    """``id, parent`` of the nodes (longs) whose immediate dominator contraction finds, and what is left.

    Without what is left (None), the rows are the dominator tree below ``entry``. Otherwise the second table has the edges ``src, dst``
    of a graph with the same dominators: found nodes have the edge from their dominator alone.

    Each node starts as a cluster. In a round, every cluster whose edges from outside all come from one other joins that one: the immediate
    dominator of its first node is the deepest common ancestor of their sources there. Chains of such clusters are joined at once, by pointer doubling. Clusters that nothing enters aren't reached and lose their edges.
    """
    spark = pairs.sparkSession
    links = pairs.where(F.col("dst") != entry).select("src", "dst", F.col("src").alias("up"))
    first = spark.createDataFrame([(entry, entry)], "id long, top long")
    tree, steps = None, []
    while True:
        heads = links.groupBy(F.col("dst").alias("id")).agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.min("src").alias("one"), F.max("src").alias("other"))
        heads = write_table(heads, "contract-heads")
        single = F.col("lo") == F.col("hi")
        n = heads.agg(F.count("*").alias("heads"), F.count_if(single).alias("merged"), F.count_if(single & (F.col("one") != F.col("other"))).alias("meets")).first()
        if not n["heads"] or n["merged"] * LEAST_MERGED < n["heads"]:
            break
        merged = heads.where(single)
        tops, cyclic = _tops(merged.select("id", F.col("lo").alias("up")))
        if cyclic:
            merged = merged.join(tops.select("id"), "id", "left_semi")
        rows = merged.where("one = other").select("id", F.col("one").alias("parent"))
        if n["meets"]:
            several = merged.where("one <> other").select(F.col("id").alias("dst"))
            met = write_table(links.join(shuffled(several), "dst", "left_semi"), "contract-met")
            # clusters that no source lies in have no root here, and so no paths
            roots = met.select(F.col("up").alias("id")).distinct().withColumn("parent", F.lit(None).cast("long"))
            rows = rows.unionByName(meets(roots.unionByName(tree.read()), met.select("src", "dst")))
        if tree is None:
            tree = GrowingTable(rows, "contract-tree")
        else:
            tree.add(rows)
        steps.append(tops)
        kept = heads.where(~single).select("id")
        now = kept.withColumn("top", F.col("id")).unionByName(tops).unionByName(first).withColumnRenamed("id", "up")
        left = links.join(shuffled(kept.withColumnRenamed("id", "dst")), "dst", "left_semi").join(shuffled(now), "up").where("top <> dst").select("src", "dst", F.col("top").alias("up"))
        before, links = links, write_table(left, "contract-links")
        drop_table(before)
        drop_table(heads)
    if n["heads"]:
        core = links.select("src", "dst")
        return (tree.read() if tree else None), core if tree is None else core.unionByName(tree.read().select(F.col("parent").alias("src"), F.col("id").alias("dst")))
    reached = first.select("id")
    for tops in reversed(steps):
        reached = write_table(reached.unionByName(tops.join(shuffled(reached.select(F.col("id").alias("top"))), "top", "left_semi").select("id")), "contract-reached")
    nothing = spark.createDataFrame([], "id long, parent long")
    found = tree.read().join(shuffled(reached), "id", "left_semi") if tree else nothing
    return found, None
