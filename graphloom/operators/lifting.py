"""Ancestors at powers of two: levels, dominance tests and ways up a tree without a row, or an array, for each pair of a node and an ancestor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.trees import root_paths
from graphloom.plans.tables import drop_table, new_path, shuffled, write_table

#: Joins that one plan holds before its rows are written.
STEPS = 4
#: Jumps of a tree so shallow, less than 2 ** 6 deep, that root paths are short.
SHALLOW = 6


@dataclass
class Lift:
    """``levels`` (``id, level``, roots at 0), ``jumps[k]`` (``id, up``: the ancestor 2 ** k steps up, where there is one) and ``tree`` (``id, parent``)."""

    levels: DataFrame
    jumps: list[DataFrame]
    tree: DataFrame
    spans: DataFrame | None = None


def lift(tree: DataFrame, max_doublings: int = 40) -> Lift:
    """Jumps over ``tree`` (``id, parent``; a null parent, or one without a row, is above a root). A row a node and digit of the depth; a cycle raises an error."""
    spark, path = tree.sparkSession, new_path(tree.sparkSession, "lift")
    known = tree.select(F.col("id").alias("up"))
    first = tree.select("id", F.col("parent").alias("up")).join(known.withColumn("there", F.lit(1)), "up", "left").select("id", F.when(F.col("there") == 1, F.col("up")).alias("up"), F.coalesce("there", F.lit(0)).cast("long").alias("level"))
    jumps: list[DataFrame] = []
    schema = first.schema
    for k in range(max_doublings):
        first.write.parquet(f"{path}/{k:02d}")
        now = spark.read.schema(schema).parquet(f"{path}/{k:02d}")
        if now.where("up IS NOT NULL").isEmpty():
            return Lift(now.select("id", "level"), jumps, spark.read.schema(schema).parquet(f"{path}/00").select("id", F.col("up").alias("parent")))
        jumps.append(now.where("up IS NOT NULL").select("id", "up"))
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        first = now.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
    raise ValueError("the tree has a cycle")


def shallow(t: Lift) -> bool:
    return len(t.jumps) <= SHALLOW


def spans(t: Lift) -> DataFrame:
    """``id, lo, hi`` of a :func:`shallow` tree: nodes are numbered by their root paths, so that ``lo`` to ``hi`` are the numbers of a node and of what is below it."""
    if t.spans is None:
        paths = root_paths(t.tree)
        ranked = write_table(paths.orderBy("path").withColumn("lo", F.monotonically_increasing_id()), "lift-ranks")
        drop_table(paths)
        last = ranked.select(F.explode("path").alias("id"), "lo").groupBy("id").agg(F.max("lo").alias("hi"))
        t.spans = write_table(ranked.select("id", "lo").join(shuffled(last), "id"), "lift-spans")
    return t.spans


def ancestor_at(t: Lift, rows: DataFrame, node: str, steps: Column, name: str = "at") -> DataFrame:
    """``rows`` and ``name``: the ancestor ``steps`` above their ``node``; null where the tree ends before, or for negative ``steps``. One join a digit of the depth."""
    left = rows.withColumn("_steps", steps.cast("long")).withColumn(name, F.when((F.col("_steps") >= 0) & (F.col("_steps") < 1 << len(t.jumps)), F.col(node)))
    written = None
    for k, jump in enumerate(t.jumps):
        far = jump.select(F.col("id").alias(name), F.col("up").alias("_up"))
        left = left.join(far, name, "left").withColumn(name, F.when(F.shiftright("_steps", k).bitwiseAND(F.lit(1)) == 1, F.col("_up")).otherwise(F.col(name))).drop("_up")
        if k % STEPS == STEPS - 1 and k + 1 < len(t.jumps):
            left, before = write_table(left, "lift-at"), written
            drop_table(before)
            written = left
    return left.select(*rows.columns, name)


def is_ancestor(t: Lift, pairs: DataFrame, above: str, below: str, name: str) -> DataFrame:
    """``pairs`` and ``name``: whether ``above`` is ``below`` or one of its ancestors; false where one of them isn't in the tree."""
    if shallow(t):
        side = lambda c, p: shuffled(spans(t).select(F.col("id").alias(c), F.col("lo").alias(f"_{p}lo"), F.col("hi").alias(f"_{p}hi")))
        met = pairs.join(side(above, "a"), above, "left").join(side(below, "b"), below, "left")
        return met.select(*pairs.columns, F.coalesce(F.col("_blo").between(F.col("_alo"), F.col("_ahi")), F.lit(False)).alias(name))
    n = lambda c, as_: t.levels.select(F.col("id").alias(c), F.col("level").alias(as_))
    leveled = pairs.join(n(above, "_la"), above, "left").join(n(below, "_lb"), below, "left")
    met = ancestor_at(t, leveled, below, F.col("_lb") - F.col("_la"), "_met")
    return met.select(*pairs.columns, F.coalesce(F.col("_met") == F.col(above), F.lit(False)).alias(name))


def ways_up(t: Lift, ways: DataFrame, key: str) -> DataFrame:
    """``key, id``: the nodes from ``id`` up to its ancestor at level ``low``, both included, of ``ways`` (``key, id, low``), each once a key.

    A way is two jumps of a power of two that may overlap, and a jump is two of half its length; what ways of a key share is folded before it is halved. So
    rounds are as many as the depth has digits, and no round has more rows than the result and the ways.
    """
    steps = F.col("level") - F.greatest(F.col("low"), F.lit(0))
    long_ = ways.join(t.levels, "id").select(key, "id", steps.alias("n")).where("n >= 0").withColumn("k", F.floor(F.log2(F.col("n") + 1)).cast("int"))
    ends = write_table(ancestor_at(t, long_, "id", F.col("n") + 1 - F.expr("shiftleft(1L, k)"), "other"), "lift-ways")
    found = write_table(ends.select(key, "id", "k").union(ends.select(key, F.col("other").alias("id"), "k")).distinct(), "lift-ways")
    drop_table(ends)
    top = found.agg(F.max("k")).first()[0] or 0
    for k in range(top, 0, -1):
        here = found.where(F.col("k") == k).select(key, "id")
        half = here.join(t.jumps[k - 1], "id").select(key, F.col("up").alias("id"))
        rest = found.where(F.col("k") < k)
        nxt = write_table(rest.union(here.union(half).withColumn("k", F.lit(k - 1))).distinct(), "lift-ways")
        drop_table(found)
        found = nxt
    return found.select(key, "id")


def subtree_sizes(t: Lift) -> DataFrame:
    """``id, size``: the nodes below each node, itself included. A grouped sum a digit of the depth: what is nearer than 2 ** (k + 1) is what is nearer than 2 ** k, of the node and of those 2 ** k steps below."""
    sizes = write_table(t.levels.select("id", F.lit(1).cast("long").alias("size")), "lift-sizes")
    for jump in t.jumps:
        below = jump.join(sizes, "id").select(F.col("up").alias("id"), "size")
        more = write_table(sizes.union(below).groupBy("id").agg(F.sum("size").alias("size")), "lift-sizes")
        drop_table(sizes)
        sizes = more
    return sizes
