"""Aggregates over ranges of positions, from a table of power-of-two nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import shuffled

#: Levels of nodes: positions run from 0 to 2 ** LEVELS - 1.
LEVELS = 40


def levels_of(values: DataFrame, pos: str = "pos") -> int:
    """The levels that the positions of ``values`` need."""
    top = values.agg(F.max(pos)).collect()[0][0]
    return 0 if top is None else int(top).bit_length()


def dyadic_nodes(values: DataFrame, levels: int, *groups: str) -> DataFrame:
    """``groups, level, node, n, sum, min, max`` of ``values`` (``groups, pos, value``; positions from 0 on, several rows of one are fine).

    Node ``k`` of a level covers the positions from ``k * 2 ** level`` to ``(k + 1) * 2 ** level - 1``.
    Each value has one row a level, most of which are folded before the shuffle; nodes without values have no row.
    """
    wide = values.select(*groups, "pos", "value", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    node = F.expr("shiftright(cast(pos AS bigint), level)")
    return wide.groupBy(*groups, "level", node.alias("node")).agg(F.count("value").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))


def covering(lo: Column, hi: Column, levels: int) -> Column:
    """The nodes, structs ``level, node``, that make up a closed range: at most two a level."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left, right = F.floor((lo + size - 1) / size), F.floor((hi + 1) / size)
        some = left < right
        here = lambda on, node: F.when(some & on, F.struct(k.alias("level"), node.cast("long").alias("node")))
        return F.array(here(left % 2 == 1, left), here(right % 2 == 1, right - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def _parts(ranges: DataFrame, levels: int, groups: tuple[str, ...]) -> DataFrame:
    last = (1 << levels) - 1
    lo, hi = F.greatest(F.col("lo").cast("long"), F.lit(0)), F.least(F.col("hi").cast("long"), F.lit(last))
    return ranges.select(*groups, "lo", "hi").distinct().select("*", F.explode_outer(F.when(lo <= hi, covering(lo, hi, levels))).alias("part")).select(
        *groups, "lo", "hi", F.col("part.level").alias("level"), F.col("part.node").alias("node")
    )


def range_aggregate(nodes: DataFrame, ranges: DataFrame, levels: int, *groups: str) -> DataFrame:
    """``groups, lo, hi, n, sum, min, max`` of closed ``ranges`` (``groups, lo, hi``) over ``nodes`` of :func:`dyadic_nodes`.

    A range joins at most two nodes a level, however long it is. Ranges without values have n = 0 and nulls; ranges
    that reach beyond the positions are cut; equal ranges have one row.
    """
    joined = _parts(ranges, levels, groups).join(shuffled(nodes), [*groups, "level", "node"], "left")
    return joined.groupBy(*groups, "lo", "hi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def lazy_updates(updates: DataFrame, levels: int) -> DataFrame:
    """``level, node, delta``: additions to closed ranges (``lo, hi, delta``) as pending rows on nodes, summed; no position is touched."""
    last = (1 << levels) - 1
    lo, hi = F.greatest(F.col("lo").cast("long"), F.lit(0)), F.least(F.col("hi").cast("long"), F.lit(last))
    parts = updates.where(lo <= hi).select("delta", F.explode(covering(lo, hi, levels)).alias("part"))
    return parts.groupBy(F.col("part.level").alias("level"), F.col("part.node").alias("node")).agg(F.sum("delta").alias("delta"))


def _above(rows: DataFrame, levels: int, first: int) -> DataFrame:
    """``rows`` (``level, node``) once for each ancestor, ``up_level, up_node``, from ``first`` levels above on."""
    up = F.explode(F.when(F.col("level") + first <= levels, F.sequence(F.col("level") + first, F.lit(levels))))
    return rows.select("*", up.alias("up_level")).withColumn("up_node", F.expr("shiftright(node, up_level - level)"))


def updated_values(values: DataFrame, lazy: DataFrame, levels: int) -> DataFrame:
    """``pos, value`` with what is pending on the nodes above each position."""
    own = values.select("pos", "value", F.lit(0).alias("level"), F.col("pos").cast("long").alias("node"))
    more = _above(own, levels, 0).join(shuffled(lazy.withColumnsRenamed({"level": "up_level", "node": "up_node"})), ["up_level", "up_node"]).groupBy("pos").agg(F.sum("delta").alias("delta"))
    return values.select("pos", "value").join(shuffled(more), "pos", "left").select("pos", (F.col("value") + F.coalesce("delta", F.lit(0))).alias("value"))


def updated_sums(nodes: DataFrame, lazy: DataFrame, ranges: DataFrame, levels: int) -> DataFrame:
    """``lo, hi, n, sum`` after the pending updates, without touching values: what is pending above a range's nodes counts for all their positions, what is pending below for its own."""
    parts = _parts(ranges, levels, ()).where("node IS NOT NULL")
    counts = nodes.select("level", "node", "n")
    inside = _above(lazy.join(shuffled(counts), ["level", "node"]), levels, 1).groupBy(F.col("up_level").alias("level"), F.col("up_node").alias("node")).agg(F.sum(F.col("delta") * F.col("n")).alias("below"))
    held = parts.select("level", "node").distinct()
    above = (
        _above(held, levels, 0).join(shuffled(lazy.withColumnsRenamed({"level": "up_level", "node": "up_node"})), ["up_level", "up_node"])
        .groupBy("level", "node").agg(F.sum("delta").alias("above"))
    )
    each = held.join(shuffled(nodes.select("level", "node", "n", "sum")), ["level", "node"]).join(shuffled(above), ["level", "node"], "left").join(shuffled(inside), ["level", "node"], "left")
    zero = F.lit(0)
    each = each.select("level", "node", "n", (F.col("sum") + F.coalesce("above", zero) * F.col("n") + F.coalesce("below", zero)).alias("sum"))
    totals = parts.join(shuffled(each), ["level", "node"]).groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    return ranges.select("lo", "hi").distinct().join(shuffled(totals), ["lo", "hi"], "left").select("lo", "hi", F.coalesce("n", zero).alias("n"), "sum")
