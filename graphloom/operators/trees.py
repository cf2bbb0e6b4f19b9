"""Trees: root paths, lowest common ancestors, and path and subtree aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import drop_table, write_table

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def root_paths(tree: DataFrame, max_doublings: int = 40) -> DataFrame:
    """``id, path``: the nodes from its root to each node of ``tree`` (``id, parent``; roots have a null parent).

    Pointer doubling: as many joins as the depth has binary digits. Nodes whose parents lead to no
    root (a missing parent, a cycle) have no row.
    """
    state = write_table(tree.select("id", F.array("id").alias("path"), F.col("parent").alias("up")), "paths")
    for _ in range(max_doublings):
        if state.where("up IS NOT NULL").isEmpty():
            out = state.select("id", "path")
            out._table_path = state._table_path
            return out
        above = state.select(F.col("id").alias("up"), F.col("path").alias("above"), F.col("up").alias("next"))
        joined = state.where("up IS NOT NULL").join(above, "up").select("id", F.concat("above", "path").alias("path"), F.col("next").alias("up"))
        longer = write_table(state.where("up IS NULL").unionByName(joined), "paths")
        drop_table(state)
        state = longer
    raise ValueError("the tree has a cycle")


def is_tree(tree: DataFrame) -> bool:
    """Whether ``tree`` has one root, one row a node and no cycle or missing parent."""
    n, ids, roots = tree.agg(F.count("*"), F.countDistinct("id"), F.count_if(F.col("parent").isNull())).first()
    if not n or n != ids or roots != 1:
        return False
    try:
        return root_paths(tree).count() == n
    except ValueError:
        return False


def closure(paths: DataFrame) -> DataFrame:
    """``id, ancestor, dist``: each node with itself and all its ancestors."""
    return paths.select("id", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor")).select("id", "ancestor", (F.col("n") - 1 - F.col("at")).alias("dist"))


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def lca(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, lca, distance, error`` for ``pairs`` (``u, v``); nodes of different trees and unknown nodes have an error and nulls."""
    joined = (
        pairs.join(paths.select(F.col("id").alias("u"), F.col("path").alias("pu")), "u", "left").join(paths.select(F.col("id").alias("v"), F.col("path").alias("pv")), "v", "left")
        .withColumn("n", _shared(F.col("pu"), F.col("pv")))
    )
    error = F.when(F.col("pu").isNull() | F.col("pv").isNull(), "unknown node").when(F.col("n") == 0, "different trees")
    ok = error.isNull()
    return joined.select(
        "u", "v", F.when(ok, F.get("pu", F.col("n") - 1)).alias("lca"), F.when(ok, F.size("pu") + F.size("pv") - 2 * F.col("n")).cast("long").alias("distance"), error.alias("error")
    )


def path_nodes(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, at, id``: the nodes between the ends of ``pairs``, both included, in order from ``u``; each once."""
    joined = (
        pairs.join(paths.select(F.col("id").alias("u"), F.col("path").alias("pu")), "u").join(paths.select(F.col("id").alias("v"), F.col("path").alias("pv")), "v")
        .withColumn("n", _shared(F.col("pu"), F.col("pv"))).where("n > 0")
    )
    way = F.concat(F.reverse(F.expr("slice(pu, n, size(pu))")), F.expr("slice(pv, n + 1, size(pv))"))
    return joined.select("u", "v", F.posexplode(way).alias("at", "id"))


def gcd(x: Column) -> Column:
    """Greatest common divisor of the values of an aggregated column: 0 for none."""
    step = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.lit(96)),
        F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))),
        lambda s: s["a"],
    )
    return F.aggregate(F.collect_set(x), F.lit(0).cast("long"), step)


def monoids(x: Column) -> dict[str, Column]:
    """SUM held within 64 bits, MIN, MAX and GCD; without values 0, the greatest, the least and 0."""
    total = F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    held = F.least(F.greatest(total, F.lit(LONG_MIN).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)"))
    return {
        "sum": held.cast("long").alias("sum"),
        "min": F.coalesce(F.min(x), F.lit(LONG_MAX)).alias("min"),
        "max": F.coalesce(F.max(x), F.lit(LONG_MIN)).alias("max"),
        "gcd": gcd(x).alias("gcd"),
    }


def path_aggregate(paths: DataFrame, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, sum, min, max, gcd`` of ``values`` (``id, value``) along each path, both ends and the common ancestor counted once."""
    return path_nodes(paths, pairs).join(values, "id").groupBy("u", "v").agg(*monoids(F.col("value")).values())


def subtree_aggregate(paths: DataFrame, values: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``id, nodes, sum, min, max, gcd`` over the subtree of each node (of ``roots``, if given), itself included."""
    up = closure(paths)
    if roots is not None:
        up = up.join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return up.join(values, "id").groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("nodes"), *monoids(F.col("value")).values())


def euler_tour(paths: DataFrame) -> DataFrame:
    """``id, parent, depth, size, tin, tout, heavy, head``: preorder numbers with children in id order, and heavy chains.

    ``tin`` of a node is that of its parent, plus one, plus the sizes of the siblings before it: sums along the root path. ``heavy`` is the child of the largest subtree (the least id of ties) and ``head`` the top of the node's heavy chain.
    """
    from pyspark.sql import Window

    sizes = closure(paths).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("size"))
    base = paths.join(sizes, "id").select("id", "path", F.get("path", F.size("path") - 2).alias("parent"), (F.size("path") - 1).alias("depth"), "size")
    kids = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("before", F.coalesce(F.sum("size").over(kids), F.lit(0)))
    heavy = base.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.min_by("id", F.struct(-F.col("size"), F.col("id"))).alias("heavy"))
    base = write_table(base.join(heavy, "id", "left"), "tour")
    steps = base.select(F.col("id").alias("ancestor"), F.when(F.col("parent").isNotNull(), F.col("before") + 1).otherwise(F.col("before")).alias("step"))
    tin = closure(paths).join(steps, "ancestor").groupBy("id").agg(F.sum("step").alias("tin"))
    light = base.join(base.select(F.col("id").alias("parent"), F.col("heavy").alias("first")), "parent", "left").select(
        F.col("id").alias("ancestor"), (F.col("first").isNull() | (F.col("first") != F.col("id"))).alias("light")
    )
    head = closure(paths).join(light, "ancestor").where("light").groupBy("id").agg(F.min_by("ancestor", "dist").alias("head"))
    return base.join(tin, "id").join(head, "id").select("id", "parent", "depth", "size", "tin", (F.col("tin") + F.col("size") - 1).alias("tout"), "heavy", "head")


def range_aggregate_binned(values: DataFrame, ranges: DataFrame, bin_size: int) -> DataFrame:
    """``lo, hi, sum, min, max, gcd`` of ``values`` (``pos, value``) over closed ``ranges`` (``lo, hi``): an equi-join on bins of positions; each value has one bin, each range those it meets."""
    bins = F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))
    wide = ranges.select("lo", "hi", F.explode(bins).alias("bin"))
    own = values.withColumn("bin", F.floor(F.col("pos") / bin_size))
    hits = wide.join(own, "bin").where("pos BETWEEN lo AND hi").select("lo", "hi", "value")
    return ranges.distinct().join(hits, ["lo", "hi"], "left").groupBy("lo", "hi").agg(*monoids(F.col("value")).values())


def range_update(values: DataFrame, updates: DataFrame) -> DataFrame:
    """``pos, value`` after adding the ``delta`` of each of ``updates`` (``lo, hi, delta``) to its closed range: a difference array summed by a window over blocks of positions."""
    from pyspark.sql import Window

    steps = updates.select(F.col("lo").alias("pos"), F.col("delta").alias("d")).unionByName(updates.select((F.col("hi") + 1).alias("pos"), (-F.col("delta")).alias("d")))
    steps = steps.groupBy("pos").agg(F.sum("d").alias("d"))
    both = values.select("pos", "value").join(steps, "pos", "full")
    block = F.floor(F.col("pos") / 4096)
    sums = both.groupBy(block.alias("block")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    # carries in two levels: within groups of blocks, and over the groups, of which there is one for 16 million positions
    sums = sums.withColumn("group", F.floor(F.col("block") / 4096))
    before = lambda *by: F.coalesce(F.sum("d").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("group").agg(F.sum("d").alias("d"))
    over = groups.select("group", F.coalesce(F.sum("d").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("over"))
    carried = sums.withColumn("within", before("group")).join(over, "group").select("block", (F.col("within") + F.col("over")).alias("carry"))
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("block", block).join(carried, "block")
        .select("pos", (F.col("value") + F.coalesce(F.sum("d").over(w), F.lit(0)) + F.col("carry")).alias("value"))
        .where("value IS NOT NULL")
    )


def update_values(values: DataFrame, changes: DataFrame, how: str = "add") -> DataFrame:
    """``values`` (``id, value``) after ``changes`` (``id, change``), added up or, with ``how="set"``, put in place."""
    new = changes.groupBy("id").agg((F.sum if how == "add" else F.max)("change").alias("change"))
    joined = values.join(new, "id", "left")
    if how == "add":
        return joined.select("id", (F.col("value") + F.coalesce("change", F.lit(0))).alias("value"))
    return joined.select("id", F.coalesce("change", "value").alias("value"))
