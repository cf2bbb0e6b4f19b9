"""Linear sketches: samples of what is left of inserts and deletes, and components of a graph whose edges come and go.

A sketch is a table of cells. Cells hold sums, so that sketches of parts, added up with
:func:`merged`, are the sketch of the whole, and a delete takes away what its insert brought.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.plans.tables import write_table

#: Fingerprints of keys are below this.
PRINTS = 1 << 31
#: Levels of a sketch: a key lies on level k or above with a chance of 2 ** -k.
LEVELS = 48


def _level(*key: Column) -> Column:
    """A key's level by its hash: k with a chance of 2 ** -(k + 1)."""
    low = F.xxhash64(*key).bitwiseAND(F.lit((1 << LEVELS) - 1))
    return F.when(low == 0, LEVELS).otherwise(F.bit_count(low.bitwiseXOR(low - 1)) - 1)


def _print(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit("print")), F.lit(PRINTS))


def merged(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """The sketch of what two sketches stand for together, or with sign -1 of the first without the second. Cells of zeros have no row."""
    sums = [c for c in a.columns if c.startswith("sum_")]
    keys = [c for c in a.columns if c not in sums]
    both = a.select(*keys, *sums).unionByName(b.select(*keys, *((sign * F.col(c)).alias(c) for c in sums)))
    return _cells(both, keys, sums)


def _cells(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    added = rows.groupBy(*keys).agg(*(F.sum(c).cast(dict(rows.dtypes)[c]).alias(c) for c in sums))
    return added.where(" OR ".join(f"{c} <> 0" for c in sums))


def l0_sketch(updates: DataFrame, samplers: int = 16, seed: int = 1) -> DataFrame:
    """``sampler, level, sum_n, sum_key, sum_print`` of ``updates`` (``key`` bigint, ``delta``): in each sampler a key adds to the cell of its level, at most LEVELS + 1 cells a sampler whatever the number of keys."""
    wide = updates.select("key", F.col("delta").cast("long").alias("delta"), F.explode(F.sequence(F.lit(0), F.lit(samplers - 1))).alias("sampler"))
    rows = wide.select(
        "sampler", _level(F.col("key"), F.col("sampler"), F.lit(seed)).alias("level"), F.col("delta").alias("sum_n"),
        (F.col("key").cast("decimal(38,0)") * F.col("delta")).cast("decimal(38,0)").alias("sum_key"), (_print(F.col("key")) * F.col("delta")).alias("sum_print"),
    )
    return _cells(rows, ["sampler", "level"], ["sum_n", "sum_key", "sum_print"])


def l0_samples(sketch: DataFrame) -> DataFrame:
    """``sampler, key, total``: a key whose updates don't cancel out, and their sum, for each sampler of a sketch that found one.

    Each such key is as likely: a sampler takes the highest cell that isn't empty. It gives a key if that
    cell holds one alone (a chance of about .72), which the fingerprint confirms but for one in 2 ** 31; else it
    has no row, as have all samplers if nothing is left.
    """
    top = sketch.groupBy("sampler").agg(F.max_by(F.struct("sum_n", "sum_key", "sum_print"), "level").alias("c"))
    key = F.when(F.col("c.sum_n") != 0, F.expr("c.sum_key div c.sum_n")).cast("long")
    sound = (key * F.col("c.sum_n") == F.col("c.sum_key")) & (_print(key) * F.col("c.sum_n") == F.col("c.sum_print"))
    return top.where(F.coalesce(sound, F.lit(False))).select("sampler", key.alias("key"), F.col("c.sum_n").alias("total"))


def agm_sketch(updates: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """``node, round, level, sum_n, sum_a, sum_b, sum_print`` of edge ``updates`` (``src, dst`` bigint from 0 to 2 ** 31 - 1, ``delta``: 1 for an insert, -1 for a delete), read undirected, without self-loops.

    A node's vector has an entry for each of its edges, positive at the lesser end and negative
    at the greater: in a sum over a set of nodes, edges inside cancel out. Each round has cells of its own hash:
    at most LEVELS + 1 cells a node and round, and no more than edges at the node. ``rounds``: about twice the
    binary logarithm of the number of nodes.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    own = updates.where("src <> dst").select(a.alias("a"), b.alias("b"), F.col("delta").cast("long").alias("delta"))
    folded = own.groupBy("a", "b").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    wide = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    wide = wide.withColumn("level", _level(F.col("a"), F.col("b"), F.col("round"), F.lit(seed)))
    ends = wide.select("a", "b", "round", "level", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("delta").alias("n")), F.struct(F.col("b").alias("node"), (-F.col("delta")).alias("n")))).alias("e"))
    rows = ends.select(
        F.col("e.node").alias("node"), "round", "level", F.col("e.n").alias("sum_n"), (F.col("e.n") * F.col("a")).alias("sum_a"), (F.col("e.n") * F.col("b")).alias("sum_b"), (F.col("e.n") * _print(F.col("a"), F.col("b"))).alias("sum_print")
    )
    return _cells(rows, ["node", "round", "level"], ["sum_n", "sum_a", "sum_b", "sum_print"])


def _recovered(cells: DataFrame) -> DataFrame:
    """``a, b``: for each ``part`` of summed ``cells`` an edge that leaves it, if the cells down to some level hold one alone."""
    down = Window.partitionBy("part").orderBy(F.desc("level"))
    sums = [F.sum(c).over(down).alias(c) for c in ("sum_n", "sum_a", "sum_b", "sum_print")]
    held = cells.select("part", "level", *sums).where("sum_n <> 0")
    a, b = F.expr("sum_a div sum_n"), F.expr("sum_b div sum_n")
    sound = (a * F.col("sum_n") == F.col("sum_a")) & (b * F.col("sum_n") == F.col("sum_b")) & (_print(a, b) * F.col("sum_n") == F.col("sum_print")) & (a < b)
    return held.select("part", "level", F.when(sound, F.struct(a.alias("a"), b.alias("b"))).alias("e")).where("e IS NOT NULL").groupBy("part").agg(F.max_by("e", "level").alias("e")).select("e.a", "e.b")


def agm_components(nodes: DataFrame, sketch: DataFrame) -> tuple[DataFrame, bool]:
    """``id, component`` (the least id) of ``nodes`` (``id``) by the edges that a sketch stands for, and whether it is sure to be whole.

    Boruvka's rounds on the sketch alone: cells are summed by component, an edge that leaves it is
    recovered from one of its own round's sums, and components are joined. A component's cells fail to give an edge
    with a chance of about a quarter in a round, so the number of components that are not whole falls by a constant share in each. At the end
    all sums are zero if and, but for a chance of one in 2 ** 31 a component, only if no edge is left that leaves one; if some aren't zero after the last round the answer is False.
    """
    rounds = (sketch.agg(F.max("round")).first()[0] or 0) + 1
    sketch = write_table(sketch, "agm")
    label = write_table(nodes.select("id", F.col("id").alias("component")).distinct(), "agm-parts")
    sums = ("sum_n", "sum_a", "sum_b", "sum_print")

    def summed(r: int) -> DataFrame:
        own = sketch.where(F.col("round") == r).join(label.select(F.col("id").alias("node"), F.col("component").alias("part")), "node")
        return own.groupBy("part", "level").agg(*(F.sum(c).alias(c) for c in sums)).where(" OR ".join(f"{c} <> 0" for c in sums))

    for r in range(rounds):
        left = write_table(summed(r), "agm-sums")
        if left.isEmpty():
            return label, True
        found = _recovered(left)
        ends = found.join(label.withColumnsRenamed({"id": "a", "component": "src"}), "a").join(label.withColumnsRenamed({"id": "b", "component": "dst"}), "b").select("src", "dst")
        joined = connected_components(ends).select(F.col("component").alias("least"), F.col("id").alias("component"))
        label = write_table(label.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "agm-parts")
    return label, summed(rounds - 1).isEmpty()
