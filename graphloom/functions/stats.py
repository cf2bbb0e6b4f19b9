"""Sketches, trends and comparison statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sketch(df: DataFrame, by: list[str], item: str, precision: int = 14) -> DataFrame:
    """HyperLogLog sketches by group; :func:`merge_sketches` merges them."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, precision).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_estimate(c: Column | str) -> Column:
    return F.hll_sketch_estimate(c)


def count_min(df: DataFrame, item: str, eps: float = 0.002, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """A mergeable Count-Min sketch of a column, as bytes."""
    return df.agg(F.count_min_sketch(F.col(item), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def count_min_estimates(df: DataFrame, item: str, eps: float = 0.002, confidence: float = 0.99) -> DataFrame:
    """``item, estimate``: how often each item occurs, by a Count-Min table: never less than it does, and more by ``eps`` of all rows at most with ``confidence``.

    Cells are (row of the table, hashed column); counting them is one aggregation, so tables of parts add up, and an item's estimate is the least of its cells.
    """
    width, depth = math.ceil(math.e / eps), math.ceil(math.log(1 / (1 - confidence)))
    cells = lambda c: F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(c, r), F.lit(width)).alias("col")))
    counted = df.groupBy(item).agg(F.count("*").alias("n"))
    placed = counted.select(F.col(item).alias("item"), "n", F.explode(cells(F.col(item))).alias("cell"))
    table = placed.groupBy("cell").agg(F.sum("n").alias("total"))
    return placed.join(table, "cell").groupBy("item").agg(F.min("total").alias("estimate"))


def trend(history: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """``symbol_id, points, baseline, current, growth, direction, rapid`` of ``symbol_id, timestamp_ms, direct_callers``.

    The baseline is the last event before ``now_ms`` less ``days``, else the first. Growth in percent, 100 from a baseline of 0 (0 if it stays 0);
    up and down beyond 5, rapid beyond 50. Symbols of fewer than three events are left out.
    """
    cut = now_ms - days * 86_400_000
    h = history.groupBy("symbol_id").agg(
        F.count("*").alias("points"),
        F.coalesce(F.max_by("direct_callers", F.when(F.col("timestamp_ms") < cut, F.col("timestamp_ms"))), F.min_by("direct_callers", "timestamp_ms")).alias("baseline"),
        F.max_by("direct_callers", "timestamp_ms").alias("current"),
    )
    growth = F.when(F.col("baseline") == 0, F.when(F.col("current") == 0, 0.0).otherwise(100.0)).otherwise((F.col("current") - F.col("baseline")) * 100.0 / F.col("baseline"))
    g = F.col("growth")
    return h.where("points >= 3").withColumn("growth", growth).select(
        "symbol_id", "points", "baseline", "current", "growth", F.when(g > 5, "up").when(g < -5, "down").otherwise("stable").alias("direction"), (g > 50).alias("rapid")
    )


def alerts(trends: DataFrame, hot: int = 50) -> DataFrame:
    """``symbol_id, alert`` for rapid growth and for many callers."""
    kinds = F.array_compact(F.array(F.when(F.col("rapid"), "rapid growth"), F.when(F.col("current") >= hot, "many callers")))
    return trends.select("symbol_id", F.explode(kinds).alias("alert"))


QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def latency_stats(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Number, least, greatest, mean, population variance and interpolated percentiles."""
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"),
        *(F.percentile(x, q).alias("p" + f"{q * 100:g}".replace(".", "_")) for q in QUANTILES),
    )


def without_outliers(df: DataFrame, by: str, x: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their group; all of a group of which over half would go."""
    q = df.groupBy(by).agg(F.percentile(x, 0.25).alias("__q1"), F.percentile(x, 0.75).alias("__q3"))
    span = (F.col("__q3") - F.col("__q1")) * 1.5
    marked = df.join(q, by).withColumn("__in", F.col(x).between(F.col("__q1") - span, F.col("__q3") + span))
    share = marked.groupBy(by).agg(F.avg(F.col("__in").cast("int")).alias("__share"))
    return marked.join(share, by).where("__in OR __share < 0.5").drop("__q1", "__q3", "__in", "__share")


def welch(df: DataFrame, group: str, a: str, b: str, x: str) -> DataFrame:
    """``mean_a, mean_b, t, df, cohen_d, effect``: Welch's t, its degrees of freedom, and Cohen's d by the pooled deviation (negligible under .2, small under .5, medium under .8, large)."""
    s = lambda g, f: f(F.when(F.col(group) == g, F.col(x)))
    m = df.agg(*(s(g, f).alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    size = F.abs(F.col("cohen_d"))
    return m.select(
        "mean_a", "mean_b", F.when(va + vb > 0, diff / F.sqrt(va + vb)).otherwise(0.0).alias("t"),
        F.when(va + vb > 0, F.pow(va + vb, F.lit(2)) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))).alias("df"),
        F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("cohen_d"),
    ).withColumn("effect", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


def bootstrap_mean(df: DataFrame, x: str, key: str, rounds: int = 200, level: float = 0.95, seed: int = 11) -> DataFrame:
    """``mean, low, high``: a percentile interval of the mean by Poisson resampling: each row has a weight of its own in each round.

    Weights are drawn from a hash of the row's ``key`` and the round, so they don't depend on partitions. All rounds are sums of one
    aggregation; no row is copied.
    """
    # Poisson(1) weights by inversion of a seeded uniform hash
    cut, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        cut.append(int(total * (1 << 30)))
        term /= k + 1
    own = df.select(F.col(x).cast("double").alias("x"), F.col(key).alias("key"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: F.pmod(F.xxhash64("key", i, F.lit(seed)), F.lit(1 << 30)))
    weights = own.select("x", F.transform(drawn, lambda u: sum(((u > c).cast("int") for c in cut), F.lit(0))).alias("w"))
    each = [F.struct(F.sum(F.col("x") * F.col("w")[i]).alias("s"), F.sum(F.when(F.col("x").isNotNull(), F.col("w")[i])).alias("n")) for i in range(rounds)]
    means = weights.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select((F.col("r.s") / F.col("r.n")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


#: Tolerated relative worsening of each measure.
GATES = {"p50": 0.05, "p95": 0.10, "p99": 0.15, "throughput": 0.05, "memory": 0.10, "errors": 0.01}


def regression_gate(base: DataFrame, new: DataFrame) -> DataFrame:
    """``measure, change, limit, failed`` of two tables ``measure, value``: throughput must not fall, the others not rise, by more than their limit."""
    limit = F.create_map(*(F.lit(x) for kv in GATES.items() for x in kv))
    change = F.when(F.col("old") == 0, F.when(F.col("now") == 0, 0.0).otherwise(1.0)).otherwise((F.col("now") - F.col("old")) / F.col("old"))
    j = base.select("measure", F.col("value").alias("old")).join(new.select("measure", F.col("value").alias("now")), "measure").select("measure", change.alias("change"), limit[F.col("measure")].alias("limit"))
    return j.withColumn("failed", F.when(F.col("measure") == "throughput", -F.col("change") > F.col("limit")).otherwise(F.col("change") > F.col("limit")))
