"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.tables import write_table

#: Sources up to this many are weighed on the driver; beyond, each step of the search is an aggregation.
DRIVER_SOURCES = 100_000
#: Rows of the plan (one a source and block) up to which it is sent to every executor; a larger one is joined by shuffle.
BROADCAST_PLAN = 200_000
OWN_COLUMNS = ("mix_source", "mix_tokens", "mix_epoch", "mix_block", "mix_pos")


def n_words(text: Column) -> Column:
    """Words between ASCII white space."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bisect(f: Callable[[float], float], target: float, lo: float = 0.0, hi: float = 1.0, steps: int = 50) -> float:
    """The greatest x in [lo, hi], to within the steps, with ``f(x) <= target`` for a rising ``f``; ``lo`` if there is none."""
    if f(hi) <= target:
        return hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) <= target else (lo, mid)
    return lo


def temperature(sizes: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> tuple[float, float, float]:
    """Exponent, the sum of ``tokens ** exponent`` and the token budget over sources ``tokens``.

    With ``target_entropy``, the exponent is the greatest up to 1 whose weights have at least
    as many nats; with ``max_repeats``, the least at which no source is used more often, at
    ``budget`` or else the least budget that uses all of each; with both, the greater of the two; with
    neither, 1. A budget that no exponent up to 1 fits within the repetition limit raises ValueError.
    """
    few = sizes.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES
    tokens = [float(r[0]) for r in sizes.select("tokens").collect()] if few else None

    def sums(e: float) -> tuple[float, float]:
        """Sum of t**e and of t**e * ln t."""
        if tokens is not None:
            return math.fsum(t**e for t in tokens), math.fsum(t**e * math.log(t) for t in tokens)
        p = F.pow(F.col("tokens").cast("double"), F.lit(e))
        return tuple(sizes.agg(F.sum(p), F.sum(p * F.log("tokens"))).first())

    low, high = ((min(tokens), max(tokens)) if tokens is not None else sizes.agg(F.min("tokens"), F.max("tokens")).first())

    def entropy(e: float) -> float:
        s, l = sums(e)
        return math.log(s) - e * l / s

    def whole(e: float) -> float:
        """The least budget that uses all of the greatest source, and so of each."""
        return float(high ** (1 - e) * sums(e)[0])

    def repeats(e: float) -> float:
        """How often the smallest source, which is used most, is used."""
        return (budget or whole(e)) * low ** (e - 1) / sums(e)[0]

    e = 1.0 if target_entropy is None else bisect(lambda x: -entropy(x), -target_entropy)
    if max_repeats is not None:
        if repeats(1.0) > max_repeats * (1 + 1e-9):
            raise ValueError(f"a budget of {budget or whole(1.0):.0f} words uses every source {repeats(1.0):.3g} times at least; max_repeats is {max_repeats}")
        # repeats fall as the exponent rises: turned round, the greatest step down from 1 within the limit
        need = 1 - bisect(lambda x: repeats(1 - x), max_repeats * (1 + 1e-9))
        e = need if target_entropy is None else max(e, need)
    return e, sums(e)[0], whole(e)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float | None = None,
    max_repeats: float | None = 1.5,
    budget: float | None = None,
    blocks: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """The columns of ``docs`` with ``mix_source, mix_tokens, mix_epoch, mix_block, mix_pos``: one row for each use of a document.

    A source's weight is its share of words to the exponent of
    :func:`temperature`, normalised; null sources are the source "". Its part of ``budget``
    words (by default the least that uses every document) is filled by
    whole passes and a last partial one. In a pass, the source's ``blocks`` hash
    blocks are permuted by ``seed`` and pass, and documents within a
    block are in hash order; a document belongs to the partial pass if fewer
    words than the rest of the budget come before it. ``mix_pos`` is the
    share of the source's budget before the document's block, so sorting by it interleaves the sources by weight.

    Columns of ``docs`` keep their names, but those of the five new columns are replaced. With ``budget``, ``max_repeats``
    holds as well: the exponent rises as far as it takes, and a budget beyond it raises ValueError.

    Sources without a word (null or empty texts only) take part once, at
    position 0. Documents without words in others follow their place. Repeated rows and ids are
    separate documents with equal places. Tables without rows give none.

    Block sums are pre-aggregated; only the block in which the partial
    pass ends is ordered by document, one for each source.
    """
    # columns of the input travel under numbers, so that no name of theirs meets one of ours
    own = [c for c in docs.columns if c.lower() not in OWN_COLUMNS]
    source, text, place = (F.col(f"`{c}`") for c in (source_col, text_col, id_col))
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(own)),
        F.coalesce(source.cast("string"), F.lit("")).alias("mix_source"),
        n_words(text).alias("mix_tokens"),
        F.xxhash64(place, F.lit(seed)).alias("__place"),
    ).withColumn("__block", F.pmod("__place", F.lit(blocks)).cast("int"))
    grid = write_table(rows.groupBy("mix_source", "__block").agg(F.sum("mix_tokens").alias("tokens")), "mix-blocks")
    sizes = grid.groupBy("mix_source").agg(F.sum("tokens").alias("tokens"))
    if sizes.where("tokens > 0").isEmpty():
        exponent, total, whole = 1.0, 1.0, 1.0
    else:
        exponent, total, whole = temperature(sizes.where("tokens > 0"), target_entropy, max_repeats, budget)
    want = F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(total) * F.lit(float(budget) if budget else whole)
    plan = sizes.select(
        "mix_source",
        F.when(F.col("tokens") > 0, want).otherwise(0.0).alias("__budget"),
        F.col("tokens").alias("__all"),
    ).select(
        "*",
        # a hair more than a whole number of passes is a whole number
        F.when(F.col("__all") > 0, F.floor(F.col("__budget") / F.col("__all") + F.lit(1e-9))).otherwise(1).cast("int").alias("__passes"),
    ).withColumn("__rest", F.greatest(F.col("__budget") - F.col("__passes") * F.col("__all") - F.lit(1e-6) * F.col("__all"), F.lit(0.0)))
    passes = grid.join(plan, "mix_source").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("__passes"))).alias("mix_epoch")
    ).withColumn("__turn", F.xxhash64("__block", "mix_epoch", F.lit(seed)))
    order = Window.partitionBy("mix_source", "mix_epoch").orderBy("__turn", "__block")
    placed = (
        passes.withColumn("__before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("mix_block", F.row_number().over(order) - 1)
        .withColumn("__before", F.coalesce("__before", F.lit(0)))
        .where("mix_epoch < __passes OR __before < __rest")
    )
    placed = write_table(
        placed.select(
            "mix_source",
            "__block",
            "mix_epoch",
            "mix_block",
            F.when(F.col("__budget") > 0, (F.col("mix_epoch") * F.col("__all") + F.col("__before")) / F.col("__budget")).otherwise(0.0).alias("mix_pos"),
            F.when((F.col("mix_epoch") == F.col("__passes")) & (F.col("__before") + F.col("tokens") > F.col("__rest")), F.col("__rest") - F.col("__before")).alias("__left"),
        ),
        "mix-plan",
    )
    keys = ["mix_source", "__block"]
    uses = placed.groupBy(*keys).agg(
        F.collect_list(F.struct("mix_epoch", "mix_block", "mix_pos", "__left")).alias("__uses")
    )
    small = placed.limit(BROADCAST_PLAN + 1).count() <= BROADCAST_PLAN
    sent = F.broadcast if small else lambda df: df
    joined = rows.join(sent(uses), keys)
    last = rows.join(sent(placed.where("__left IS NOT NULL").select(*keys, "__left")), keys)
    inside = Window.partitionBy(*keys).orderBy("__place").rangeBetween(Window.unboundedPreceding, -1)
    cut = (
        last.select(*keys, "__place", "mix_tokens", "__left")
        .withColumn("__b", F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0)))
        .where("__b < __left")
        .groupBy(*keys)
        .agg(F.max("__place").alias("__to"))
    )
    out = joined.join(sent(cut), keys, "left").select("*", F.explode("__uses").alias("__use")).where("__use.__left IS NULL OR __place <= __to")
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), "mix_source", "mix_tokens", "__use.mix_epoch", "__use.mix_block", "__use.mix_pos")
