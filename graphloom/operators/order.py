"""Neighbours in a total order over the whole cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import write_table


def with_next(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``next``, a struct of the columns ``by`` of the row after it in their rising order; null for the last.

    Rows are dealt out by ranges and written; a window looks ahead within each range, and the first rows of
    the ranges (one each) say what follows their ends. So no key, however many rows it has, gathers in one task.
    Values of ``by`` must not be null, and their combinations distinct.
    """
    own = F.struct(*by)
    dealt = write_table(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ordered")
    names = ", ".join(f"`{c}`" for c in by)
    ahead = F.expr(f"lead(struct({names})) OVER (PARTITION BY __range ORDER BY {names})")
    firsts = dealt.groupBy("__range").agg(F.min(own).alias("__first"))
    after = firsts.selectExpr("__range", "lead(__first) OVER (ORDER BY __range) AS __after")
    return dealt.withColumn("next", ahead).join(F.broadcast(after), "__range").withColumn("next", F.coalesce("next", "__after")).drop("__range", "__after")
