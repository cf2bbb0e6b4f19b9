"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import split_likely
from graphloom.plans.tables import write_table

WINDOW = 3
#: Repeated rows are made anew in chunks of this many, dealt to all tasks.
CHUNK = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counting(lines: Column) -> Column:
    """The lines that count, without white space at their ends, and their places."""
    stripped = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "").alias("s"), i.alias("at")))
    return F.filter(stripped, lambda x: x["s"] != "")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, text`` with later occurrences of repeated line windows removed.

    Lines are split at ``\\n``; lines of white space only don't count. A window is
    ``window`` consecutive counting lines, without white space at their ends; a document of fewer
    counting lines has one window of them all. The first occurrence of a
    window, by doc_id and then position, stays. All lines that later
    occurrences cover are removed, with those that don't count between the lines of one such window;
    the others are joined by ``\\n``, in order. Null texts are empty; rows without an id and
    empty texts have no windows. Rows of one id with different texts are documents of their own, in the order of a hash of
    their texts. Repeated rows (of one id and text) are too: the first of them stays as others do, the rest lose all windows.

    Only hashes move: 128 bits a window and its place. Counts and first places
    are pre-aggregated; windows seen once drop out before the places join
    them, and a join on a hot window can be split. Texts are shuffled once, repeated rows folded before that; only texts of repeated rows, if there are any, are read again.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(3), t, F.lit(5)).alias("h2"), t.alias("text"))
    row = ["doc_id", "h1", "h2"]
    n = F.size("kept")
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))),
        lambda i: F.struct(
            F.xxhash64(F.transform(F.slice("kept", i + 1, window), lambda x: x["s"])).alias("a"),
            F.xxhash64(F.lit(1), F.reverse(F.transform(F.slice("kept", i + 1, window), lambda x: x["s"]))).alias("b"),
            F.element_at("kept", i + 1)["at"].alias("first"),
            F.element_at("kept", F.least(i + window, n))["at"].alias("last"),
        ),
    )
    places = (
        d.where("doc_id IS NOT NULL")
        .select(*row, _counting(_lines(F.col("text"))).alias("kept"))
        .where("size(kept) > 0")
        .select(*row, F.explode(grams).alias("w"))
        .select(*row, "w.a", "w.b", "w.first", "w.last")
    )
    firsts = (
        places.groupBy("a", "b")
        .agg(F.min(F.struct(*row, "first")).alias("keep"), F.count("*").alias("n"))
        .where("n > 1")
    )
    later = places.join(firsts, ["a", "b"]).where(F.struct(*row, "first") != F.col("keep"))
    covered = later.groupBy(*row).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    once = d.groupBy(*row).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    joined = once.join(covered, row, "left").withColumn("lines", _lines(F.col("text"))).withColumn("spans", F.array_sort("spans"))
    # spans in order of their starts are in order of their ends: what stays lies between neighbours
    total, m = F.size("lines"), F.size("spans")
    left = F.flatten(
        F.transform(
            F.sequence(F.lit(0), m),
            lambda i: F.slice(
                "lines",
                F.coalesce(F.get("spans", i - 1)["last"], F.lit(-1)) + 2,
                F.greatest(F.coalesce(F.get("spans", i)["first"], total) - F.coalesce(F.get("spans", i - 1)["last"], F.lit(-1)) - 1, F.lit(0)),
            ),
        )
    )
    held = F.col("spans").isNotNull()
    first = joined.select(
        "doc_id",
        total.cast("long").alias("n_lines"),
        F.when(held, total - F.size(left)).otherwise(0).cast("long").alias("n_removed"),
        F.when(held, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text"),
    )
    # the other copies: every window of theirs is a later occurrence
    again = d.groupBy(*row).agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("doc_id").alias("id"), F.col("h1").alias("x"), F.col("h2").alias("y"))
    again = write_table(again, "line-repeats")
    if again.isEmpty():
        return first
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))
    likely, _ = split_likely(d, again.select("x"), "h1")
    texts = likely.join(again, same, "left_semi").groupBy(*row).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    bare = texts.withColumn("lines", _lines(F.col("text"))).withColumn("kept", _counting(F.col("lines")))
    bare = bare.withColumn("lo", F.when(F.col("doc_id").isNotNull(), F.get("kept", F.lit(0))["at"])).withColumn("hi", F.get("kept", F.size("kept") - 1)["at"])
    rest = F.array_join(F.concat(F.expr("slice(lines, 1, lo)"), F.expr("slice(lines, hi + 2, size(lines))")), "\n")
    bare = bare.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("lo").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))).alias("at"),
        (F.col("copies") - 1).alias("end"),
    )
    chunk = F.sequence(F.col("at"), F.least(F.col("at") + CHUNK - 1, F.col("end")))
    more = bare.repartition(F.xxhash64("doc_id", "at")).withColumn("copy", F.explode(chunk)).drop("at", "end", "copy")
    return first.unionByName(more)
