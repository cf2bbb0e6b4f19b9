"""Changelogs: append, ordered replay, latest state, graph refresh, and event-time streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.tables import new_path
from graphloom.sources.graphs import CodeGraph


def append(deltas: DataFrame, path: str) -> None:
    """Append deltas (``seq, key, op, value``) to a journal."""
    deltas.write.mode("append").parquet(path)


def replay(journal: DataFrame, upto: int | None = None) -> DataFrame:
    """Deltas in order of ``seq``, up to and with ``upto``."""
    return (journal if upto is None else journal.where(F.col("seq") <= upto)).orderBy("seq")


def state(journal: DataFrame, upto: int | None = None) -> DataFrame:
    """``key, seq, value``: the latest delta of each key, deleted keys left out: one aggregation."""
    own = journal if upto is None else journal.where(F.col("seq") <= upto)
    last = own.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("last"))
    return last.where("last.op <> 'delete'").select("key", "last.seq", "last.value")


def follow(spark: SparkSession, path: str, schema: str, sink: str) -> StreamingQuery:
    """The journal as a stream into a Parquet folder ``sink``: a feed of deltas that goes on where it stopped."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.format("parquet").option("checkpointLocation", f"{sink}/_state").outputMode("append").trigger(availableNow=True).start(sink)


def watch(spark: SparkSession, path: str, schema: str, act: Callable[[DataFrame], None], ignore: str | None = None, every: str = "100 milliseconds", batch_files: int = 1000, once: bool = False) -> StreamingQuery:
    """Give ``act`` the :func:`dirty_files` of each batch of change notes (``seq, file_path, op``) that arrives below ``path``.

    Batches are what came in ``every`` span, at most ``batch_files`` notes files, so bursts are taken together. With
    ``once``, what is there now is worked off and the stream ends.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(path)

    def run(batch: DataFrame, _: int) -> None:
        found = dirty_files(batch, ignore)
        if not found.isEmpty():
            act(found)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", new_path(spark, "watch")).trigger(**({"availableNow": True} if once else {"processingTime": every})).start()


def dirty_files(changes: DataFrame, ignore: str | None = None) -> DataFrame:
    """``file_path, op``: the last change of each file in a batch (``seq, file_path, op``), without paths that ``ignore`` matches."""
    own = changes if ignore is None else changes.where(~F.col("file_path").rlike(ignore))
    return own.groupBy("file_path").agg(F.max_by("op", "seq").alias("op"))


def refresh(g: CodeGraph, changed: DataFrame, fresh: CodeGraph, full_ratio: float = 0.3) -> tuple[CodeGraph, str]:
    """The graph after a batch of ``changed`` files (``file_path, op``) whose new content is ``fresh``; and "incremental" or "full".

    Beyond ``full_ratio`` changed files of all the caller should rebuild. Edges from other files into a changed file
    stay if their target's id is still a node.
    """
    total = g.nodes.select("file_path").distinct().count()
    n = changed.count()
    gone = changed.select("file_path")
    kept_nodes = g.nodes.join(gone, "file_path", "left_anti")
    own = g.nodes.join(gone, "file_path", "left_semi").select(F.col("id").alias("src"))
    nodes = kept_nodes.unionByName(fresh.nodes)
    edges = g.edges.join(own, "src", "left_anti").unionByName(fresh.edges)
    edges = edges.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return CodeGraph(nodes, edges), "full" if total and n / total > full_ratio else "incremental"


def snapshot_diff(old: CodeGraph, new: CodeGraph) -> DataFrame:
    """``what, change, key``: nodes added, removed and modified (signature, then place, then edges), and edges added and removed as sets of ends and type."""
    sig = lambda g, p: g.nodes.select("id", F.xxhash64("name", "kind", "package", "exported").alias(f"{p}s"), F.xxhash64("file_path", "start_line", "end_line").alias(f"{p}l"))
    out = lambda g, p: g.edges.select("src", "dst", "etype").distinct().groupBy(F.col("src").alias("id")).agg(F.sum(F.xxhash64("dst", "etype").cast("decimal(38,0)")).alias(f"{p}e"))
    n = sig(old, "a").join(out(old, "a"), "id", "left").join(sig(new, "b").join(out(new, "b"), "id", "left"), "id", "full")
    change = (
        F.when(F.col("al").isNull(), "added").when(F.col("bl").isNull(), "removed").when(F.col("as") != F.col("bs"), "signature").when(F.col("al") != F.col("bl"), "moved").when(~F.col("ae").eqNullSafe(F.col("be")), "edges")
    )
    nodes = n.select(F.lit("node").alias("what"), change.alias("change"), F.col("id").alias("key")).where("change IS NOT NULL")
    e = lambda g: g.edges.select("src", "dst", "etype").distinct()
    edge = lambda a, b, name: e(a).exceptAll(e(b)).select(F.lit("edge").alias("what"), F.lit(name).alias("change"), F.concat_ws(">", "src", "dst", "etype").alias("key"))
    return nodes.unionByName(edge(new, old, "added")).unionByName(edge(old, new, "removed"))


def stale_files(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """``file_path, status`` of files (``file_path, hash``): added, modified or deleted since the manifest."""
    j = manifest.withColumnRenamed("hash", "old").join(now.withColumnRenamed("hash", "new"), "file_path", "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return j.select("file_path", status.alias("status")).where("status IS NOT NULL")


def net_edges(deltas: DataFrame) -> DataFrame:
    """``src, dst, n``: edges that are left of a stream of ``src, dst, sign``."""
    return deltas.groupBy("src", "dst").agg(F.sum("sign").alias("n")).where("n > 0")


def turnstile(updates: DataFrame) -> DataFrame:
    """``key, total`` of keys whose updates (``key, delta``) don't cancel out."""
    return updates.groupBy("key").agg(F.sum("delta").alias("total")).where("total <> 0")


def sample_nonzero(updates: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` keys of :func:`turnstile`, each as likely: those of the least seeded hashes."""
    return turnstile(updates).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums over event-time windows, for batches and streams alike."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder: rows are added, or with ``mode="complete"`` those of the last batch count.

    Each batch has a folder of its own, by its number, that a repeated batch overwrites: after a failure no row is there twice,
    and readers of an earlier batch keep their files.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)
    last = f"{path}/none"

    def save(batch: DataFrame, number: int) -> None:
        nonlocal last
        last = f"{path}/{number:012d}"
        batch.write.mode("overwrite").parquet(last)

    q = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    if last.endswith("none"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(last if mode == "complete" else path)


def step_cycles(steps: DataFrame, session: str, order: list[str], step: Column) -> DataFrame:
    """``session, step, returns``: steps that a session comes back to, after others."""
    w = Window.partitionBy(session).orderBy(*order)
    s = steps.select(session, step.alias("step"), *order).withColumn("before", F.lag("step").over(w))
    starts = s.where("before IS NULL OR before <> step")
    return starts.groupBy(session, "step").agg((F.count("*") - 1).alias("returns")).where("returns > 0")

