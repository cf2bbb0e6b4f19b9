"""Journals in segments, with snapshots of their state: a state is a snapshot and the deltas after it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.streaming.journal import state

#: Sequence numbers that one segment spans.
SEGMENT = 1_000_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    return sorted(n for n in found if n.startswith(prefix))


def append(deltas: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Append deltas (``seq, key, op, value``) to the journal at ``path``, each to the segment of its sequence number."""
    deltas.withColumn("segment", F.floor(F.col("seq") / segment)).write.mode("append").partitionBy("segment").parquet(path)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The sequence numbers, rising, up to which there is a snapshot."""
    return [int(n.removeprefix("at=")) for n in _names(spark, f"{path}/_snapshots", "at=")]


def _tail(spark: SparkSession, path: str, after: int | None, upto: int | None, segment: int) -> DataFrame:
    """Deltas after one sequence number and up to another: segments outside are not opened."""
    rows = spark.read.parquet(path)
    if after is not None:
        rows = rows.where((F.col("segment") >= after // segment) & (F.col("seq") > after))
    if upto is not None:
        rows = rows.where((F.col("segment") <= upto // segment) & (F.col("seq") <= upto))
    return rows.drop("segment")


def state_at(spark: SparkSession, path: str, upto: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """``key, seq, value`` as of ``upto`` (None: now): the latest snapshot that isn't beyond it, and the deltas after that.

    A number before the first snapshot raises ValueError if :func:`compact` has taken its deltas.
    """
    known = snapshots(spark, path)
    base = max((s for s in known if upto is None or s <= upto), default=None)
    if base is None:
        if _names(spark, path, "_compacted"):
            raise ValueError(f"deltas up to {known[0]} were compacted; there is no state at {upto}")
        return state(_tail(spark, path, None, upto, segment))
    if not _names(spark, path, "segment="):
        return spark.read.parquet(f"{path}/_snapshots/at={base:020d}")
    tail = _tail(spark, path, base, upto, segment)
    held = spark.read.parquet(f"{path}/_snapshots/at={base:020d}").withColumn("op", F.lit("put"))
    return state(held.select("seq", "key", "op", "value").unionByName(tail.select("seq", "key", "op", "value")))


def checkpoint(spark: SparkSession, path: str, upto: int | None = None, segment: int = SEGMENT) -> int | None:
    """Write a snapshot of the state as of ``upto`` (None: the last delta) and return that sequence number; None for an empty journal.

    It is written aside and renamed when it is whole, so readers see the one before it or this one. Only the latest snapshot and the deltas after it are read.
    """
    known = snapshots(spark, path)
    if upto is None:
        after = known[-1] if known else None
        upto = _tail(spark, path, after, None, segment).agg(F.max("seq")).first()[0] if _names(spark, path, "segment=") else None
        upto = after if upto is None else upto
    if upto is None or upto in known:
        return upto
    aside = f"{path}/_snapshots/_{uuid.uuid4().hex}"
    state_at(spark, path, upto, segment).write.parquet(aside)
    fs, at = _fs(spark, aside)
    fs.rename(at, _fs(spark, f"{path}/_snapshots/at={upto:020d}")[1])
    return upto


def compact(spark: SparkSession, path: str, segment: int = SEGMENT) -> int:
    """Delete the segments, and the older snapshots, that the latest snapshot covers, and return how many segments went. States before it are no longer to be had."""
    known = snapshots(spark, path)
    if not known:
        return 0
    old = [n for n in _names(spark, path, "segment=") if (int(n.removeprefix("segment=")) + 1) * segment - 1 <= known[-1]]
    fs, mark = _fs(spark, f"{path}/_compacted")
    if old:
        fs.mkdirs(mark)
    for s in known[:-1]:
        fs.delete(_fs(spark, f"{path}/_snapshots/at={s:020d}")[1], True)
    for n in old:
        fs.delete(_fs(spark, f"{path}/{n}")[1], True)
    return len(old)
