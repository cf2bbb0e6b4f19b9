"""Bursts of change notes: keyed state with timers, so that a file's notes are told once, when it has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Numbers of notes that one bitmap holds.
BLOCK = 4096
BURST = "file_path string, op string, seq long, notes long, opened timestamp, closed timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bursts(StatefulProcessor):
    """One file's open burst: its last operation by ``seq``, how many notes it has, when it opened and when it is due.

    Numbers already taken are bits of blocks that are forgotten a while after their last change, so a note that comes
    again changes nothing, and a batch of notes costs one read a block rather than one a note.
    """

    def __init__(self, quiet: int, longest: int, remember: int):
        self.quiet, self.longest, self.remember = quiet, longest, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "op string, seq long, notes long, opened long, due long")
        self.seen = handle.getMapState("seen", "block long", "bits binary", ttlDurationMs=self.remember)

    def _fresh(self, seq: np.ndarray) -> np.ndarray:
        """Which of the numbers weren't taken before, the first of repeated ones; they are taken now."""
        new = np.zeros(len(seq), dtype=bool)
        first = np.zeros(len(seq), dtype=bool)
        first[np.unique(seq, return_index=True)[1]] = True
        for block in np.unique(seq // BLOCK):
            at = np.flatnonzero((seq // BLOCK == block) & first)
            key = (int(block),)
            old = self.seen.getValue(key) if self.seen.containsKey(key) else None
            bits = np.unpackbits(np.frombuffer(bytes(old[0]), dtype=np.uint8)) if old else np.zeros(BLOCK, dtype=np.uint8)
            new[at] = bits[seq[at] % BLOCK] == 0
            bits[seq[at] % BLOCK] = 1
            self.seen.updateValue(key, (np.packbits(bits).tobytes(),))
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        open_ = self.burst.get() if self.burst.exists() else None
        op, last, notes, opened, due = open_ if open_ else (None, None, 0, now, None)
        for pdf in rows:
            pdf = pdf[self._fresh(pdf["seq"].to_numpy(dtype=np.int64))]
            if len(pdf):
                notes += len(pdf)
                top = pdf.loc[pdf["seq"].idxmax()]
                if last is None or top["seq"] > last:
                    op, last = top["op"], int(top["seq"])
        if notes == (open_[2] if open_ else 0):
            return
        if due is not None:
            self.handle.deleteTimer(due)
        due = min(now + self.quiet, opened + self.longest) if self.longest else now + self.quiet
        due = max(due, now + 1)
        self.burst.update((op, last, notes, opened, due))
        self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.burst.exists():
            op, last, notes, opened, due = self.burst.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.burst.clear()
                stamp = lambda ms: pd.Timestamp(ms, unit="ms", tz="UTC")
                yield pd.DataFrame({"file_path": [key[0]], "op": [op], "seq": [last], "notes": [notes], "opened": [stamp(opened)], "closed": [stamp(due)]})

    def close(self) -> None:
        pass


def bursts(notes: DataFrame, quiet: float = 0.1, longest: float | None = None, remember: float = 86_400, ignore: str | None = None) -> DataFrame:
    """``file_path, op, seq, notes, opened, closed``: a row for each burst of a stream of change notes (``seq, file_path, op``), once its file has been quiet for ``quiet`` seconds.

    ``op`` and ``seq`` are those of the burst's last note by ``seq``, ``notes`` counts its different notes. A burst that goes on is told after
    ``longest`` seconds all the same, if given. Times are those of processing, so a burst ends without a further
    note; notes of a batch count before its timers do. A note (``file_path, seq``) that comes again within ``remember`` seconds counts once, in whatever batch. Notes without
    a path or number are left out, and so are paths that ``ignore`` matches; ``op`` may be null. Numbers must not be negative.
    """
    own = notes.select("file_path", F.col("seq").cast("long").alias("seq"), "op").where("file_path IS NOT NULL AND seq >= 0")
    if ignore is not None:
        own = own.where(~F.col("file_path").rlike(ignore))
    ms = lambda s: int(s * 1000)
    return own.groupBy("file_path").transformWithStateInPandas(_Bursts(ms(quiet), ms(longest) if longest else 0, ms(remember)), BURST, "append", "ProcessingTime")


def settle(stream: DataFrame, sink: str, every: str = "100 milliseconds") -> StreamingQuery:
    """Write a stream of :func:`bursts` below ``sink``, a folder a batch, which a batch done again overwrites; its state is in ``sink/_state``, and a new start goes on from there.

    The state is kept by RocksDB, set for this query alone.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    spark.conf.set(name, ROCKS)
    try:
        return stream.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", f"{sink}/_state").trigger(processingTime=every).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
