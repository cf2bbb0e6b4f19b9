"""Bursts of change notes: quiet spans, repeated and late notes, a restart from the checkpoint."""

from __future__ import annotations

import time

from graphloom.streaming import bursts

SCHEMA = "seq long, file_path string, op string"


def _told(spark, sink, ready, seconds=120):
    """The bursts told so far, once ``ready`` says that they are all there."""
    end = time.time() + seconds
    while True:
        try:
            got = [(r["file_path"], r["op"], r["seq"], r["notes"]) for r in spark.read.schema(bursts.BURST).parquet(f"{sink}/batch=*").collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            got = []
        if ready(got) or time.time() > end:
            return sorted(got)
        time.sleep(0.5)


def test_bursts_across_batches_and_a_restart(spark, tmp_path):
    notes, sink = f"file://{tmp_path}/notes", f"file://{tmp_path}/told"
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(notes)
    put([(1, "a.go", "create"), (2, "a.go", "write"), (2, "a.go", "write"), (3, "b.tmp", "write"), (4, None, "write"), (None, "c.go", "write"), (5, "n.go", None)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    time.sleep(1.1)  # files come in order of their times
    put([(6, "a.go", "remove"), (1, "a.go", "create")])  # the next batch, within the quiet span: the same burst, and a repeated note
    start = lambda: bursts.settle(bursts.bursts(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(notes), 12, ignore=r"\.tmp$"), sink, "200 milliseconds")
    q = start()
    # no further note is needed to close a burst
    assert _told(spark, sink, lambda got: len(got) >= 2) == [("a.go", "remove", 6, 3), ("n.go", None, 5, 1)]
    put([(6, "a.go", "remove"), (2, "a.go", "write")])  # notes told before open nothing
    put([(7, "d.go", "create"), (5000, "d.go", "write")])
    while sum(p["numInputRows"] for p in q.recentProgress) < 13:
        time.sleep(0.2)
    q.stop()  # with an open burst, which is told after the next start
    q = start()
    put([(4999, "d.go", "late"), (8, "a.go", "write")])
    got = _told(spark, sink, lambda got: any(g[:3] == ("a.go", "write", 8) for g in got) and sum(g[3] for g in got if g[0] == "d.go") == 3)
    q.stop()
    assert q.exception() is None and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert [g for g in got if g[0] == "a.go"] == [("a.go", "remove", 6, 3), ("a.go", "write", 8, 1)]
    assert sum(g[3] for g in got if g[0] == "d.go") == 3 and ("d.go", "write", 5000) in {g[:3] for g in got}


def test_a_burst_that_goes_on_is_told(spark, tmp_path):
    notes, sink = f"file://{tmp_path}/notes", f"file://{tmp_path}/told"
    spark.createDataFrame([(0, "a.go", "create")], SCHEMA).coalesce(1).write.parquet(notes)
    q = bursts.settle(bursts.bursts(spark.readStream.schema(SCHEMA).parquet(notes), 600, longest=3), sink, "200 milliseconds")
    for k in range(1, 5):
        spark.createDataFrame([(k, "a.go", "write")], SCHEMA).coalesce(1).write.mode("append").parquet(notes)
        time.sleep(0.3)
    got = _told(spark, sink, lambda got: sum(g[3] for g in got) == 5)
    q.stop()
    assert sum(g[3] for g in got) == 5 and got[-1][2] == 4
