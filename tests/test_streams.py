"""Streams: late events, batches of changed files, and file classes by phases."""

from __future__ import annotations

import datetime
import time

from graphloom.operators import analytics
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph
from graphloom.streaming import journal


def test_events_behind_the_watermark_are_left_out(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string, value double"
    for k, rows in enumerate(([(at(1, 5), "a", 1.0), (at(5), "a", 1.0)], [(at(5, 1), "a", 1.0)], [(at(1, 30), "a", 1.0), (at(4, 55), "a", 1.0)], [(at(9), "a", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
        time.sleep(1.1)  # files come in order of their times
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = journal.run_to_table(journal.windowed_counts(stream, "1 hour", late="10 minutes"), "late")
    got = {r["start"].hour: r["n"] for r in out.collect()}
    # 1:30 comes two batches after 5:00 was seen: its window is closed; 4:55 is within ten minutes
    assert got == {1: 1, 4: 1, 5: 2}
    batch = journal.windowed_counts(spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in"), "1 hour")
    assert {r["start"].hour: r["n"] for r in batch.collect()} == {1: 2, 4: 1, 5: 2, 9: 1}


def test_changed_files_come_in_batches(spark, tmp_path):
    notes = spark.createDataFrame([(1, "a.go", "create"), (2, "a.go", "write"), (3, "b.tmp", "write"), (4, "c.go", "remove")], "seq long, file_path string, op string")
    notes.coalesce(1).write.parquet(f"file://{tmp_path}/notes")
    seen = []
    journal.watch(spark, f"file://{tmp_path}/notes", "seq long, file_path string, op string", lambda d: seen.extend((r["file_path"], r["op"]) for r in d.collect()), r"\.tmp$", once=True).awaitTermination()
    assert sorted(seen) == [("a.go", "write"), ("c.go", "remove")]


def test_file_classes_by_phase(spark):
    """A share of .10 stays unless half of the symbols are tests; test words decide against; consumers go."""
    f = lambda path, *names: [(f"{path}:{n}", n, "function", "p", path, 1, 1, True, "go") for n in names]
    nodes = f("lib.go", "Run") + f("between.go", "Main", "Help") + f("between2.go", "TestA", "TestB", "Help") + f("eater.go", "Eat") + f("words.go", "AssertX", "MockY", "FakeZ", "Run") + f("few.go", "MockOnly") + f("alone.go", "Alone") + f("x_test.go", "Foo") + [(f"u{i}.go:U", "U", "function", "p", f"u{i}.go", 1, 1, True, "go") for i in range(12)]
    edges = []
    calls = lambda a, b, n=1: edges.extend((a, b, "calls", "", k) for k in range(n))
    for i in range(12):
        calls(f"u{i}.go:U", "lib.go:Run")
        calls("lib.go:Run", f"u{i}.go:U", 1)
    for x in ("between.go:Main", "between2.go:TestA"):
        calls(x, "lib.go:Run", 9)
        calls("u0.go:U", x)
    calls("eater.go:Eat", "lib.go:Run", 5)
    calls("u1.go:U", "words.go:AssertX", 3)
    calls("u1.go:U", "few.go:MockOnly", 3)
    calls("lib.go:Run", "x_test.go:Foo", 3)
    g = CodeGraph(spark.createDataFrame(nodes, ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, ["string"] * 5 + ["int", "int", "boolean", "string"], strict=True))), spark.createDataFrame(edges, ", ".join(f"{c} {t}" for c, t in zip(EDGE_COLUMNS, ["string"] * 4 + ["int"], strict=True))))
    got = {r["file_path"]: r["production"] for r in analytics.file_classes(g, overrides={"u11.go": False}).collect()}
    assert {k: got[k] for k in ("lib.go", "between.go", "between2.go", "eater.go", "words.go", "few.go", "alone.go", "x_test.go", "u11.go")} == {
        "lib.go": True, "between.go": True, "between2.go": False, "eater.go": False, "words.go": False, "few.go": True, "alone.go": True, "x_test.go": False, "u11.go": False,
    }
