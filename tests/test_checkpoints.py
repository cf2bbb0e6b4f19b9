"""A state from a snapshot and its tail equals a full replay."""

from __future__ import annotations

import random

import pytest

from graphloom.streaming import checkpoints as cp

SCHEMA = "seq long, key string, op string, value double"


def replayed(deltas, upto=None):
    out = {}
    for s, k, op, v in sorted(deltas):
        if upto is None or s <= upto:
            out[k] = (s, v)
            if op == "delete":
                del out[k]
    return out


def test_snapshot_and_tail(spark, tmp_path):
    r = random.Random(5)
    deltas = [(s, f"k{r.randrange(30)}", "delete" if r.random() < 0.3 else "put", float(s)) for s in range(1, 400)]
    path = f"file://{tmp_path}/journal"
    got = lambda upto=None: {x["key"]: (x["seq"], x["value"]) for x in cp.state_at(spark, path, upto, 50).collect()}
    assert cp.snapshots(spark, path) == [] and cp.compact(spark, path, 50) == 0 and cp.checkpoint(spark, path, segment=50) is None
    for lo, hi in ((0, 130), (130, 131), (131, 260), (260, 399)):
        cp.append(spark.createDataFrame(deltas[lo:hi], SCHEMA), path, 50)
        assert got() == replayed(deltas[:hi])
        if hi == 131:
            assert cp.checkpoint(spark, path, segment=50) == 131
        if hi == 260:
            assert cp.checkpoint(spark, path, 205, segment=50) == 205
    assert cp.snapshots(spark, path) == [131, 205]
    for upto in (1, 130, 131, 132, 204, 205, 206, 300, 399, 1000):
        assert got(upto) == replayed(deltas, upto)
    assert cp.compact(spark, path, 50) == 4 and cp.snapshots(spark, path) == [205]
    assert got() == replayed(deltas) and got(205) == replayed(deltas, 205) and got(250) == replayed(deltas, 250)
    with pytest.raises(ValueError, match="compacted"):
        cp.state_at(spark, path, 131, 50)
    assert cp.checkpoint(spark, path, segment=50) == 399 == cp.checkpoint(spark, path, segment=50)
    assert got() == replayed(deltas)


def test_pruned_segments(spark, tmp_path):
    path = f"file://{tmp_path}/journal"
    cp.append(spark.createDataFrame([(s, "k", "put", 1.0) for s in range(0, 1000, 10)], SCHEMA), path, 100)
    plan = cp._tail(spark, path, 755, None, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "segment#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert cp._tail(spark, path, 755, None, 100).count() == 24
