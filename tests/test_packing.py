"""Packing over all matches."""

from __future__ import annotations

import __spark_entry__ as entry
from graphloom.sources.graphs import supply_graph


def test_packed_context(spark, sf):
    names = [(r["id"], r["name"], r["kind"]) for r in supply_graph(spark, sf).nodes.select("id", "name", "kind").collect()]
    kinds = {"function": 1.0, "method": 1.0, "interface": 0.8, "struct": 0.8, "type": 0.8, "class": 0.8}
    hits = [(-(0.4 * 0.95 + 0.3 + 0.3 * kinds.get(k, 0.5)), i, -(-len(n) // 4)) for i, n, k in names if n.lower().startswith("customer#00")]
    assert hits and not any("customer#00" in n.lower() and not n.lower().startswith("customer#00") for _, n, _ in names)
    used, want = 0, []
    for _, i, t in sorted(hits):
        if used + t <= 90:
            used += t
            want.append((i, t, used))
    got = sorted((tuple(r) for r in entry.queries()["packed_context"](spark, sf).select("id", "tokens", "used").collect()), key=lambda r: r[2])
    assert want and got == want
