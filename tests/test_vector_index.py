"""Nearest vectors from cells: recall against brute force, and the exact way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import similarity
from graphloom.operators import vector_index as vi


def brute(x, ids, queries, k, allowed=None):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in queries:
        s = u @ u[ids.index(q)]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q and (allowed is None or allowed[j])]
        out[q] = [ids[j] for j in order[:k]]
    return out


def test_recall_and_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    r = np.random.default_rng(0)
    spots = r.normal(size=(12, 64))
    made = [(10_000 + i, (spots[i % 12] + r.normal(size=64) * 0.4).tolist(), i % 5) for i in range(500)]
    data = [(x["vec_id"], [float(c) for c in x["embedding"]], x["label"]) for x in rows] + made + [(20_000, [0.0] * 64, 1), (20_001, made[0][1], 0)]
    df = spark.createDataFrame([*data, (20_002, None, 1)], "id long, vector array<float>, label int")
    index = vi.build_index(df, seed=3)
    assert index.rows.count() == len(data) and index.rows.select("id").distinct().count() == len(data)
    ids, x = [d[0] for d in data], np.array([d[1] for d in data], np.float32).astype(float)
    asked = [i for i in ids if i % 100 == 0 and i != 20_000]
    q = df.where(F.col("id").isin(asked))
    want = brute(x, ids, asked, 10)

    def found(**how):
        out = {}
        for y in vi.search(index, q, 10, **how).orderBy("query", F.desc(F.round("similarity", 12)), "id").collect():
            out.setdefault(y["query"], []).append(y["id"])
        return out

    assert found(probes=2, exact=True) == want
    probes, measured = vi.choose_probes(index, df, 0.95)
    got = found(probes=probes)
    assert measured >= 0.95 and sum(len(set(got[i]) & set(want[i])) for i in asked) >= 0.9 * 10 * len(asked)
    assert probes < index.centres.count()
    some = brute(x, ids, asked, 10, [d[2] == 2 for d in data])
    assert found(probes=3, exact=True, where=F.col("label") == 2) == some
    again = vi.open_index(spark, index.path)
    assert again.rows.count() == len(data)


def test_scores_are_matrix_products_with_exact_ties(spark, monkeypatch):
    """Each pair of a query and a row was a row of its own, scored entry by entry, and queries met all rows in as many tasks as there are blocks."""
    monkeypatch.setattr(similarity, "GROUP_ROWS", 40)
    monkeypatch.setattr(similarity, "GROUP_QUERIES", 7)
    r = np.random.default_rng(1)
    base = [[float(c) for c in r.normal(size=6)] for _ in range(30)]
    data = [(i, base[i % 30] if i % 3 else [2.0 * c for c in base[i % 30]]) for i in range(200)] + [(400 + i, base[1]) for i in range(60)]
    data += [(500, None), (501, [0.0] * 6), (502, [1.0, 2.0]), (503, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6), (505, [])]
    df = spark.createDataFrame(data, "id long, vector array<double>")
    asked = df.where("id % 10 = 0 OR id > 495")
    for k in (3, 400):
        c = similarity.cosine(F.col("vector"), F.col("qv"))
        pairs = df.crossJoin(asked.select(F.col("id").alias("query"), F.col("vector").alias("qv"))).where("query <> id").select("query", "id", F.coalesce(c, F.lit(0.0)).alias("similarity"))
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        want = pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
        found = similarity.nearest(df, asked, k)
        as_rows = lambda d: sorted((x["query"], x["id"], str(x["similarity"])) for x in d.collect())
        assert as_rows(found) == as_rows(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan


def test_few(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert not vi.search(vi.build_index(none), none).collect()
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "id long, vector array<float>")
    got = vi.search(vi.build_index(two), two, exact=True).collect()
    assert sorted((r["query"], r["id"]) for r in got) == [(1, 2), (2, 1)]
