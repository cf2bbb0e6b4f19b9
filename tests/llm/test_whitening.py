"""Whitening against exact sums and numpy's eigenvectors."""

from __future__ import annotations

import collections
import math
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, `a.b` string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 9, "x", "y") for i, v in vectors], SCHEMA)


def plain_version(vectors, k=4):
    """(vec_id, deviation) of the rows that stay, and per row the whitened coordinates up to sign, by definition."""
    sound = [(i, v) for i, v in vectors if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    d = max((n, s) for s, n in collections.Counter(len(v) for _, v in sound).items())[1]
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in sound if len(v) == d]
    fit = sorted(set(v for _, v in x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in x]
    centred = lambda v: [float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums, strict=True)]
    u = np.array([centred(v) for v in fit])
    e, axes = np.linalg.eigh(u.T @ u / n)
    order = np.argsort(e)[::-1][:k]
    y = np.array([centred(v) for _, v in x]) @ axes[:, order] / np.sqrt(e[order])
    trace = float(sum(sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in fit)) / n**3
    return n, dev, y, e[order] / trace


@pytest.mark.parametrize("offset", [0.0, 900.0])
def test_against_plain_version(spark, offset):
    r = np.random.default_rng(3)
    base = (r.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + offset).astype(np.float32).tolist()
    vectors = list(enumerate(base)) + [(i, base[0]) for i in range(1000, 1300)] + [(None, base[5]), (7, base[9])]
    vectors += [(2000, None), (2001, [None] * 12), (2002, [math.nan, *base[0][1:]]), (2003, [math.inf] * 12), (2004, []), (2005, [1.0] * 5), (2006, [-0.0] * 12)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    n, dev, y, explained = plain_version(vectors)
    assert {r["n"] for r in rows} == {n} and all(0 <= r["identity_error"] < 1e-9 for r in rows)
    assert collections.Counter((r["vec_id"], int(r["deviation"])) for r in rows if r["component"] == 1) == collections.Counter(dev)
    for k in range(4):
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])), r["whitened"]) for r in rows if r["component"] == k + 1)
        want = sorted(((i is None, i or 0, d), float(v)) for (i, d), v in zip(dev, y[:, k], strict=True))
        a, b = np.array([v for _, v in mine]), np.array([v for _, v in want])
        assert [i for i, _ in mine] == [i for i, _ in want]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(math.isclose(r["explained"], explained[k], rel_tol=1e-9) for r in rows if r["component"] == k + 1)


def test_few_and_flat(spark):
    assert not whitening.whiten(frame(spark, [])).collect()
    assert not whitening.whiten(frame(spark, [(1, None), (2, [math.nan])])).collect()
    assert not whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 6 and math.isclose(line[0]["explained"], 1.0)
    two = whitening.whiten(frame(spark, [(1, [0.0, 0.0]), (2, [0.001, 0.0])])).collect()  # one vector after rounding
    assert not two


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 39, -5], [-(1 << 39), 7], [3, 3]], np.int64)
    sums = [3, 5 * 10**9]
    n = 10**9
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    small = np.arange(12, dtype=np.int64).reshape(4, 3)
    assert whitening.deviations(small, 4, [18, 22, 26]) == [sum((4 * int(c) - s) ** 2 for c, s in zip(v, [18, 22, 26], strict=True)) for v in small]


def test_large_entries(spark):
    """Deviations over 38 digits are null, and the total variance comes in doubles."""
    vectors = [(i, [float(2**30) * (i % 3), float(i)]) for i in range(9)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    n, dev, _, explained = plain_version(vectors)
    assert n == 9 and {(r["vec_id"], int(r["deviation"])) for r in rows} == set(dev)
    assert math.isclose(rows[0]["explained"], explained[0], rel_tol=1e-6)


def test_query_reads_the_whole_table(spark, sf):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = queries.QUERIES["op13_whitening"](spark, sf).collect()
    n, dev, _, _ = plain_version(table)
    assert {(r["vec_id"], r["deviation"]) for r in rows} == set(dev) and len(rows) == 4 * len(dev) and rows[0]["n"] == n
    assert rows[0]["identity_error"] < 1e-4
