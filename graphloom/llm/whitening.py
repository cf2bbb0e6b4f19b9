"""Whitening of embeddings: principal components by MLlib's SVD of centred rows, variances in exact arithmetic."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType

from graphloom.llm.common import map_batches, slices
from graphloom.plans.tables import write_table

#: Entries are counted in steps of 1 / SCALE.
SCALE = 256
#: Entries of 2**LARGEST steps and more count as non-finite.
LARGEST = 40
#: Singular values below this share of the largest are rounding: their components are left out.
LEAST_SHARE = 3e-6
#: Vectors of more dimensions get their first components by Lanczos steps over the cluster, others all of them by LAPACK on a matrix of dimensions squared.
LAPACK_DIMS = 4096


def steps(vector: Column) -> Column:
    """The entries of a vector as whole numbers of steps; null where the vector or an entry is null or not finite."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < 2.0**LARGEST, F.lit(False)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sum) ** 2 for each row of ``x``, exact."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    x = x - whole
    far = max(1, int(np.abs(x).max(initial=0)) + 1) * n
    if x.shape[1] * far * far < 1 << 63:
        y = x * n - rest
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - rest.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def _projected(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray, roots: np.ndarray) -> DataFrame:
    """``rows`` (any columns, and ``x``) with ``x`` replaced by its exact deviation and its whitened coordinates."""
    names = [c for c in rows.columns if c != "x"]
    whole, part = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=4096):
            x = _matrix(b.column("x"))
            w = (((x - whole) - part) @ axes) / roots
            exact = [v if v < 10**38 else None for v in deviations(x, n, sums)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(exact, pa.decimal128(38, 0)), lists], names=[*names, "deviation", "w"])

    schema = rows.select(*names).schema.add("deviation", DecimalType(38, 0)).add("w", ArrayType(DoubleType()))
    return map_batches(rows, run, schema)


def fit(x: DataFrame, components: int = 4) -> dict[str, Any]:
    """What whitening needs to know of ``x`` (column ``x``: one row for each distinct vector, all of one length).

    ``n``, ``sums`` (exact), ``axes`` (a column for each component), ``eigenvalues``,
    ``explained`` and ``identity_error``. Two aggregates and the matrix of squares of
    MLlib's ``computeSVD`` go to the driver, each of the size of the dimensions alone.
    """
    split = F.lit(1 << 20)
    entries = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.floor(F.col("c") / split)).alias("high"), F.sum(F.pmod("c", split)).alias("low"), F.min("c").alias("least"), F.max("c").alias("most")
    )
    found = sorted(entries.collect(), key=lambda r: r["i"])
    n, sums = (found[0]["n"] if found else 0), [(r["high"] << 20) + r["low"] for r in found]
    none = {"n": n, "sums": sums, "axes": np.zeros((len(sums), 0)), "eigenvalues": np.zeros(0), "explained": np.zeros(0), "identity_error": 0.0}
    if all(r["least"] == r["most"] for r in found):
        return none
    whole, part = F.lit([s // n for s in sums]), F.lit([(s % n) / n for s in sums])
    centred = F.zip_with(F.zip_with("x", whole, lambda a, b: a - b), part, lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(centred).alias("v")), "v")
    dims = len(sums)
    svd = RowMatrix(rows, numCols=dims).computeSVD(dims if dims <= LAPACK_DIMS else components, rCond=LEAST_SHARE)
    k = min(components, len(svd.s))
    eigenvalues = np.asarray(svd.s.toArray()[:k]) ** 2 / n
    axes = svd.V.toArray()[:, :k]
    axes = axes / np.linalg.norm(axes, axis=0)
    spread = _projected(x, n, sums, axes, np.sqrt(eigenvalues))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    told = spread.agg(
        F.try_sum("deviation").alias("exact"), F.sum(F.col("deviation").cast("double")).alias("near"), F.count("deviation").alias("held"),
        *(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs),
    ).collect()[0]
    total = int(told["exact"]) / n**3 if told["exact"] is not None and told["held"] == n else _trace(spread, x, n, sums)
    error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return none | {"axes": axes, "eigenvalues": eigenvalues, "explained": eigenvalues / total, "identity_error": float(error)}


def _trace(spread: DataFrame, x: DataFrame, n: int, sums: list[int]) -> float:
    """The total variance in doubles, where the exact sum has over 38 digits."""
    means = F.lit([s / n for s in sums])
    squares = F.zip_with("x", means, lambda a, b: (a - b) * (a - b))
    return float(x.agg(F.sum(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))).collect()[0][0]) / n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become whole numbers ``x`` of 1/256. The fit list holds each distinct
    ``x`` vector once (folded on the map side, so a hot vector costs one row a
    task). Its exact sums centre the rows; MLlib's ``computeSVD`` gives unit
    eigenvectors; singular values squared over the number n of fitted vectors are the
    eigenvalues of the covariance. The total variance comes from exact deviations, not from the SVD.

    ``deviation``: sum over dimensions of (n * x - S) ** 2, decimal(38, 0), null beyond 38 digits.
    ``whitened``: the centred vector's coordinate on the component over the
    root of its eigenvalue. ``identity_error``: largest entry of the whitened fit list's
    covariance minus the identity.

    Dropped: null vectors, vectors with null or non-finite entries (so are those of 2**40 steps and more),
    and vectors of another length than most have (the longer of two lengths that are as frequent).
    Components whose singular value is under LEAST_SHARE of the largest are left out, so
    vectors that are all equal, and empty tables, give no rows. Repeated rows and null ids
    each get their rows. Other columns are ignored.
    """
    name, vector = (F.col(f"`{c}`") for c in (id_col, vector_col))
    rows = vectors.select(name.alias("vec_id"), steps(vector).alias("x")).where("size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    dims = sizes.agg(F.max_by("d", F.struct("n", "d"))).collect()[0][0] or 0
    rows = rows.where(F.size("x") == dims)
    distinct = write_table(rows.select("x").distinct(), "whitening-fit")
    m = fit(distinct, components)
    n = max(1, m["n"])
    out = _projected(rows, n, m["sums"] or [0] * dims, m["axes"], np.sqrt(m["eigenvalues"]))
    share = F.lit([float(e) for e in m["explained"]] or [math.nan])
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(m["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(m["identity_error"]).alias("identity_error"),
    )
