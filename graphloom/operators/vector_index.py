"""An index of vectors in cells around fitted centres: few cells are read for a query, and exact scores decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.similarity import GROUP_QUERIES, GROUP_ROWS, best_by_group, dot, group_rows, nearest
from graphloom.plans.tables import TASK_ROWS, new_path, write_table

#: Vectors that centres are fitted on at most, and cells that an index has at most: centres go to every task.
MAX_FIT, MAX_CELLS = 50_000, 4096
#: Parts that the rows of a cell are dealt to, so that a hot cell is no single task.
PARTS = 8
#: Rows that are placed by one matrix product.
STEP_ROWS = 1024


@dataclass(frozen=True)
class VectorIndex:
    """Rows of ``id, unit`` and attributes in folders by ``cell``; ``centres``: ``cell, centre, reach``, the greatest angle between a centre and a vector of its cell."""

    path: str
    rows: DataFrame
    centres: DataFrame


def _unit(vector: Column) -> Column:
    # the array around the norm makes it once, not once an entry
    norm = F.array(F.sqrt(dot(vector, vector)))
    return F.get(F.transform(norm, lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))), F.lit(0))


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def _near_centres(rows: DataFrame, centres: DataFrame, unit: str, most: int | None = None) -> DataFrame:
    """``rows`` and ``cells, angles``: the cells in order of the angle between their centres and ``unit``, the ``most`` nearest (None: all). ``centres`` has at most MAX_CELLS rows and is sent to every task."""
    known = sorted(centres.select("cell", "centre").collect())
    cells = np.array([r["cell"] for r in known], dtype=np.int32)
    table = np.array([r["centre"] for r in known], dtype=float).reshape(len(known), len(known[0]["centre"]) if known else 0)
    keep = min(most or len(cells), len(cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                some = batch.iloc[at : at + STEP_ROWS].copy()
                x = np.zeros((len(some), table.shape[1]))
                for i, v in enumerate(some[unit]):
                    x[i, : len(v)] = v[: table.shape[1]]
                with np.errstate(all="ignore"):
                    angle = np.arccos(np.clip(x @ table.T, -1.0, 1.0))
                angle[np.isnan(angle)] = np.pi
                if keep == 1:
                    order = angle.argmin(axis=1)[:, None] if len(cells) else np.zeros((len(some), 0), int)
                else:
                    order = np.argsort(angle, axis=1, kind="stable")[:, :keep]
                some["cells"], some["angles"] = list(cells[order]), list(np.take_along_axis(angle, order, axis=1))
                yield some

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(place, f"{fields}, cells array<int>, angles array<double>")


def _ranked(near: DataFrame, *keep: str) -> DataFrame:
    """``keep, cell, angle, rank`` (from 1) of :func:`_near_centres`."""
    each = near.select(*keep, F.posexplode(F.arrays_zip("cells", "angles")).alias("at", "c"))
    return each.select(*keep, F.col("c.cells").alias("cell"), F.col("c.angles").alias("angle"), (F.col("at") + 1).alias("rank"))


def build_index(vectors: DataFrame, cells: int | None = None, seed: int = 7, path: str | None = None) -> VectorIndex:
    """Index ``vectors`` (``id, vector`` and attributes), all rows, in ``cells`` (by default about the root of their number, MAX_CELLS at most).

    Centres are fitted by cosine k-means on at most about MAX_FIT rows, those of the least hashes of ids. Vectors without a direction (zeros)
    are in a cell as any; null vectors have no row. Vectors are of one length.
    """
    spark = vectors.sparkSession
    own = vectors.where("vector IS NOT NULL").withColumn("unit", _unit(F.col("vector"))).drop("vector")
    n = own.count()
    cells = max(2, min(MAX_CELLS, cells or round(n**0.5)))
    path = path or new_path(spark, "vector-index")
    share = min(1.0, MAX_FIT / max(1, n))
    fit = own.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).where(F.exists("unit", lambda x: x != 0)).select("id", array_to_vector("unit").alias("features")).repartition(spark.sparkContext.defaultParallelism, "id")
    found = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(fit).clusterCenters() if n and not fit.isEmpty() else [[0.0] * 1]
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>").withColumn("centre", _unit(F.col("centre")))
    centres = write_table(centres, "centres")
    dealt = own.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), "id")
    placed = _near_centres(dealt, centres, "unit", 1).select(*own.columns, F.get("cells", F.lit(0)).alias("cell"), F.get("angles", F.lit(0)).alias("angle"))
    # a cell's rows are sorted into one folder by a few tasks
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(PARTS))).write.partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    reach = stored.groupBy("cell").agg(F.max("angle").alias("reach"))
    centres.join(reach, "cell").write.parquet(f"{path}/centres")
    return open_index(spark, path, placed.schema)


def open_index(spark: SparkSession, path: str, schema: StructType | None = None) -> VectorIndex:
    """The index at ``path``, from its folders. An index of no rows needs the ``schema`` of its rows."""
    reader = spark.read.schema(schema) if schema else spark.read
    return VectorIndex(path, reader.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres"))


def _best(index: VectorIndex, wanted: DataFrame, k: int, where: Column | None) -> DataFrame:
    """``query, id, similarity``: the best ``k`` for each query of ``wanted`` (``query, qu, cell``) among the rows of its cells. Cells and their queries are dealt to groups of bounded size."""
    rows = (index.rows if where is None else index.rows.where(where)).select("id", F.col("unit").alias("vector"), "cell")
    asked = wanted.select("query", F.col("qu").alias("vector"), "cell")
    most = group_rows(rows, GROUP_ROWS)
    # at most MAX_CELLS rows each
    sizes = write_table(rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts")), "cell-sizes")
    uses = write_table(asked.groupBy("cell").agg(F.ceil(F.count("*") / min(most, GROUP_QUERIES)).alias("blocks")), "cell-sizes")
    shares = F.broadcast(sizes.join(uses, "cell"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(shares, "cell").select("cell", dealt("id", F.col("parts")).alias("part"), every("blocks").alias("block"), "id", "vector")
    right = asked.join(shares, "cell").select("cell", every("parts").alias("part"), dealt("query", F.col("blocks")).alias("block"), "query", "vector")
    return best_by_group(left, right, ["cell", "part", "block"], k, True)


def search(index: VectorIndex, asked: DataFrame, k: int = 10, probes: int = 8, where: Column | None = None, exact: bool = False) -> DataFrame:
    """``query, id, similarity``: the ``k`` nearest by cosine for each of ``asked`` (``id, vector``; a stated set of queries), itself left out.

    The rows of the ``probes`` nearest cells are read and scored, those of which ``where`` (on attributes; it goes down to the
    scan) holds. With ``exact``, the k-th best so far then rules out cells that are too far for their reach, and all others are read:
    the answer is that of :func:`graphloom.operators.similarity.nearest`, with the same ties. A null vector asks for nothing.
    """
    q = write_table(asked.where("vector IS NOT NULL").select(F.col("id").alias("query"), _unit(F.col("vector")).alias("qu")), "asked")
    near = _near_centres(q, index.centres, "qu", None if exact else probes)
    ranked = write_table(_ranked(near.select("query", "cells", "angles"), "query"), "asked-cells")
    cells = ranked.where(F.col("rank") <= probes).join(q, "query")
    first = _best(index, cells.select("query", "qu", "cell"), k, where)
    if not exact:
        return first
    first = write_table(first, "asked-first")
    held = first.groupBy("query").agg(F.min("similarity").alias("worst"), F.count("*").alias("n"))
    rest = ranked.where(F.col("rank") > probes).join(index.centres.select("cell", "reach"), "cell").join(held, "query", "left")
    # no vector of a cell is nearer than the angle to its centre less the cell's reach; angles near 0 are sure to about 1e-8
    open_cells = rest.where((F.coalesce("n", F.lit(0)) < k) | (F.col("angle") - F.col("reach") <= _angle(F.col("worst")) + 1e-6)).join(q, "query")
    both = first.unionByName(_best(index, open_cells.select("query", "qu", "cell"), k, where))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query", "id", "similarity")


def choose_probes(index: VectorIndex, vectors: DataFrame, target_recall: float = 0.95, k: int = 10, queries: int = 200, seed: int = 3) -> tuple[int, float]:
    """The least number of probes whose mean recall of the ``k`` nearest reaches ``target_recall``, and that recall.

    Measured against brute force over all ``vectors`` (``id, vector``), for ``queries`` of them, those of the least hashes.
    """
    asked = write_table(vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries).select("id", "vector"), "probe-queries")
    true = nearest(vectors, asked, k).join(index.rows.select("id", "cell"), "id").select("query", "cell")
    q = asked.select(F.col("id").alias("query"), _unit(F.col("vector")).alias("qu"))
    ranked = _ranked(_near_centres(q, index.centres, "qu"), "query")
    found = {r["rank"]: r["n"] for r in true.join(ranked, ["query", "cell"]).groupBy("rank").agg(F.count("*").alias("n")).collect()}
    total, held = sum(found.values()), 0
    for p in sorted(found):
        held += found[p]
        if held >= target_recall * total:
            return p, held / total
    return 1, 1.0
