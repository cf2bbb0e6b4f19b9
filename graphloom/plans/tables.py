"""Tables written between jobs: cut lineage, keep statistics, survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode, where one machine is the whole cluster, gets
    a folder of its own if the setting is missing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a table of known size that a task writes at least.
TASK_ROWS = 20_000


def write_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it. With ``rows``, about as many as there are, a small table is written by few tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None and rows < TASK_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(1 + rows // TASK_ROWS)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides both grow with the tables, which are never broadcast. Spark guesses sizes from files, where neither exploded rows nor well compressed columns show."""
    return df.hint("merge")


class GrowingTable:
    """Rows that are added step by step under one path: a reader's plan stays one scan however many steps there were."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.path, self.steps = first.sparkSession, first.schema, new_path(first.sparkSession, name), 0
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` as the next step, and return a reader of them alone."""
        at = f"{self.path}/{self.steps:06d}"
        rows.select(*self.schema.names).write.parquet(at)
        self.steps += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def read(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        out._table_path = self.path
        return out


def drop_table(df: DataFrame | None) -> None:
    """Delete what :func:`write_table` wrote for ``df``."""
    path = getattr(df, "_table_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
