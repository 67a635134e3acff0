"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.shipping import ship_package
from mdspark.storage import shared_folder

#: Rows of one Arrow batch; whole texts travel in them, so it is kept well below Spark's default.
ARROW_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs nothing: the files stay. ``drop`` removes tables which the result
    no longer reads; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path, files = self._files(self.root)
        files.deleteOnExit(path)
        small_arrow_batches(spark)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._files(f"{self.root}/{name}")
            files.delete(path, True)


def small_arrow_batches(spark: SparkSession) -> None:
    """To be called before Python runs on executors: whole texts in small batches, this package on their path."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def text_of(column: str = "text"):
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many signs after it as it takes that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(ws: Workspace, edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): component is the smallest id reachable.

    Alternating hub rewiring: each round links every vertex to the smallest neighbour of its
    larger, then of its smaller side, so that long chains collapse in logarithmically many
    rounds. Each round is written to the shared folder. Duplicate edges and self loops are
    harmless. Raises if it has not converged after ``max_rounds``.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = ws.write(e, f"{tag}-0")
    before = None
    for k in range(1, max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of v, and v, link to v's smallest neighbour or v
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: every smaller neighbour of v, and v, link to the smallest one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a < b")
            .distinct()
        )
        e = ws.write(small, f"{tag}-{k}")
        ws.drop(f"{tag}-{k - 1}")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not converge")
    star = e.select(F.col("b").alias("id"), F.col("a").alias("component"))
    hubs = e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return star.unionByName(hubs)
