"""Places in an order, found over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.storage import scratch


def numbered(frame: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``frame`` with each row's place from 1 in a column ``name``.

    Rows are sorted by ranges over all tasks and written; a row's place is that in its range and
    the sizes of the ranges before, of which the driver sees one number a task.
    """
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(spark, "numbered")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["p"], total))
        total += r["n"]
    before = spark.createDataFrame(starts or [(0, 0)], "_p long, _before long")
    out = placed.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(before), "_p")  # a row for each task
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_at", "_before")
