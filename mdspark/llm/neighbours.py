"""Nearest neighbours by shifted Hilbert orderings of projected vectors.

Each of CURVES orderings projects the unit vectors at random, shifts the grid and sorts by
Hilbert key, range-partitioned. A query meets the vectors in its own and the two neighbouring
key windows of every ordering; what these find is merged and gives each query a bound. Then the
window widens along the first ordering over every block that may still hold something nearer,
by a bounding cone of the block, so that the result is exact also where no ordering can keep
neighbours together, as with vectors without structure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mdspark.llm.common import Workspace, shuffle_partitions

#: Orderings, projected dimensions, bits of each; vectors in a window.
CURVES, DIMENSIONS, BITS, WINDOW = 6, 8, 7, 256
#: Vectors in a block of the widened search at least, and blocks at most: their cones are broadcast.
BLOCK, MAX_BLOCKS = 1024, 1 << 16
#: Queries that meet a block at once, those in one task's group at most, and numbers that are scored exactly at once.
QUERIES, ASKED, EXACT = 2048, 1 << 16, 1 << 20
#: What the angle of a cone may lack by rounding: the arc cosine of nearly 1 is good to half of the digits.
ANGLE = 1e-7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned cell numbers, by the transposed-axes construction."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: a random projection and shift that only the curve's number determines."""
    rng = np.random.default_rng((911, curve, vectors.shape[1]))
    projected = vectors @ rng.normal(0, 1, (vectors.shape[1], DIMENSIONS))
    shifted = (projected + rng.uniform(-0.5, 0.5, DIMENSIONS)) / 8 + 0.5
    return hilbert_keys(np.clip(shifted * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _best(queries: pa.Table, data: pa.Table, keep: int) -> pa.Table:
    """(q, c, score): the ``keep`` nearest classes of the block for each query, by exact score and then c.

    All classes whose matrix product is within rounding of the last one kept get their exact
    score, however many they are.
    """
    asked, known = _matrix(queries.column("vec")), _matrix(data.column("vec"))
    unit, q, c = _unit(known).T, queries.column("q").to_numpy(), data.column("c").to_numpy()
    n, width = min(keep, len(known)), known.shape[1]
    # a score by either way is within 4 (width + 4) roundings of the true one
    margin = 16 * (width + 4) * np.finfo(float).eps
    step = max(1, EXACT // width)
    out = []
    for first in range(0, len(asked), QUERIES):
        some = asked[first : first + QUERIES]
        scores = _unit(some) @ unit
        row, at = np.nonzero(scores >= np.partition(scores, -n, axis=1)[:, [-n]] - margin)
        exact = np.concatenate([cosine(known[at[k : k + step]], some[row[k : k + step]]) for k in range(0, len(row), step)])
        order = np.lexsort((c[at], -exact, row))
        starts = np.searchsorted(row, np.arange(len(some)))
        order = order[np.arange(len(row)) - starts[row] < n]
        out.append(pa.table({"q": q[first + row[order]], "c": c[at[order]], "score": exact[order]}))
    return pa.concat_tables(out)


_FOUND = "q long, c long, score double"


def _placed(ws: Workspace, keyed: DataFrame, size: Column) -> DataFrame:
    """``keyed`` with the number of its block of ``size`` rows in its curve's order.

    Rows are range-partitioned by curve and key and written; the driver sees only the row counts
    of partitions.
    """
    dealt = keyed.repartitionByRange(shuffle_partitions(ws.spark), "curve", "key", "c").sortWithinPartitions("curve", "key", "c")
    dealt = dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt = ws.write(dealt, "ordered")
    counts = sorted(dealt.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    offsets, before = [], {}
    for curve, part, n, first in counts:
        offsets.append((curve, part, before.get(curve, 0) - first))
        before[curve] = before.get(curve, 0) + n
    table = ws.spark.createDataFrame(offsets, "curve int, part int, offset long")
    placed = dealt.join(F.broadcast(table), ["curve", "part"])  # a row for each partition
    return placed.withColumn("block", F.floor((F.col("at") + F.col("offset")) / size).cast("long"))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each row whose id meets ``queries``, a condition on column id.

    Ties go to the smaller id; a query is no candidate of its own, its copies are. Rows whose id
    or vector is null, zero, or holds null or non-finite components take no part, and neither do
    vectors of another dimension than most rows have. Equal vectors are searched once: k + 1 of
    their smallest ids are all that any query can return. Rows that repeat an id count once, once
    for each of its vectors if these differ. An empty table gives an empty table; fewer candidates
    than k give all of them. Other columns are not read.

    Without ``exact`` the result is what the windows find: work in proportion to the rows, for
    vectors that have some structure. With it the search goes on over all blocks that the bounds
    leave, which for vectors without structure is all of them.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "neighbours")
    usable = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = usable.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    usable = ws.write(usable, "usable")
    most = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("vec") == most.d)

    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    members = usable.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = members.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = ws.write(classes.select(F.col("ids")[0].alias("c"), "ids", "vec"), "classes")
    asked = ws.write(usable.where(queries).distinct(), "asked")
    sought = ws.write(asked.groupBy("vec").agg(F.min("id").alias("q")), "sought")
    n = classes.count()
    keep = k + 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(2)))
            for curve in range(CURVES):
                row = [batch.column(0), pa.array(np.full(len(unit), curve, np.int32)), pa.array(curve_keys(unit, curve)), batch.column(1), batch.column(2)]
                yield pa.RecordBatch.from_arrays(row, ["c", "curve", "key", "q", "vec"])

    flagged = classes.join(sought, "vec", "left").select("c", "q", "vec")
    keyed = flagged.mapInArrow(keys, "c long, curve int, key long, q long, vec array<double>")
    placed = _placed(ws, keyed, F.lit(WINDOW))

    def window(_key: tuple, data: pa.Table, asking: pa.Table) -> pa.Table:
        if not data.num_rows or not asking.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _best(asking, data, keep)

    asking = placed.where("q IS NOT NULL").select("q", "vec", "curve", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"))
    asking = ws.write(asking, "asking")
    data = placed.select("c", "vec", "curve", "block")
    found = data.groupBy("curve", "block").cogroup(asking.groupBy("curve", "block")).applyInArrow(window, _FOUND)
    found = ws.write(found.groupBy("q", "c").agg(F.max("score").alias("score")), "near")
    own = sought.join(classes.select("c", "vec"), "vec").select("q", F.col("c").alias("own"))
    others = found.join(own, "q").where(F.col("c") != F.col("own"))
    kth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    bound = others.withColumn("nth", kth).where(F.col("nth") == k).select("q", F.col("score").alias("bound"))

    if not exact:
        return _ranked(found.withColumn("nth", kth).where(F.col("nth") <= keep).select("q", "c", "score"), classes, asked, sought, k)
    size = max(BLOCK, -(-n // MAX_BLOCKS))
    blocks = placed.where("curve = 0").select("c", "vec", F.floor((F.col("at") + F.col("offset")) / size).cast("long").alias("block"))

    def cone(key: tuple, data: pa.Table) -> pa.Table:
        unit = _unit(_matrix(data.column("vec")))
        axis = unit.mean(axis=0)
        axis /= max(float(np.linalg.norm(axis)), 1e-300)
        widest = float(np.arccos(np.clip((unit @ axis).min(), -1, 1))) + ANGLE
        return pa.table({"block": [key[0].as_py()], "axis": [axis.tolist()], "angle": [widest]})

    cones = blocks.groupBy("block").applyInArrow(cone, "block long, axis array<double>, angle double").toArrow()
    shared = spark.sparkContext.broadcast((_matrix(cones.column("axis")), cones.column("angle").to_numpy(), cones.column("block").to_numpy()))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, angles, numbers = shared.value
        for batch in batches:
            unit = _unit(_matrix(batch.column(1)))
            bounds = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            closest = np.maximum(0, np.arccos(np.clip(unit @ axes.T, -1, 1)) - angles)
            row, at = np.nonzero(~(np.cos(closest) < bounds[:, None] - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(numbers[at])], ["q", "vec", "block"])

    wide = sought.join(bound, "q", "left").select("q", "vec", "bound").mapInArrow(widen, "q long, vec array<double>, block long")
    # a group has a block and at most about ASKED of the queries that meet it
    slices = -(-sought.count() // ASKED)
    wide = wide.withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(max(1, slices)).cast("long")))
    whole = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, slices - 1)).cast("long"))))
    more = whole.groupBy("block", "slice").cogroup(wide.groupBy("block", "slice")).applyInArrow(window, _FOUND)
    merged = found.unionByName(more).groupBy("q", "c").agg(F.max("score").alias("score"))
    merged = merged.withColumn("nth", kth).where(F.col("nth") <= keep).select("q", "c", "score")
    return _ranked(merged, classes, asked, sought, k)


def _ranked(merged: DataFrame, classes: DataFrame, asked: DataFrame, sought: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query from its nearest classes."""
    scored = merged.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    nearest_first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= k + 1).drop("nth")
    of_query = asked.join(sought, "vec").select(F.col("id").alias("query_id"), "q")
    out = of_query.join(scored, "q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed component by component; a power of two keeps squares in range."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return np.clip(dot / np.sqrt(aa * bb), -1, 1)
