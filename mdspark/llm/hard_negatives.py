"""Hard negatives: rows of another label that score nearly as high with an anchor as one of its positives.

The scores of an anchor are sorted whole, by score and then id; a positive's score is searched in
them and the entries from there down to the lower limit are read until k have another label. The
sort is done by blocks of rows, so that no task holds more than a block's scores: the first pass
finds each anchor's positives, the second one its negatives in each block, and what the blocks
give is merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mdspark.llm.common import Workspace

#: Rows of a block, anchors that one task compares with it, numbers of scores held at once.
BLOCK, ANCHORS, SCORES = 1 << 15, 1 << 13, 1 << 21
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def scorer(anchors: np.ndarray, rows: np.ndarray):
    """Function of a slice of the anchors to their exact integer inner products with the rows; beyond 64 bits these stay at the bound."""
    most = [float(np.abs(m.astype(float)).max(initial=0)) for m in (anchors, rows)]
    bound = most[0] * most[1] * max(1, anchors.shape[1])
    kind = float if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object
    asked, known = anchors.astype(kind), rows.astype(kind).T

    def scores(some: slice) -> np.ndarray:
        products = asked[some] @ known
        return (np.clip(products, _LOWEST, _HIGHEST) if kind is object else products).astype(np.int64)

    return scores


def limits(positive: int, lower: int, upper: int) -> tuple[int, int]:
    """Least and greatest score s with lower * positive <= 100 * s <= upper * positive."""
    return max(_LOWEST, -((-lower * positive) // 100)), min(_HIGHEST, (upper * positive) // 100)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sorted_scores(anchors: pa.Table, rows: pa.Table):
    """(number of the anchor, its scores, the order of all rows by score, highest first, and then id) of each anchor."""
    ids = rows.column("id").to_numpy()
    scores = scorer(_matrix(anchors.column("vec")), _matrix(rows.column("vec")))
    step = max(1, SCORES // len(ids))
    for first in range(0, anchors.num_rows, step):
        for k, own in enumerate(scores(slice(first, first + step)), first):
            yield k, own, np.lexsort((ids, ~own))  # ~ turns the order round within 64 bits


_POSITIVE, _NEGATIVE = "row long, id long, score long", "row long, nth int, id long, score long"


def _table(schema: str, columns: dict[str, list]) -> pa.Table:
    kinds = (part.split() for part in schema.split(", "))
    return pa.table({name: pa.array(columns[name], pa.int32() if kind == "int" else pa.int64()) for name, kind in kinds})


def _positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """The first ``most`` rows of the block with each anchor's label and another id."""
    out: dict[str, list] = {"row": [], "id": [], "score": []}
    if anchors.num_rows and rows.num_rows:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        names, wanted, numbers = (anchors.column(c).to_pylist() for c in ("id", "label", "row"))
        for k, scores, order in _sorted_scores(anchors, rows):
            own = order[(labels[order] == wanted[k]) & (ids[order] != names[k])][:most]
            out["row"] += [numbers[k]] * len(own)
            out["id"] += ids[own].tolist()
            out["score"] += scores[own].tolist()
    return _table(_POSITIVE, out)


def _negatives(anchors: pa.Table, rows: pa.Table, most: int, lower: int, upper: int) -> pa.Table:
    """For each positive of an anchor the first ``most`` rows of the block with another label between the limits."""
    out: dict[str, list] = {"row": [], "nth": [], "id": [], "score": []}
    if anchors.num_rows and rows.num_rows:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        own, numbers, positives = (anchors.column(c).to_pylist() for c in ("label", "row", "positives"))
        for k, scores, order in _sorted_scores(anchors, rows):
            others = order[labels[order] != own[k]]
            down = ~scores[others]
            for positive in positives[k]:
                low, high = limits(positive["score"], lower, upper)
                first = int(np.searchsorted(down, ~high))
                some = others[first : first + most]
                some = some[scores[some] >= low] if low <= high else some[:0]
                out["row"] += [numbers[k]] * len(some)
                out["nth"] += [positive["nth"]] * len(some)
                out["id"] += ids[some].tolist()
                out["score"] += scores[some].tolist()
    return _table(_NEGATIVE, out)


def integer_vectors(column: str, scale: float = 256) -> Column:
    """floor(scale * x) of each component, in double precision; null for a null vector and one with null or non-finite components. Beyond 64 bits they stay at the bound."""
    vector = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def hard_negatives(
    vectors: DataFrame, anchors: Column, k: int = 5, positives: int = 5, lower: int = 80, upper: int = 100,
    key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: float = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet ``anchors``, a condition on column id.

    A score is the integer inner product of vectors of floor(scale * x). Higher scores come first,
    ties go to the smaller id. An anchor's positives are its first ``positives`` rows of the same
    label and another id; the negatives of a positive are its first ``k`` rows of another label
    whose score lies from ``lower`` to ``upper`` hundredths of the positive's. A positive below
    zero has none.

    Rows with a null id, label or vector, or with null or non-finite components, take no part, and
    neither do vectors of another dimension than most rows have. Rows that repeat whole count
    once; rows of one id with different vectors or labels count each. Fewer rows than asked for
    give all of them; an empty table gives an empty table; other columns are not read.

    Work is anchors times rows: each pair is scored twice. Rows are dealt by their ids into blocks
    of some BLOCK, anchors into groups of some ANCHORS, so a task has a bounded size whatever the
    labels are, and sends at most ``positives`` rows of an anchor, then ``positives * k``.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "hard-negatives")
    usable = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"), integer_vectors(vector, scale).alias("vec")
    ).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    sizes = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    usable = usable.where(F.size("vec") == sizes.d).distinct().withColumn("row", F.monotonically_increasing_id())
    usable = ws.write(usable, "usable")
    asked = ws.write(usable.where(anchors), "asked")
    n_blocks, n_groups = -(-usable.count() // BLOCK), max(1, -(-asked.count() // ANCHORS))

    def dealt(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n).cast("long"))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    cell = ("block", "part")
    rows = usable.select("id", "label", "vec", dealt(1, n_blocks).alias("block"), every(n_groups).alias("part"))

    def find_positives(_key: tuple, asking: pa.Table, block: pa.Table) -> pa.Table:
        return _positives(asking, block, positives)

    def find_negatives(_key: tuple, asking: pa.Table, block: pa.Table) -> pa.Table:
        return _negatives(asking, block, k, lower, upper)

    def met(asking: DataFrame, find, schema: str) -> DataFrame:
        asking = asking.withColumn("part", dealt(2, n_groups)).withColumn("block", every(n_blocks))
        return asking.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(find, schema)

    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    first = met(asked, find_positives, _POSITIVE).withColumn("nth", nth).where(F.col("nth") <= positives)
    first = ws.write(first, "positives")
    known = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("positives"))
    rank = F.row_number().over(Window.partitionBy("row", "nth").orderBy(F.desc("score"), "id"))
    found = met(asked.join(known, "row"), find_negatives, _NEGATIVE).withColumn("rank", rank).where(F.col("rank") <= k)
    found = found.select("row", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of_anchor = asked.select("row", F.col("id").alias("anchor_id")).join(first, "row")
    out = found.join(of_anchor.select("anchor_id", "row", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["row", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
