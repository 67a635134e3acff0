"""Links between notes: resolution, backlinks, outgoing links, neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.functions.text import collapse_path
from mdspark.storage import scratch

if TYPE_CHECKING:  # the index resolves links with this module
    from mdspark.sources.index import Index


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"(?i)\.md$", ""))


def note_keys(notes: DataFrame) -> DataFrame:
    """(key): what links may call the notes (path, title) by."""
    return notes.select(F.explode(F.array(_stem(F.col("path")), F.lower("title"))).alias("key")).distinct()


def _with_candidates(links: DataFrame) -> DataFrame:
    """``links`` with what a target may stand for: a path from the root, one from its source, a title."""
    folder = F.regexp_extract("source_path", "^(.*)/[^/]*$", 1)
    out = links.withColumn("_a", collapse_path(F.col("normalized_target"))).withColumn("_b", collapse_path(F.concat_ws("/", folder, "normalized_target")))
    return out.withColumn("_c", F.element_at(F.split("_a", "/"), -1))


def link_keys(links: DataFrame) -> DataFrame:
    """(source_path, key): the keys of notes that decide where each link leads."""
    return _with_candidates(links).select("source_path", F.explode(F.array("_a", "_b", "_c")).alias("key"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` (source_path, normalized_target, ...) with target_path.

    First the target as a path from the root, then as one relative to its source; then as a
    title, if exactly one note has it; else null.
    """
    unique = lambda key: notes.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), F.min("path").alias("_path")).where("_n = 1").drop("_n")
    paths, titles = unique(_stem(F.col("path"))), unique(F.lower("title"))
    out = _with_candidates(links)
    for name, keys in (("_a", paths), ("_b", paths), ("_c", titles)):
        out = out.join(keys.select(F.col("_key").alias(name), F.col("_path").alias(f"{name}p")), name, "left")
    return out.withColumn("target_path", F.coalesce("_ap", "_bp", "_cp")).drop("_a", "_b", "_c", "_ap", "_bp", "_cp")


def backlinks(links: DataFrame, path: str) -> DataFrame:
    """(source_path) of the notes that link to one, by path."""
    return links.where(F.col("target_path") == path).select("source_path").distinct().orderBy("source_path")


def outlinks(links: DataFrame, path: str) -> DataFrame:
    """The links of a note, those that lead nowhere with a null target_path."""
    return links.where(F.col("source_path") == path)


def unresolved(links: DataFrame) -> DataFrame:
    return links.where(F.col("target_path").isNull())


def _hops(spark: SparkSession, start: str, depth: int, neighbours: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(path, hop): what ``neighbours`` (path) of a frontier reach; each frontier is written once."""
    frontier = spark.createDataFrame([(start, 0)], "path string, hop int")
    seen = frontier
    for hop in range(1, depth + 1):
        reached = neighbours(frontier).distinct().join(seen, "path", "left_anti").withColumn("hop", F.lit(hop))
        reached.write.parquet(f"{folder}/hop-{hop}")
        frontier = spark.read.schema(reached.schema).parquet(f"{folder}/hop-{hop}")
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(links: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(path, hop) of the notes within ``depth`` links of ``start`` in either direction.

    The edges are written once, and each hop joins them with its frontier; ``depth`` bounds the
    number of rounds. ``neighbourhood_of`` reads the edges that an index keeps.
    """
    spark, folder = links.sparkSession, scratch(links.sparkSession, "neighbourhood")
    known = links.where("target_path IS NOT NULL").select(F.col("source_path").alias("a"), F.col("target_path").alias("b"))
    edges = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges.write.parquet(f"{folder}/edges")
    both = spark.read.schema(edges.schema).parquet(f"{folder}/edges")
    return _hops(spark, start, depth, lambda frontier: frontier.join(both, frontier.path == both.a).select(F.col("b").alias("path")), folder)


def neighbourhood_of(index: Index, start: str, depth: int = 2) -> DataFrame:
    """The same over an index: a hop reads the edges in the buckets of its frontier, and shuffles no others."""
    index.edges()  # made, if it is the first time
    index = index.pinned()
    return _hops(index.spark, start, depth, lambda frontier: index.edges_at(frontier).select(F.col("other").alias("path")), scratch(index.spark, "neighbourhood"))


def backlinks_of(index: Index, path: str) -> DataFrame:
    """(source_path) of the notes that link to one, by path, from the edges in its bucket."""
    one = index.spark.createDataFrame([(path,)], "path string")
    return index.edges_at(one).where("incoming").select("source_path").distinct().orderBy("source_path")
