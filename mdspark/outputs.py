"""Results as lines of text or JSON. Each gives a DataFrame with one column ``line``; order is that of the input."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark import manual


def json_rows(frame: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return frame.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in frame.columns)), {"ignoreNullFields": "false"}).alias("line"))


def _place(scores: bool) -> Column:
    heading = F.when(F.col("heading").isNull(), "").otherwise(F.concat(F.lit("#"), "heading"))
    place = F.concat("path", heading)
    return F.concat(place, F.format_string(" (score=%.6f)", "score")) if scores else place


def hit_lines(hits: DataFrame, scores: bool = False) -> DataFrame:
    """Where a hit is, and its snippet in the line below."""
    return hits.select(F.concat(_place(scores), F.lit("\n"), F.coalesce("snippet", F.lit(""))).alias("line"))


def note_paths(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("line"))


def record_lines(rows: DataFrame, diagnostics: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows as JSON, and what is to be said of the query beside them."""
    return json_rows(rows), [f"note: {d}" for d in diagnostics or []]


def context_blocks(context: DataFrame, scores: bool = False) -> DataFrame:
    """A block for each item: where it is, and its text. Blocks are parted by an empty line when they are printed."""
    return context.select(F.concat(_place(scores), F.lit("\n"), "text").alias("line"))


def link_lines(links: DataFrame) -> DataFrame:
    """Source, what was written, and target of a link, by tabs."""
    return links.select(F.concat_ws("\t", "source_path", "raw_target", F.coalesce("target_path", F.lit("<unresolved>"))).alias("line"))


def backlink_lines(notes: DataFrame) -> DataFrame:
    """Path and title of the notes that link to one, by tabs."""
    return notes.select(F.concat_ws("\t", "path", "title").alias("line"))


def status_lines(status: DataFrame) -> DataFrame:
    """``name: value`` for each column of the one row."""
    pairs = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in status.columns))
    return status.select(F.explode(pairs).alias("line"))


def manual_lines(spark: Any, topic: str = "all") -> DataFrame:
    return spark.createDataFrame([(x,) for x in manual.render(topic).split("\n")], "line string")


def printed(frame: DataFrame, between: str = "\n") -> str:
    """A bounded result as one text, on the driver."""
    return between.join(r["line"] for r in frame.collect())
