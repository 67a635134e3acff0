"""Incremental ingestion: a stream of new files feeds the same transforms as a full read; an index follows a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mdspark.sources.commits import Conflict
from mdspark.sources.index import Index
from mdspark.sources.vault import parse_notes

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_notes(spark: SparkSession, root: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends every new Markdown file below ``root`` to the Parquet table ``target``.

    The file source remembers the paths it has seen in ``checkpoint``, so it does not see that a
    known file has changed; ``vault.staleness`` finds those. Each batch is one atomic append,
    keyed by its number, so that a batch that is repeated replaces itself.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)

    def write(batch: DataFrame, number: int) -> None:
        parse_notes(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_notes(spark: SparkSession, target: str) -> DataFrame:
    """The latest version of each path, where other writers have appended one."""
    rows = spark.read.option("basePath", target).parquet(target)
    newest = F.max_by(F.struct("*"), F.struct("mtime", "batch"))
    return rows.groupBy("path").agg(newest.alias("_note")).select("_note.*")


def follow(index: Index, folder: str, checkpoint: str, seconds: float = 60) -> StreamingQuery:
    """Keeps an index up to date with the notes below ``folder``, looking every ``seconds``: files added, changed and removed.

    A look compares the listing with the last commit, reads what differs and commits it. The state
    of the stream is that commit, so a look that is repeated after a failure finds nothing to do,
    and what a look that died had read is read again. A commit of another writer in between makes
    the next look do the work.
    """
    ticks = index.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def look(_batch: DataFrame, _number: int) -> None:
        try:
            index.update_vault(folder) if index.metadata() else index.build_vault(folder)
        except Conflict:
            pass

    writer = ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
