"""The command line: ``python -m mdspark --vault FOLDER COMMAND ...``. Results go to standard output, notes on them to standard error."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark import manual, outputs
from mdspark.engine import Engine
from mdspark.operators.retrieval import found_note
from mdspark.sources.index import Encoder


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mdspark", description=manual.render("overview").split("\n", 1)[1])
    out.add_argument("--vault", default=".", help="folder of the notes")
    out.add_argument("--db", default="", help="folder of the index; by default one named after the folder of the notes")
    out.add_argument("--json", action="store_true", help="rows as JSON")
    out.add_argument("--verbose", action="store_true", help="scores too")
    out.add_argument("--auto-threshold", type=int, default=20, help="changed files up to which the index is rebuilt by itself")
    commands = out.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    index = add("index")
    index.add_argument("--only", choices=["bm25", "embed"])
    search = add("search")
    search.add_argument("text")
    search.add_argument("--limit", type=int, default=8)
    search.add_argument("--engine", choices=["bm25", "rag", "bm25+rag"], default="bm25+rag")
    query = add("query")
    query.add_argument("source", nargs="?")
    query.add_argument("--file", help="a file below the folder that holds the query")
    query.add_argument("--language", default="native")
    query.add_argument("--limit", type=int, default=100)
    query.add_argument("--current", default="", help="the note that the query stands in")
    query.add_argument("--tasks-status", action="append", default=[], metavar="SYMBOL=NAME:TYPE:NEXT")
    query.add_argument("--tasks-global-filter", default="")
    query.add_argument("--tasks-global-query", default="")
    for name in ("backlinks", "links", "graph"):
        add(name).add_argument("note")
    commands.choices["graph"].add_argument("--depth", type=int, default=2)
    pipeline = add("pipeline")
    pipeline.add_argument("--stage", action="append", required=True)
    pipeline.add_argument("--limit", type=int, default=10)
    pipeline.add_argument("--context", action="store_true")
    pipeline.add_argument("--max-chars", type=int, default=1 << 30)
    add("status")
    for name in ("manual", "man"):
        add(name).add_argument("topic", nargs="?", default="all")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0, or 1 with a line on what was wrong."""
    asked = parser().parse_args(argv)
    try:
        if asked.command in ("manual", "man"):
            print(manual.render(asked.topic))
            return 0
        spark = spark or SparkSession.builder.appName("mdspark").getOrCreate()
        _run(asked, spark)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


def _run(asked: argparse.Namespace, spark: SparkSession) -> None:
    query = asked.command == "query"
    if query and (asked.source is None) == (asked.file is None):
        raise ValueError("a query is given as a text or with --file, and not both")
    if query and asked.language != "tasks" and (asked.tasks_status or asked.tasks_global_filter or asked.tasks_global_query):
        raise ValueError("--tasks options go with --language tasks")
    more = {"current": asked.current, "task_filter": asked.tasks_global_filter, "task_statuses": asked.tasks_status, "task_query": asked.tasks_global_query} if query else {}
    engine = Engine(spark, str(Path(asked.vault).resolve()), asked.db, auto_threshold=asked.auto_threshold, encoder=Encoder(), **more)
    if asked.command == "index":
        _print(outputs.json_rows(engine.index(asked.only)) if asked.json else outputs.status_lines(engine.index(asked.only)))
        return
    if asked.command != "status":
        engine.refresh()
    if asked.command == "status":
        rows = engine.status()
        _print(outputs.json_rows(rows) if asked.json else outputs.status_lines(rows))
    elif asked.command == "search":
        engine.index("embed")
        _hits(asked, engine.search(asked.text, asked.limit, asked.engine))
    elif query:
        result = engine.query_file(asked.file, asked.language, asked.limit) if asked.file else engine.query(asked.source, asked.language, asked.limit)
        rows, said = outputs.record_lines(result.rows, result.diagnostics)
        _print(outputs.note_paths(result.rows) if asked.language == "native" and not asked.json else rows)
        if result.summaries is not None:
            _print(outputs.json_rows(result.summaries))
        for line in said:
            print(line, file=sys.stderr)
    elif asked.command == "pipeline":
        if any(s.split(":")[0].strip() in ("rag", "bm25+rag") for s in asked.stage):
            engine.index("embed")
        hits = engine._pipeline().run(*asked.stage)
        n = hits.count()
        if n > asked.limit:
            print(found_note(n, asked.limit), file=sys.stderr)
        if asked.context:
            rows = engine.context(*asked.stage, limit=asked.limit, max_chars=asked.max_chars)
            _print(outputs.json_rows(rows) if asked.json else outputs.context_blocks(rows, asked.verbose), "\n\n")
        else:
            _hits(asked, engine.pipeline(*asked.stage, limit=asked.limit).withColumn("snippet", F.substring(F.coalesce("body", F.lit("")), 1, 180)))
    else:
        rows = {"backlinks": engine.backlinks, "links": engine.links}.get(asked.command, lambda n: engine.graph(n, asked.depth))(asked.note)
        lines = outputs.link_lines(rows) if asked.command == "links" else rows.select(F.col(rows.columns[0]).alias("line"))
        _print(outputs.json_rows(rows) if asked.json else lines)


def _hits(asked: argparse.Namespace, hits: DataFrame) -> None:
    shown = ["chunk_id", "path", "title", "heading", "score", "rank", "snippet"]
    _print(outputs.json_rows(hits.select(*shown)) if asked.json else outputs.hit_lines(hits, asked.verbose))


def _print(lines: DataFrame, between: str = "\n") -> None:
    text = outputs.printed(lines, between)
    if text:
        print(text)


if __name__ == "__main__":
    sys.exit(main())
