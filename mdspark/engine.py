"""The commands as one object over a folder of notes or an index of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark import manual
from mdspark.operators import graph, retrieval
from mdspark.operators import tasks as task_operators
from mdspark.plans import views
from mdspark.plans.data_array import Pages
from mdspark.plans.native_filter import compile_filter
from mdspark.plans.script import Script
from mdspark.plans.task_query import TaskQuery
from mdspark.sources import pages as page_source
from mdspark.sources import vault
from mdspark.sources.index import Encoder, Index
from mdspark.sources.yaml_subset import properties
from mdspark.storage import default_index


class Language(Protocol):
    """A query language: from an engine and a source text to rows."""

    def __call__(self, engine: Engine, source: str) -> Result: ...


@dataclass
class Result:
    rows: DataFrame
    diagnostics: list[str] = field(default_factory=list)
    summaries: DataFrame | None = None


@dataclass
class Engine:
    spark: SparkSession
    folder: str
    root: str = ""
    current: str = ""
    today: dt.date = field(default_factory=dt.date.today)
    task_filter: str = ""
    task_statuses: list[str] = field(default_factory=list)
    task_query: str = ""
    functions: dict[str, Script] = field(default_factory=dict)
    encoder: Encoder = field(default_factory=Encoder)
    languages: dict[str, Language] = field(default_factory=dict)
    #: Changed files up to which a stale index is rebuilt by itself.
    auto_threshold: int = 20

    def __post_init__(self) -> None:
        if self.current and (self.current.startswith("/") or ".." in PurePosixPath(self.current).parts):
            raise ValueError("the current note must lie in the folder")
        self._index = Index(self.spark, self.root or default_index(self.spark, self.folder))
        self.languages = {"native": _native, "tasks": _tasks, "base": _base, "dataview": _dataview} | self.languages

    def register(self, name: str, language: Language) -> None:
        self.languages[name] = language

    # ---- index ----
    def index(self, only: str | None = None) -> DataFrame:
        """Builds the index, the vectors, or both; the counts of what there is."""
        if only != "embed":
            self._index.build_vault(self.folder)
        if only != "bm25":
            self._index.embed_missing(self.encoder)
        return self._index.statistics()

    def changed(self) -> DataFrame:
        return vault.staleness(vault.listing(self.spark, self.folder), self._index.table("notes"))

    def refresh(self) -> bool:
        """Builds a missing index, or brings one up to date of which at most ``auto_threshold`` files have changed; only these are read."""
        if not self._index.metadata():
            self.index("bm25")
            return True
        n = self.changed().limit(self.auto_threshold + 1).count()
        if 0 < n <= self.auto_threshold:
            self._index.update_vault(self.folder)
        return 0 < n <= self.auto_threshold

    def update(self) -> int:
        """Brings the index up to date, however many files have changed; only these are read. How many they are."""
        if not self._index.metadata():
            self.index("bm25")
            return self._index.table("notes").count()
        return self._index.update_vault(self.folder)

    def status(self) -> DataFrame:
        return self._index.status(self.encoder.model, vault.listing(self.spark, self.folder))

    def manual(self, topic: str = "all") -> str:
        return manual.render(topic)

    # ---- tables ----
    def notes(self) -> DataFrame:
        return self._index.pages()

    def links_table(self) -> DataFrame:
        return self._index.table("links")

    def pages(self) -> DataFrame:
        out = page_source.from_notes(self._index.table("notes"), self.links_table())
        return page_source.with_this(out, self.current) if self.current else out

    def tasks(self) -> DataFrame:
        """The task table of the index for this filter and these statuses, with dependencies over all notes."""
        return task_operators.dependencies(task_operators.task_table(self._index, self.task_filter, self.task_statuses))

    # ---- commands ----
    def query(self, source: str, language: str = "native", limit: int | None = 100) -> Result:
        if language not in self.languages:
            raise ValueError(f"unknown language {language!r}; there are {', '.join(self.languages)}")
        result = self.languages[language](self, source)
        return result if limit is None else Result(result.rows.limit(limit), result.diagnostics, result.summaries)

    def query_file(self, name: str, language: str, limit: int | None = 100) -> Result:
        """A query that is in a file below the folder."""
        if name.startswith("/") or ".." in PurePosixPath(name).parts:
            raise ValueError(f"{name!r} does not lie in the folder")
        source = self.spark.read.text(f"{self.folder.rstrip('/')}/{name}", wholetext=True).first()
        return self.query(source[0] if source else "", language, limit)

    def script(self, program: Callable[[Pages], Any]) -> DataFrame:
        """Runs a program over the pages and gives what it shows."""
        dv = Pages(self.pages(), self.tasks(), self.current)
        program(dv)
        return dv.output()

    def _pipeline(self) -> retrieval.Pipeline:
        index = self._index.pinned()
        vectors = index.embeddings().where(F.col("model") == self.encoder.model)
        return retrieval.Pipeline(index.table("chunks"), index.table("notes").where("frontmatter_json IS NOT NULL"), vectors, self.encoder.query, index)

    def search(self, text: str, limit: int = 8, engine: str = "bm25+rag") -> DataFrame:
        return retrieval.search(self._pipeline(), text, limit, engine)

    def pipeline(self, *stages: str, limit: int = 10) -> DataFrame:
        return self._pipeline().run(*stages, limit=limit)

    def context(self, *stages: str, limit: int = 10, max_chars: int = 1 << 30) -> DataFrame:
        return retrieval.context(self._pipeline().run(*stages), limit, max_chars)

    def _path(self, note: str) -> str:
        found = page_source.lookup(self._index.table("notes"), note).first()
        if not found:
            raise ValueError(f"there is no note {note!r}, or its title is not the only one")
        return found["path"]

    def backlinks(self, note: str) -> DataFrame:
        return graph.backlinks_of(self._index, self._path(note))

    def links(self, note: str) -> DataFrame:
        return graph.outlinks(self.links_table(), self._path(note)).orderBy("ordinal")

    def graph(self, note: str, depth: int = 2) -> DataFrame:
        return graph.neighbourhood_of(self._index, self._path(note), depth)


def native_notes(source: str, notes: DataFrame) -> DataFrame:
    """(path, title) of notes with properties that fit, by path; a title among the properties that is a text is shown before the note's."""
    notes = notes.where("frontmatter_json IS NOT NULL")
    own = F.try_variant_get(F.try_parse_json("frontmatter_json"), "$.title", "variant")
    own = F.when(F.schema_of_variant(own) == "STRING", own.try_cast("string"))
    return notes.where(compile_filter(source, notes)).select("path", F.coalesce(own, "title").alias("title")).orderBy("path")


def _native(engine: Engine, source: str) -> Result:
    return Result(native_notes(source, engine._index.table("notes")))


def _tasks(engine: Engine, source: str) -> Result:
    query = TaskQuery(source, engine.today, engine.current, engine.task_query, engine.functions)
    return Result(query.run(engine.tasks()), query.diagnostics)


def base_view(document: Any) -> views.View:
    """The first view of a document, its filters after those of the document."""
    if document is not None and not isinstance(document, dict):
        raise ValueError("a base is a mapping")
    document = document or {}
    first = (document.get("views") or [{}])[0]
    group = first.get("groupBy") or {}
    group = {"property": group} if isinstance(group, str) else group
    both = [f for f in (document.get("filters"), first.get("filters")) if f is not None]
    sort = [(s.get("property") or s.get("column"), str(s.get("direction", "asc"))) for s in first.get("sort") or []]
    return views.View(
        filters=both or None, formulas={k: str(v) for k, v in (document.get("formulas") or {}).items()}, sort=[s for s in sort if s[0]], limit=first.get("limit"), order=list(first.get("order") or []),
        summaries=dict(first.get("summaries") or {}), custom=dict(document.get("summaries") or {}), group_by=group.get("property"), group_descending=str(group.get("direction", "")).lower() == "desc",
    )


def _base(engine: Engine, source: str) -> Result:
    view = base_view(properties(source))
    pages = engine.pages()
    rows = (view.groups(pages) if view.limit is not None else view.grouped(pages)) if view.group_by else view.table(pages)
    return Result(rows, summaries=view.summarise(pages) if view.summaries else None)


def _dataview(engine: Engine, source: str) -> Result:
    return Result(views.query(source, engine.pages(), tasks=engine.tasks()))
