"""Ranking over chunks: BM25, exact vectors, rank fusion, filters, and the ordered pipeline of such stages.

Chunks have chunk_id, path, title, heading, body and search_text; hits add score. Their order is
by tier (what a filter appends comes after all hits), score and chunk_id, and becomes a column
``rank`` where it is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mdspark.functions.text import query_phrases, query_tokens, search_tokens, snippet
from mdspark.operators.ordering import numbered
from mdspark.sources.index import K1, B, Index
from mdspark.storage import scratch

#: Fixed values of the ranking functions.
LEAST_IDF, RRF = 1e-6, 60
#: Blocks that give a search its first bound, and blocks that a condition names one by one.
FIRST, NAMED = 32, 4096
#: Rows of scores that are broadcast at most.
SMALL = 10_000


def _part(f: Column, n: Column, dl: Column, chunks: Column, average: Column) -> Column:
    idf = F.ln((chunks - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / average))


@dataclass
class Best:
    """The best chunks of a search, with how many blocks of postings were read, and how many hold all of its terms (if asked for)."""

    hits: DataFrame
    read: int
    blocks: int | None


def bm25_best(index: Index, query: str, limit: int, count: bool = False) -> Best:
    """The ``limit`` best chunks of a query whose tokens are one term each, from the blocks that may hold one.

    The heads of a term's blocks give each block a bound. The FIRST blocks of the highest bounds
    are read, and the last score of the best chunks in them is what a block's bound must reach for
    its lists to be read, too. The result is that of reading all.
    """
    index = index.pinned()
    phrases, made = query_phrases(query), index.metadata()
    terms = [p[0] for p in phrases]
    distinct = list(dict.fromkeys(terms))
    none = Best(index.spark.createDataFrame([], "chunk_id long, score double"), 0, 0)
    if not terms or not made or any(len(p) > 1 for p in phrases):
        return none
    heads = index.heads(distinct).persist()
    try:
        often = index.frequencies(distinct, heads)
        if any(often.get(t, 0) <= 0 for t in distinct):
            return none
        n = made["chunks"]
        idf = {t: math.log((n - often[t] + 0.5) / (often[t] + 0.5)) for t in distinct}
        weight = F.element_at(F.create_map(*(F.lit(x) for t in distinct for x in (t, terms.count(t) * (idf[t] if idf[t] > 0 else LEAST_IDF)))), F.col("term"))
        bounds = heads.groupBy("_segment", "block").agg(F.count("*").alias("k"), F.sum(F.col("impact") * weight).alias("bound")).where(F.col("k") == len(distinct))

        def scored(blocks: Column) -> DataFrame:
            return _term_scores(index, terms, often, blocks).orderBy(F.desc("score"), "chunk_id").limit(limit)

        first = bounds.orderBy(F.desc("bound"), "_segment", "block").limit(FIRST).collect()
        if len(first) < FIRST:
            return Best(scored(_in_blocks(first)), len(first), len(first))
        least = scored(_in_blocks(first)).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        # what a bound may lack by rounding
        needed = bounds.where(F.col("bound") >= least["score"] * (1 - 1e-9)) if least["n"] == limit else bounds
        named = needed.limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            return Best(scored(_in_blocks(named)), len(named), bounds.count() if count else None)
        spans = F.lit(False)
        for r in needed.groupBy("_segment").agg(F.min("block").alias("a"), F.max("block").alias("b")).collect():  # a row a segment
            spans = spans | ((F.col("_segment") == r["_segment"]) & F.col("block").between(r["a"], r["b"]))
        return Best(scored(spans), needed.count(), bounds.count() if count else None)
    finally:
        heads.unpersist()


def _term_scores(index: Index, terms: list[str], often: dict[str, int], blocks: Column | None = None) -> DataFrame:
    """(chunk_id, score) of the chunks that hold all terms, in the blocks that meet a condition; positions are not read."""
    made, distinct = index.metadata(), list(dict.fromkeys(terms))
    n, average = made["chunks"], made["average"] or 1.0
    of_term = [F.max(F.when(F.col("term") == t, F.col("freqs"))).alias(f"_f{k}") for k, t in enumerate(distinct)]
    rows = index.entries(distinct, blocks).groupBy("chunk_id").agg(F.max("dls").alias("_dl"), *of_term)
    score: Column = F.lit(0.0)
    for t in terms:
        score = score + _part(F.col(f"_f{distinct.index(t)}"), F.lit(often[t]), F.col("_dl"), F.lit(float(n)), F.lit(float(average)))
    rows = rows.where(" AND ".join(f"_f{k} IS NOT NULL" for k in range(len(distinct))))
    return rows.select("chunk_id", score.alias("score"))


def _in_blocks(rows: list) -> Column:
    condition = F.lit(False)
    for segment in sorted({r["_segment"] for r in rows}):
        condition = condition | ((F.col("_segment") == segment) & F.col("block").isin([r["block"] for r in rows if r["_segment"] == segment]))
    return condition


def bm25_indexed(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """(chunk_id, score) of the chunks that hold every phrase of the query, from the postings of its terms alone.

    A token of several terms is a phrase: they must follow one another. A phrase that the query
    repeats counts as often. With a limit, and no phrase of several terms, blocks of postings that
    hold none of the best chunks are not read.
    """
    index = index.pinned()
    phrases = query_phrases(query)
    made = index.metadata()
    none = index.spark.createDataFrame([], "chunk_id long, score double")
    if not phrases or not made:
        return none
    if all(len(p) == 1 for p in phrases):
        if limit is not None:
            return bm25_best(index, query, limit).hits
        words = [p[0] for p in phrases]
        often = index.frequencies(list(dict.fromkeys(words)))
        return _term_scores(index, words, often) if all(often.get(t, 0) > 0 for t in words) else none
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    terms = list(dict.fromkeys(t for p in distinct for t in p))
    places = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"_p{k}") for k, t in enumerate(terms)]
    rows = index.postings(terms).groupBy("chunk_id").agg(F.first("dl").alias("_dl"), *places)
    counts = []
    for k, phrase in enumerate(distinct):
        at = F.col(f"_p{terms.index(phrase[0])}")
        for step, term in enumerate(phrase[1:], 1):
            at = _followed(at, F.col(f"_p{terms.index(term)}"), step)
        counts.append(F.greatest(F.coalesce(F.size(at), F.lit(0)), F.lit(0)).alias(f"_f{k}"))
    found = rows.select("chunk_id", "_dl", *counts)
    # how many chunks have each phrase: one row, which all hits meet
    df = found.agg(*(F.count_if(F.col(f"_f{k}") > 0).alias(f"_n{k}") for k in range(len(distinct))))
    matched = found.where(" AND ".join(f"_f{k} > 0" for k in range(len(distinct)))).join(F.broadcast(df))
    chunks, average = F.lit(float(made["chunks"])), F.lit(float(made["average"] or 1))
    score: Column = F.lit(0.0)
    for p in phrases:
        k = distinct.index(list(p))
        score = score + _part(F.col(f"_f{k}"), F.col(f"_n{k}"), F.col("_dl"), chunks, average)
    hits = matched.select("chunk_id", score.alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "chunk_id").limit(limit)


def _followed(at: Column, following: Column, step: int) -> Column:
    return F.filter(at, lambda p: F.array_contains(following, p + step))


def bm25(chunks: DataFrame, query: str, limit: int | None = None, text: str = "search_text", key: str = "chunk_id") -> DataFrame:
    """(key, score) of the chunks that hold every token of the query, without an index; statistics are of all chunks.

    Reads all texts, so it is for tables that are searched once. A token that the query repeats counts as often. One pass counts tokens, without exploding
    them, and its numbers are written, as the statistics and the scores would each read the texts again, and conditions on counts part them once more;
    the statistics are one row, so nothing of the corpus is shuffled.
    """
    terms = query_tokens(query)
    if not terms:
        return chunks.select(key, F.lit(0.0).alias("score")).where("false")
    distinct = list(dict.fromkeys(terms))
    tokens = chunks.select(key, search_tokens(F.col(text)).alias("_t"))
    equals = lambda t: lambda x: x == F.lit(t)
    counts = [F.size(F.filter("_t", equals(t))).alias(f"_f{k}") for k, t in enumerate(distinct)]
    counted = tokens.select(key, F.size("_t").alias("_dl"), *counts)
    folder = scratch(chunks.sparkSession, "counts")
    counted.write.parquet(folder)
    tf = chunks.sparkSession.read.schema(counted.schema).parquet(folder)
    stats = tf.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *(F.count_if(F.col(f"_f{k}") > 0).alias(f"_n{k}") for k in range(len(distinct))))
    score: Column = F.lit(0.0)
    for t in terms:
        k = distinct.index(t)
        score = score + _part(F.col(f"_f{k}"), F.col(f"_n{k}"), F.col("_dl"), F.col("_n"), F.col("_avgdl"))
    matched = tf.where(" AND ".join(f"_f{k} > 0" for k in range(len(distinct))))
    hits = matched.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row
    return hits if limit is None else hits.orderBy(F.desc("score"), key).limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int | None = None, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """(key, score): exact dot product, accumulated in double precision; vectors of another dimension are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    hits = vectors.where(F.size(vector) == len(query)).select(key, dot.alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), key).limit(limit)


def ranked(hits: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    """With ``rank`` from 1, by score and chunk_id unless another order is given.

    A limited list is numbered at once, any other as ``numbered`` does.
    """
    order = order or (F.desc("score"), F.asc("chunk_id"))
    if limit is not None:
        return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered(hits, "rank", *order)


def fuse(rankings: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of lists with ``rank``: (key, score)."""
    parts = [r.select(key, (1.0 / (RRF + F.col("rank"))).alias("score")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("score").alias("score"))


def best_per_path(hits: DataFrame) -> DataFrame:
    """The best hit of each path; of equal scores the earlier rank, or the smaller chunk_id. One row a task of each path is shuffled."""
    earlier = -F.col("rank" if "rank" in hits.columns else "chunk_id")
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in hits.columns)), F.struct("score", earlier))
    return hits.groupBy("path").agg(best.alias("_h")).select("_h.*")


def context(hits: DataFrame, limit: int, max_chars: int) -> DataFrame:
    """(path, heading, score, text): best chunks within a budget of characters, headers included.

    ``limit`` comes before hits without a body are left out. The budget is used in order: a text
    is cut to what remains, an item whose header does not fit is skipped.
    """
    top = best_per_path(hits).orderBy(F.desc("score"), "path").limit(limit).where("body IS NOT NULL")
    header = F.char_length("path") + F.when(F.col("heading").isNull(), 0).otherwise(F.char_length("heading") + 1)
    item = F.struct((-F.col("score")).alias("o"), "path", "heading", "score", F.col("body").alias("text"), header.alias("h"))
    listed = top.agg(F.sort_array(F.collect_list(item)).alias("items"))  # at most ``limit`` items
    none = F.expr("cast(array() as array<struct<path: string, heading: string, score: double, text: string>>)")

    def step(acc: Column, x: Column) -> Column:
        room = acc["left"] - x["h"]
        text = F.substring(x["text"], F.lit(1), room)
        one = F.struct(x["path"], x["heading"], x["score"], text.alias("text"))
        taken = F.struct((room - F.char_length(text)).alias("left"), F.concat(acc["out"], F.array(one)).alias("out"))
        return F.when(room > 0, taken).otherwise(acc)

    begin = F.struct(F.lit(max_chars).alias("left"), none.alias("out"))
    return listed.select(F.inline(F.aggregate("items", begin, step, lambda a: a["out"])))


@dataclass
class Stage:
    name: str
    argument: str
    language: str | None = None

    @classmethod
    def parse(cls, spec: str) -> Stage:
        """``name[@language]:argument``"""
        name, colon, argument = spec.partition(":")
        name, _, language = name.strip().lower().partition("@")
        if not colon or not name or not argument.strip():
            raise ValueError(f"a stage is name:argument, not {spec!r}")
        return cls(name, argument.strip(), language or None)


@dataclass
class Pipeline:
    """Ordered stages over chunks. ``notes`` (path, title, ...) are what filters judge; ``embed`` gives a query's vector.

    With an ``index`` BM25 reads its postings instead of the texts. ``vectors`` have chunk_id and
    embedding, or content_hash and vector of ``model`` where the chunks have content_hash.
    """

    chunks: DataFrame
    notes: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    index: Index | None = None
    filters: dict[str, Callable[[str], Column]] = field(default_factory=dict)
    stages: dict[str, Callable[[DataFrame, Stage], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        from mdspark.plans.native_filter import compile_filter

        self.filters = {"native": lambda source: compile_filter(source, self.notes)} | self.filters
        self.stages = {"filter": self._filter, "bm25": self._bm25, "rag": self._rag, "bm25+rag": self._hybrid} | self.stages

    def run(self, *specs: str, limit: int | None = None) -> DataFrame:
        """Hits with ``tier``; with a limit also their rank, in order."""
        hits = self.chunks.select("chunk_id", "path", "title", "heading", "body").withColumn("score", F.lit(0.0)).withColumn("tier", F.lit(0))
        for stage in map(Stage.parse, specs):
            if stage.name not in self.stages:
                raise ValueError(f"unknown stage {stage.name!r}")
            if stage.language and stage.name != "filter":
                raise ValueError(f"stage {stage.name!r} takes no language")
            hits = self.stages[stage.name](hits, stage)
        return hits if limit is None else ranked(hits, *_order(), limit=limit)

    def _filter(self, hits: DataFrame, stage: Stage) -> DataFrame:
        language = stage.language or "native"
        if language not in self.filters:
            raise ValueError(f"unknown filter language {language!r}")
        good = self.notes.where(self.filters[language](stage.argument)).select("path", "title")
        kept = hits.join(good.select("path"), "path", "left_semi")
        # every matching note without a hit follows, without a chunk
        added = good.join(hits.select("path").distinct(), "path", "left_anti")
        added = added.select(
            F.lit(-1).cast("long").alias("chunk_id"), "path", "title", F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("body"), F.lit(0.0).alias("score"),
            F.lit(1).alias("tier"),
        )
        return kept.select(added.columns).unionByName(added)

    def _restricted(self, hits: DataFrame, scores: DataFrame) -> DataFrame:
        """Global scores of the chunks that are among the hits; statistics never see the restriction."""
        return hits.where("chunk_id >= 0").drop("score", "tier").join(scores, "chunk_id").withColumn("tier", F.lit(0))

    def _scores(self, query: str) -> DataFrame:
        return bm25_indexed(self.index, query) if self.index else bm25(self.chunks, query)

    def _similar(self, query: str) -> DataFrame:
        if self.vectors is None or self.embed is None:
            raise ValueError("stage rag needs vectors and an encoder")
        vectors = self.vectors
        if "content_hash" in vectors.columns and "chunk_id" not in vectors.columns:
            waiting = self.chunks.join(vectors.select("content_hash"), "content_hash", "left_anti")
            if waiting.limit(1).count():
                raise ValueError("some chunks have no vector yet; embed what is missing first")
            vectors = self.chunks.select("chunk_id", "content_hash").join(vectors.select("content_hash", F.col("vector").alias("embedding")), "content_hash")
        return vector_search(vectors, self.embed(query))

    def _bm25(self, hits: DataFrame, stage: Stage) -> DataFrame:
        return self._restricted(hits, self._scores(stage.argument))

    def _rag(self, hits: DataFrame, stage: Stage) -> DataFrame:
        return self._restricted(hits, self._similar(stage.argument))

    def _hybrid(self, hits: DataFrame, stage: Stage) -> DataFrame:
        lists = [self._bm25(hits, stage), self._rag(hits, stage)]
        return self._restricted(hits, fuse([ranked(x.select("chunk_id", "score")) for x in lists]))


#: The order of hits.
ORDER = (F.asc, "tier"), (F.desc, "score"), (F.asc, "chunk_id"), (F.asc, "path")


def search(pipeline: Pipeline, query: str, limit: int = 8, engine: str = "bm25+rag") -> DataFrame:
    """One stage, with a snippet for each hit. A hybrid search fuses the best max(5 limit, 30) of each list, others fetch 3 limit."""
    stage = Stage.parse(f"{engine}:{query}")
    if engine == "bm25+rag":
        n = max(5 * limit, 30)
        lists = [pipeline._scores(query), pipeline._similar(query)]
        scores, most = fuse([ranked(x, limit=n) for x in lists]), 2 * n
    else:
        most = 3 * limit
        scores = (pipeline._scores(query) if stage.name == "bm25" else pipeline._similar(query)).orderBy(F.desc("score"), "chunk_id").limit(3 * limit)
    hits = pipeline.chunks.select("chunk_id", "path", "title", "heading", "body").join(F.broadcast(scores) if most <= SMALL else scores, "chunk_id").withColumn("tier", F.lit(0))
    return with_snippets(ranked(hits, *_order(), limit=limit), query)


def found_note(n: int, limit: int) -> str:
    """What is said of the number of results, and whether there are more than are shown."""
    return f"{n} results found, the first {limit} are shown" if n > limit else f"{n} results found"


def _order() -> tuple[Column, ...]:
    return tuple(way(name) for way, name in ORDER)


def with_snippets(hits: DataFrame, query: str) -> DataFrame:
    return hits.withColumn("snippet", snippet(F.coalesce("body", F.lit("")), query))
