"""Registered queries of the reference's operators, with SQL of the same rows.

The driver's tables stand in for notes: a document is a chunk, an order is a task line, a row of
any table is a page whose columns are its properties.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.functions.text import collapse_path, inline_tags, normalize_target, search_tokens, snippet
from mdspark.operators import graph, retrieval, tasks
from mdspark.plans.expression import compile_expression, display
from mdspark.plans.native_filter import compile_filter
from mdspark.plans.task_query import TaskQuery
from mdspark.plans.views import View, query
from mdspark.sources import vault
from mdspark.sources.index import Index
from mdspark.storage import default_index, fingerprint

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TODAY = "1998-06-15"


def _register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- retrieval ----
def _chunks(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")))
    return _table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), path.alias("path"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("heading"),
        F.col("text").alias("body"), F.col("text").alias("search_text"), "lang", "source", "n_chars",
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def _vector0(spark: SparkSession, d: str) -> list[float]:
    return _table(spark, d, "embeddings").where("vec_id = 0").first().embedding


def _index(spark: SparkSession, d: str) -> Index:
    """The index of the documents; built once, and anew when the table has changed."""
    out = Index(spark, default_index(spark, d))
    chunks, state = _chunks(spark, d), fingerprint(spark, _table(spark, d, "documents"))
    made = out.metadata()
    if not made or made["state"] != state:
        chunks = chunks.withColumn("content_hash", F.sha2("search_text", 256))
        notes = chunks.select("path", "title", F.lit(7).cast("long").alias("mtime"), F.col("n_chars").alias("size"), F.when(F.col("lang") == "en", F.to_json(F.struct("lang", "source"))).alias("frontmatter_json"))
        links = chunks.select(F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), F.lit("x").alias("raw_target"), F.when(F.col("lang") == "en", F.col("path")).alias("target_path"))
        out.build(chunks, notes, links, source=d, state=state)
    return out


_BM25 = r"""tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM documents),
tf AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'and')) AS f1, len(list_filter(t, lambda x: x = 'of')) AS f2 FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM tf),
idf AS (SELECT a, CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0, CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1,
  CASE WHEN ln((n - n2 + 0.5) / (n2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n2 + 0.5) / (n2 + 0.5)) END AS i2 FROM st),
bm AS (SELECT doc_id, i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a)) AS score
  FROM tf, idf WHERE f0 > 0 AND f1 > 0 AND f2 > 0)"""
_DOT = "vs AS (SELECT v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@_register("bm25_topk", f"WITH {_BM25} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_indexed(_index(spark, d), "the and of", 10).select("chunk_id", F.round("score", 6).alias("score"))


@_register("bm25_without_index", f"WITH {_BM25.replace('strip_accents(lower(text))', 'lower(text)').replace('N}]', 'N}_]')} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_without_index(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_chunks(spark, d), "the and of", 10).select("chunk_id", F.round("score", 6).alias("score"))


@_register("bm25_restrict_filter", f"WITH {_BM25} SELECT doc_id AS chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY bm.score DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 1500")
def bm25_restrict_filter(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    hits = retrieval.Pipeline(chunks, chunks, index=_index(spark, d)).run("filter:lang = en and n_chars > 1500", "bm25:the and of")
    # ranks of what is asked for: ranking writes its rows, and bodies are not among them
    return retrieval.ranked(hits.select("chunk_id", "score")).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@_register("rank_then_filter_synthetic", f"""WITH {_BM25}, good AS (SELECT doc_id FROM documents WHERE source = 'src3')
SELECT doc_id AS chunk_id, round(score, 6) AS score FROM bm JOIN good USING (doc_id) UNION ALL SELECT -1, 0.0 FROM good ANTI JOIN bm USING (doc_id)""")
def rank_then_filter_synthetic(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return retrieval.Pipeline(chunks, chunks, index=_index(spark, d)).run("bm25:the and of", "filter:source = src3").select("chunk_id", F.round("score", 6).alias("score"))


@_register("vector_topk", f"WITH {_DOT} SELECT vec_id AS chunk_id, round(score, 6) AS score FROM vs ORDER BY vs.score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(_vectors(spark, d), _vector0(spark, d), 10).select("chunk_id", F.round("score", 6).alias("score"))


@_register("rrf_hybrid", f"""WITH {_BM25}, {_DOT}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 50),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM vs QUALIFY r <= 50), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT id AS chunk_id, round(sum(1.0 / (60 + r)), 6) AS score FROM u GROUP BY id""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    lists = [retrieval.bm25_indexed(_index(spark, d), "the and of", 50), retrieval.vector_search(_vectors(spark, d), _vector0(spark, d), 50)]
    return retrieval.fuse([retrieval.ranked(x, limit=50) for x in lists]).select("chunk_id", F.round("score", 6).alias("score"))


@_register("best_chunk_per_path", """SELECT source AS path, doc_id AS chunk_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""")
def best_chunk_per_path(spark: SparkSession, d: str) -> DataFrame:
    hits = _table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"), F.col("doc_id").alias("rank"))
    return retrieval.best_per_path(hits).select("path", "chunk_id")


@_register("context_budget", """WITH t AS (SELECT 'p' || lpad(doc_id::VARCHAR, 6, '0') AS path, n_chars::DOUBLE AS score, len(text) AS n FROM documents ORDER BY score DESC, path LIMIT 5),
r AS (SELECT *, 150000 - coalesce(sum(n + 7) OVER (ORDER BY score DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 7 AS room FROM t)
SELECT path, score, least(n, room)::BIGINT AS n FROM r WHERE room > 0""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    hits = _table(spark, d, "documents").select(path.alias("path"), F.lit(None).cast("string").alias("heading"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("rank"), F.col("text").alias("body"))
    return retrieval.context(hits, 5, 150_000).select("path", "score", F.char_length("text").cast("long").alias("n"))


@_register("snippet", r"""WITH p AS (SELECT doc_id, text AS b, greatest(strpos(lower(text), 'the') - 1, 0) AS pos FROM documents), q AS (SELECT *, greatest(pos - 90, 0) AS s, least(greatest(pos - 90, 0) + 180, len(b)) AS e FROM p)
SELECT doc_id, CASE WHEN len(b) <= 180 THEN replace(b, chr(10), ' ') ELSE (CASE WHEN s > 0 THEN '… ' ELSE '' END) || replace(substr(b, s + 1, e - s), chr(10), ' ') || (CASE WHEN e < len(b) THEN ' …' ELSE '' END) END AS snippet FROM q""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", snippet(F.col("text"), "the").alias("snippet"))


@_register("tokenize_terms", r"SELECT t AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents) GROUP BY t")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


# ---- native filters ----
def _native(name: str, table: str, key: str, source: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _table(spark, d, table)
        return df.where(compile_filter(source, df)).select(key)

    _register(name, f"SELECT {key} FROM {table} WHERE {sql}")(run)


_native("native_eq", "customer", "c_custkey", "c_mktsegment = BUILDING", "c_mktsegment = 'BUILDING'")
_native("native_ne_missing", "customer", "c_custkey", "no_such != 3 and c_nationkey != 3", "c_nationkey <> 3")
_native("native_range", "part", "p_partkey", "p_size >= 10 and p_size < 20 and p_retailprice > 950.5", "p_size >= 10 AND p_size < 20 AND p_retailprice > 950.5")
_native("native_contains", "part", "p_partkey", "p_name contains a", "contains(p_name, 'a')")
_native("native_in", "nation", "n_nationkey", "n_nationkey in [1, 3, 5]", "n_nationkey IN (1, 3, 5)")
_native("native_prefix_suffix", "orders", "o_orderkey", "o_orderpriority starts_with 1 or o_orderpriority ends_with LOW", "starts_with(o_orderpriority, '1') OR ends_with(o_orderpriority, 'LOW')")
_native("native_regex", "orders", "o_orderkey", "o_orderpriority matches '^[12]-'", "regexp_matches(o_orderpriority, '^[12]-')")
_native("native_exists_missing", "orders", "o_orderkey", "o_totalprice exists and nothing missing", "o_totalprice IS NOT NULL")
_native("native_bool", "supplier", "s_suppkey", "not (s_nationkey = 3 or s_acctbal > 0.0) or s_suppkey <= 5", "NOT (s_nationkey = 3 OR s_acctbal > 0) OR s_suppkey <= 5")


@_register("native_json_path", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 AND json_extract(props, '$.zz') IS NULL")
def native_json_path(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "events").withColumnRenamed("props", "frontmatter_json")
    return df.where(compile_filter("k > 50 and zz missing", df)).select("event_id")


@_register("native_lists", "SELECT doc_id FROM documents WHERE lang = 'en' OR source IN ('src1', 'src2')")
def native_lists(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return df.where(compile_filter("tags contains_all [en] or tags overlaps [src1, src2]", df)).select("doc_id")


# ---- views ----
def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").withColumn("path", F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))


@_register("base_filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW')")
def base_filter(spark: SparkSession, d: str) -> DataFrame:
    spec = {"and": [{"or": ['o_orderstatus == "F"', "o_totalprice > 200000"]}, {"not": 'o_orderpriority == "5-LOW"'}]}
    return View(filters=spec, order=["o_orderkey"]).table(_orders(spark, d))


@_register("base_formula_chain", "SELECT o_orderkey, round(o_totalprice * 2, 4) AS twice, round(o_totalprice * 2 + 1, 4) AS more FROM orders")
def base_formula(spark: SparkSession, d: str) -> DataFrame:
    rows = View(formulas={"more": "formula.twice + 1", "twice": "o_totalprice * 2"}).rows(_orders(spark, d))
    return rows.select("o_orderkey", F.round("formula_twice", 4).alias("twice"), F.round("formula_more", 4).alias("more"))


@_register("base_sort_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def base_sort(spark: SparkSession, d: str) -> DataFrame:
    return View(sort=[("o_orderpriority", "asc"), ("o_totalprice", "desc")], limit=25, order=["o_orderkey"]).table(_orders(spark, d))


@_register("base_group", "SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1")
def base_group(spark: SparkSession, d: str) -> DataFrame:
    return View(group_by="o_orderpriority").counts(_orders(spark, d))


_PARTS = {"count": "count(*)", "sum": "round(sum(p_retailprice), 4)", "average": "round(avg(p_retailprice), 6)", "min": "min(p_retailprice)", "max": "max(p_retailprice)", "range": "round(max(p_retailprice) - min(p_retailprice), 6)", "median": "round(median(p_retailprice), 6)", "stddev": "round(stddev_pop(p_retailprice), 6)", "unique": "count(DISTINCT p_retailprice)", "filled": "count(p_retailprice)", "empty": "count(*) - count(p_retailprice)"}
for _name, _expression in _PARTS.items():

    def _run(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        out = View(summaries={"p_retailprice": name}).summarise(_table(spark, d, "part").withColumn("path", F.col("p_partkey").cast("string")))
        c = F.col(f"p_retailprice_{name}")
        return out.select((F.round(c, 4 if name == "sum" else 6) if name in ("sum", "average", "range", "median", "stddev") else c).alias("value"))

    _register(f"base_summary_{_name}", f"SELECT {_expression} AS value FROM part")(_run)


@_register("base_summary_dates", "SELECT (epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate)))::DOUBLE AS span, min(o_orderdate)::VARCHAR AS first FROM orders")
def base_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    span = View(summaries={"o_orderdate": "Range"}).summarise(rows)
    return span.crossJoin(View(summaries={"o_orderdate": "Earliest"}).summarise(rows)).select(F.col("o_orderdate_range").alias("span"), F.date_format("o_orderdate_earliest", "yyyy-MM-dd HH:mm:ss").alias("first"))


@_register("dql_table", "SELECT o_orderkey AS id, upper(o_orderpriority) AS p FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def dql_table(spark: SparkSession, d: str) -> DataFrame:
    out = query("TABLE o_orderkey AS id, o_orderpriority.upper() AS p WHERE o_totalprice > 100000 SORT o_totalprice DESC LIMIT 20", _orders(spark, d))
    return out.select(F.col("id").cast("long").alias("id"), "p")


@_register("dql_from_folder", "SELECT doc_id FROM documents WHERE starts_with(source || '/', 'src1/') OR starts_with(source || '/', 'src1')")
def dql_folder(spark: SparkSession, d: str) -> DataFrame:
    return query('LIST FROM "src1"', _chunks(spark, d)).select(F.col("chunk_id").alias("doc_id"))


@_register("dql_from_tag", "SELECT doc_id FROM documents WHERE lang = 'de'")
def dql_tag(spark: SparkSession, d: str) -> DataFrame:
    return query("LIST FROM #de", _chunks(spark, d).withColumn("tags", F.array("lang"))).select(F.col("chunk_id").alias("doc_id"))


@_register("dql_flatten", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(line) > 400")
def dql_flatten(spark: SparkSession, d: str) -> DataFrame:
    docs = _chunks(spark, d).withColumn("lines", F.split("body", "\n"))
    return query("LIST FLATTEN lines AS line WHERE length(line) > 400", docs).select(F.col("chunk_id").alias("doc_id"), "line")


@_register("dql_group", "SELECT n_regionkey::VARCHAR || '' AS key, count(*) AS n FROM nation GROUP BY 1")
def dql_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "nation").withColumn("path", F.col("n_name"))
    return query("LIST GROUP BY n_regionkey", rows).select(F.col("key").cast("int").cast("string").alias("key"), F.size("rows").cast("long").alias("n"))


# ---- expressions ----
def _expressions(name: str, table: str, key: str, columns: dict[str, tuple[str, str]]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _table(spark, d, table)
        out = []
        for alias, (source, _) in columns.items():
            x = compile_expression(source, df, now="2024-03-01 12:00:00")
            c = F.round(x.column, 6) if x.kind == "number" else F.date_format(x.column, "yyyy-MM-dd HH:mm:ss") if x.kind == "date" else F.to_json(x.column) if x.kind == "list" else display(x) if x.kind == "any" else x.column
            out.append(c.alias(alias))
        return df.select(key, *out)

    _register(name, f"SELECT {key}, {', '.join(f'{sql} AS {alias}' for alias, (_, sql) in columns.items())} FROM {table}")(run)


_expressions("expr_string", "part", "p_partkey", {
    "a": ("p_name.upper()", "upper(p_name)"), "b": ("p_name.slice(1, 4)", "substr(p_name, 2, 3)"), "c": ('p_name.contains("a")', "contains(p_name, 'a')"), "d": ('p_name.replace("a", "_")', "replace(p_name, 'a', '_')"),
    "e": ('p_name + "!"', "p_name || '!'"), "f": ("p_name.length", "len(p_name)::DOUBLE"), "g": ('p_brand.split("#", 1).join("+")', "string_split(p_brand, '#')[1]"), "h": ("p_name.reverse()", "reverse(p_name)"),
    "i": ('startswith(p_brand, "Brand")', "starts_with(p_brand, 'Brand')"), "j": ('p_name.isEmpty() or p_size > 10', "p_name = '' OR p_size > 10"),
})
_expressions("expr_number", "part", "p_partkey", {
    "a": ("p_size * 2 + 1", "(p_size * 2 + 1)::DOUBLE"), "b": ("p_retailprice / 0", "NULL::DOUBLE"), "c": ("p_size % 7", "(p_size % 7)::DOUBLE"), "d": ("(p_retailprice / 3).round(2)", "round(floor(p_retailprice / 3 * 100 + 0.5) / 100, 6)"),
    "e": ("max(p_size, 10)", "greatest(p_size, 10)::DOUBLE"), "f": ("if(p_size > 25, 1, 2)", "CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"), "g": ("p_retailprice.floor() - p_retailprice.ceil()", "(floor(p_retailprice) - ceil(p_retailprice))::DOUBLE"),
    "h": ("not p_size = 3 && p_size >= 2", "NOT (p_size = 3) AND p_size >= 2"), "i": ('number("4.5") + p_size', "4.5::DOUBLE + p_size"),
})
_expressions("expr_date", "orders", "o_orderkey", {
    "a": ("o_orderdate.year", "year(o_orderdate)::DOUBLE"), "b": ("o_orderdate + duration('1 month')", "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S')"), "c": ("o_orderdate - 1995-01-01", "(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01'))::DOUBLE"),
    "d": ("o_orderdate > 1998-01-01", "o_orderdate > TIMESTAMP '1998-01-01'"), "e": ("o_orderdate.format('YYYY/MM')", "strftime(o_orderdate, '%Y/%m')"), "f": ("o_orderdate - duration('36h')", "strftime(o_orderdate - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S')"),
    "g": ("today().year + date('2020-05-06').day", "2030::DOUBLE"),
})
_expressions("expr_list", "nation", "n_nationkey", {
    "a": ("[n_nationkey, 3, 1].sort().join('-')", "CASE WHEN n_nationkey > 3 THEN '1.0-3.0-' || n_nationkey WHEN n_nationkey > 1 THEN '1.0-' || n_nationkey || '-3.0' ELSE n_nationkey || '-1.0-3.0' END"),
    "b": ("[1, 2, 3, 4].filter(value > n_nationkey).length", "greatest(4 - greatest(n_nationkey, 0), 0)::DOUBLE"), "c": ("[1, 2, n_nationkey].reduce(acc + value, 0)", "3 + n_nationkey || '.0'"), "d": ("[1, 2].map(value * n_nationkey)[1]", "2::DOUBLE * n_nationkey"),
    "e": ("[1, 1, 2].unique().length", "2::DOUBLE"), "f": ("[n_nationkey].contains(7)", "n_nationkey = 7"),
})


# ---- tasks ----
def _task_line() -> Column:
    mark = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", " ").otherwise("/")
    sign = F.when(F.startswith("o_orderpriority", F.lit("1")), "🔺").when(F.startswith("o_orderpriority", F.lit("2")), "⏫").when(F.startswith("o_orderpriority", F.lit("3")), "🔼").when(F.startswith("o_orderpriority", F.lit("4")), "🔽").otherwise("⏬")
    return F.concat(F.lit("- ["), mark, F.lit("] #task Order "), F.col("o_orderkey").cast("string"), F.lit(" 📅 "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), sign)


def _notes_index(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> Index:
    """An index of notes made of orders, without chunks; built once, and anew when the table has changed."""
    out, state = Index(spark, f"{default_index(spark, d)}-{name}"), fingerprint(spark, _table(spark, d, "orders"))
    made = out.metadata()
    if not made or made["state"] != state:
        chunks = spark.createDataFrame([], "chunk_id long, path string, title string, heading string, body string, search_text string, content_hash string")
        out.build(chunks, make(), source=d, state=state)
    return out


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    notes = lambda: _table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("# Orders\n"), _task_line()).alias("body"))
    return tasks.task_table(_notes_index(spark, d, "tasks", notes), parent=False, note_links=False)


_TASKS = """t AS (SELECT 'c' || o_custkey || '/' || o_orderkey AS path, '#task Order ' || o_orderkey AS description, strftime(o_orderdate, '%Y-%m-%d') AS due, o_orderdate::DATE AS day,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'TODO' ELSE 'IN_PROGRESS' END AS status_type,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'highest' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'lowest' END AS priority,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 4 ELSE 5 END AS priority_number FROM orders)"""


@_register("task_extract", f"WITH {_TASKS} SELECT path, 2 AS line, 'Orders' AS heading, description, due, priority, priority_number, status_type, status_type = 'DONE' AS is_done, due AS happens, 1::BIGINT AS n_tags FROM t")
def task_extract(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("path", "line", "heading", "description", "due", "priority", "priority_number", "status_type", "is_done", "happens", F.size("tags").cast("long").alias("n_tags"))


@_register("task_urgency", f"""WITH {_TASKS}, u AS (SELECT *, day - DATE '{TODAY}' AS n FROM t) SELECT path, round(CASE WHEN n <= -7 THEN 12.0 WHEN n >= 14 THEN 2.4 ELSE 8.8 - 0.457142857 * n END
  + CASE priority WHEN 'highest' THEN 9.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.9 WHEN 'low' THEN 0.0 ELSE -1.8 END, 6)::DOUBLE AS urgency FROM u""")
def task_urgency(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("path", F.round(tasks.urgency(TODAY), 6).alias("urgency"))


def _task_query(name: str, source: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return TaskQuery(source, dt.date.fromisoformat(TODAY)).run(_tasks(spark, d)).select("path")

    _register(name, f"WITH {_TASKS} SELECT path FROM t {sql}")(run)


_task_query("task_date_before", "not done\ndue before 1996-01-01", "WHERE status_type <> 'DONE' AND day < DATE '1996-01-01'")
_task_query("task_date_range", "due in 1997-Q2", "WHERE day BETWEEN DATE '1997-04-01' AND DATE '1997-06-30'")
_task_query("task_date_relative", "happens after next month", "WHERE day > DATE '1998-07-31'")
_task_query("task_priority", "priority is above low\npriority is not high", "WHERE priority_number < 4 AND priority <> 'high'")
_task_query("task_text", "description includes order 1\ntags includes #TASK", "WHERE contains(lower(description), 'order 1')")
_task_query("task_regex", "description regex matches /order \\d*7$/i", "WHERE regexp_matches(lower(description), 'order [0-9]*7$')")
_task_query("task_status", "status.type is IN_PROGRESS", "WHERE status_type = 'IN_PROGRESS'")
_task_query("task_bool_xor", "(done) XOR (priority is high)\nNOT (due before 1996-01-01)", "WHERE (status_type = 'DONE') <> (priority = 'high') AND NOT day < DATE '1996-01-01'")
_task_query("task_sort_limit", "not done\nsort by due\nsort by description\nlimit 20", "WHERE status_type <> 'DONE' ORDER BY due, description LIMIT 20")


@_register("task_group", f"WITH {_TASKS} SELECT status_type AS key, count(*) AS n FROM t GROUP BY 1")
def task_group(spark: SparkSession, d: str) -> DataFrame:
    out = TaskQuery("group by status.type", dt.date.fromisoformat(TODAY)).run(_tasks(spark, d))
    return out.groupBy(F.col("group_0").alias("key")).agg(F.count("*").alias("n"))


@_register("task_deps", """WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem), a AS (SELECT * FROM l WHERE l_linestatus = 'O')
SELECT l.l_orderkey, l.l_linenumber, l.l_linestatus = 'O' AND EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = l.l_orderkey AND a.l_linenumber = l.l_linenumber - 1) AS is_blocked,
  l.l_linestatus = 'O' AND EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = l.l_orderkey AND a.l_linenumber = l.l_linenumber + 1) AS is_blocking FROM (SELECT DISTINCT * FROM l) l""")
def task_deps(spark: SparkSession, d: str) -> DataFrame:
    name = lambda k: F.concat_ws("-", "l_orderkey", k)
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus").distinct()
    rows = rows.select("*", F.concat_ws("-", "l_orderkey", "l_linestatus").alias("path"), F.col("l_linenumber").alias("line"), name(F.col("l_linenumber")).alias("id"), F.array(name(F.col("l_linenumber") - 1)).alias("depends_on"), F.when(F.col("l_linestatus") == "O", "TODO").otherwise("DONE").alias("status_type"))
    return tasks.dependencies(rows).select("l_orderkey", "l_linenumber", "is_blocked", "is_blocking")


# ---- links and index ----
def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each customer links to its nation, and to a note that is not there."""
    customer, nation = _table(spark, d, "customer"), _table(spark, d, "nation")
    own = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".md"))
    notes = nation.select(F.concat(F.lit("nation/"), "n_name", F.lit(".md")).alias("path"), F.col("n_name").alias("title")).unionByName(customer.select(own.alias("path"), F.col("c_custkey").cast("string").alias("title")))
    to_nation = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(own.alias("source_path"), F.concat(F.lit("../nation/"), "n_name", F.lit(".md")).alias("raw_target"))
    lost = customer.select(own.alias("source_path"), F.concat(F.lit("none/"), F.col("c_custkey").cast("string"), F.lit("x")).alias("raw_target"))
    links = to_nation.unionByName(lost).withColumn("normalized_target", normalize_target(F.col("raw_target")))
    return graph.resolve(links, notes), notes


_LINKS = "SELECT 'customer/' || c_custkey || '.md' AS source_path, 'nation/' || n_name || '.md' AS target_path FROM customer JOIN nation ON c_nationkey = n_nationkey"


@_register("links_resolve", f"{_LINKS} UNION ALL SELECT 'customer/' || c_custkey || '.md', NULL FROM customer")
def links_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)[0].select("source_path", "target_path")


@_register("links_unresolved", "SELECT 'customer/' || c_custkey || '.md' AS source_path FROM customer")
def links_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved(_links(spark, d)[0]).select("source_path")


@_register("backlinks", f"SELECT source_path FROM ({_LINKS}) WHERE target_path = (SELECT min('nation/' || n_name || '.md') FROM nation)")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    first = _table(spark, d, "nation").agg(F.min(F.concat(F.lit("nation/"), "n_name", F.lit(".md")))).first()[0]
    return graph.backlinks(_links(spark, d)[0], first)


@_register("graph_bfs", f"""WITH e AS (SELECT source_path AS a, target_path AS b FROM ({_LINKS}) UNION SELECT target_path, source_path FROM ({_LINKS})), s AS (SELECT min('customer/' || c_custkey || '.md') AS p FROM customer),
h1 AS (SELECT DISTINCT b AS p FROM e JOIN s ON a = p), h2 AS (SELECT DISTINCT b AS p FROM e JOIN h1 ON a = p WHERE b NOT IN (SELECT p FROM s) AND b NOT IN (SELECT p FROM h1))
SELECT p AS path, 0 AS hop FROM s UNION ALL SELECT p, 1 FROM h1 UNION ALL SELECT p, 2 FROM h2""")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    first = _table(spark, d, "customer").agg(F.min(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".md")))).first()[0]
    return graph.neighbourhood(_links(spark, d)[0], first, 2)


@_register("graph_of_index", f"""WITH e AS (SELECT source_path AS a, target_path AS b FROM ({_LINKS}) UNION SELECT target_path, source_path FROM ({_LINKS})), s AS (SELECT max('nation/' || n_name || '.md') AS p FROM nation),
h1 AS (SELECT DISTINCT b AS p FROM e JOIN s ON a = p) SELECT p AS path, 0 AS hop FROM s UNION ALL SELECT p, 1 FROM h1""")
def graph_of_index(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of a nation, a hub, from the edges that an index keeps in buckets."""
    out, state = Index(spark, f"{default_index(spark, d)}-links"), fingerprint(spark, _table(spark, d, "customer"))
    made = out.metadata()
    if not made or made["state"] != state:
        links, notes = _links(spark, d)
        chunks = spark.createDataFrame([], "chunk_id long, path string, title string, heading string, body string, search_text string, content_hash string")
        out.build(chunks, notes, links.withColumn("ordinal", F.lit(0)), source=d, state=state)
    start = _table(spark, d, "nation").agg(F.max(F.concat(F.lit("nation/"), "n_name", F.lit(".md")))).first()[0]
    return graph.neighbourhood_of(out, start, 2)


@_register("staleness_diff", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'removed' ELSE 'modified' END AS change, doc_id::VARCHAR AS path FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 < 2")
def staleness_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    later = rows.where("doc_id % 3 <> 1").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1))
    return vault.staleness(later, rows.where("doc_id % 3 <> 0")).select("change", "path")


@_register("missing_embeddings_anti", "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("text").alias("search_text"))
    have = docs.where("doc_id % 2 = 0").select("content_hash", F.lit("m").alias("model"))
    return vault.missing_embeddings(docs, have, "m").select("content_hash")


@_register("tags_extract", r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, ' ', ' #'), '(?:^|[^A-Za-z0-9_])#([A-Za-z0-9_/-]+)', 1), lambda x: trim(x, '/')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(list_distinct(l))::BIGINT AS n, l[1] AS first, sha256(array_to_string(list_sort(list_distinct(l)), ' ')) AS digest FROM t WHERE text IS NOT NULL""".replace("SELECT doc_id, list_filter", "SELECT doc_id, text, list_filter"))
def tags_extract(spark: SparkSession, d: str) -> DataFrame:
    tags = inline_tags(F.replace("text", F.lit(" "), F.lit(" #")))
    rows = _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tags.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("digest"))


@_register("path_collapse", "SELECT doc_id, lower(source || '/doc-' || doc_id) AS path FROM documents")
def path_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", collapse_path(F.concat_ws("/", F.lit("."), "source", "lang", F.lit(".."), F.concat(F.lit("Doc-"), F.col("doc_id").cast("string")), F.lit("x"), F.lit(".."))).alias("path"))


def queries() -> dict[str, Query]:
    from mdspark import queries_notes  # noqa: F401  registers the others

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from mdspark import queries_notes  # noqa: F401

    return dict(_SQL)
