"""Registered queries over notes made of the tables: pages and their files, typed values, tasks, index, links, reports.

A customer is a note in a folder of its nation; an order is a note in the folder of its customer,
with properties, a link to the customer and two tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark import manual, outputs
from mdspark.functions.text import line_links, normalize_target
from mdspark.operators import graph, retrieval, tasks
from mdspark.plans.data_array import Pages
from mdspark.plans.expression import compile_expression, display
from mdspark.plans.script import compile_script
from mdspark.plans.task_query import TaskQuery
from mdspark.plans.views import View, query
from mdspark.queries import TODAY, _chunks, _expressions, _index, _native, _notes_index, _orders, _register, _table, _vectors
from mdspark.sources import pages as page_source
from mdspark.sources import vault
from mdspark.sources.index import Encoder, Index
from mdspark.storage import default_index, fingerprint

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- notes of customers and orders ----
_C, _O = "'n' || c_nationkey || '/c' || c_custkey || '.md'", "'c' || o_custkey || '/o' || o_orderkey || '.md'"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("*", _text("n", F.col("c_nationkey"), "/c", F.col("c_custkey"), ".md").alias("path"), _text("c", F.col("c_custkey")).alias("title"))


def _order_notes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("*", _text("c", F.col("o_custkey"), "/o", F.col("o_orderkey"), ".md").alias("path"), _text("o", F.col("o_orderkey")).alias("title"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("path", "title").unionByName(_order_notes(spark, d).select("path", "title"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Orders to customers by title, customers to their nation's neighbour by a relative path that half of them get wrong."""
    up = _order_notes(spark, d).select(F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), _text("c", F.col("o_custkey")).alias("raw_target"), (F.col("o_orderkey") % 5 == 0).alias("is_embed"))
    wrong = F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x")
    side = _customers(spark, d).select(F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), _text("../n", F.col("c_nationkey"), "/./c", F.col("c_custkey"), wrong, ".md").alias("raw_target"), F.lit(False).alias("is_embed"))
    links = up.unionByName(side).withColumn("heading", F.lit(None).cast("string")).withColumn("normalized_target", normalize_target(F.col("raw_target")))
    return graph.resolve(links, _notes(spark, d))


_NOTES_SQL = f"notes AS (SELECT {_C} AS path, 'c' || c_custkey AS title FROM customer UNION ALL SELECT {_O}, 'o' || o_orderkey FROM orders)"
_LINKS_SQL = f"""links AS (SELECT {_O} AS source_path, 'c' || o_custkey AS raw_target, o_orderkey % 5 = 0 AS is_embed, {_C} AS target_path FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT {_C}, '../n' || c_nationkey || '/./c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END || '.md', false, CASE WHEN c_custkey % 2 = 0 THEN {_C} END FROM customer)"""


@_register("links_resolve_large", f"WITH {_LINKS_SQL} SELECT source_path, raw_target, target_path FROM links")
def links_resolve_large(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("source_path", "raw_target", "target_path")


@_register("links_unresolved_large", f"WITH {_LINKS_SQL} SELECT source_path FROM links WHERE target_path IS NULL")
def links_unresolved_large(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved(_links(spark, d)).select("source_path")


@_register("outlinks", f"WITH {_LINKS_SQL} SELECT raw_target, target_path FROM links WHERE source_path = (SELECT min({_O}) FROM orders)")
def outlinks(spark: SparkSession, d: str) -> DataFrame:
    first = _order_notes(spark, d).agg(F.min("path")).first()[0]
    return graph.outlinks(_links(spark, d), first).select("raw_target", "target_path")


@_register("backlinks_large", f"WITH {_LINKS_SQL} SELECT DISTINCT source_path FROM links WHERE target_path = (SELECT {_C} FROM customer ORDER BY c_custkey DESC LIMIT 1)")
def backlinks_large(spark: SparkSession, d: str) -> DataFrame:
    last = _customers(spark, d).orderBy(F.desc("c_custkey")).first().path
    return graph.backlinks(_links(spark, d), last)


@_register("graph_bfs_large", f"""WITH {_LINKS_SQL}, e AS (SELECT source_path AS a, target_path AS b FROM links WHERE target_path IS NOT NULL UNION SELECT target_path, source_path FROM links WHERE target_path IS NOT NULL),
s AS (SELECT min({_O}) AS p FROM orders), h1 AS (SELECT DISTINCT b AS p FROM e JOIN s ON a = p WHERE b NOT IN (SELECT p FROM s)),
h2 AS (SELECT DISTINCT b AS p FROM e JOIN h1 ON a = p WHERE b NOT IN (SELECT p FROM s) AND b NOT IN (SELECT p FROM h1))
SELECT p AS path, 0 AS hop FROM s UNION ALL SELECT p, 1 FROM h1 UNION ALL SELECT p, 2 FROM h2""")
def graph_bfs_large(spark: SparkSession, d: str) -> DataFrame:
    first = _order_notes(spark, d).agg(F.min("path")).first()[0]
    return graph.neighbourhood(_links(spark, d), first, 2)


@_register("link_index", f"""WITH {_NOTES_SQL}, {_LINKS_SQL}, o AS (SELECT source_path AS path, count(*) AS n, count_if(is_embed) AS e, min(coalesce(title, raw_target)) AS shown FROM links LEFT JOIN notes ON target_path = notes.path GROUP BY 1),
b AS (SELECT target_path AS path, count(*) AS k FROM links WHERE target_path IS NOT NULL GROUP BY 1) SELECT path, coalesce(n, 0) AS n_links, coalesce(e, 0)::BIGINT AS n_embeds, coalesce(k, 0) AS n_backlinks, shown FROM o FULL JOIN b USING (path)""")
def link_index(spark: SparkSession, d: str) -> DataFrame:
    rows = page_source.link_index(_links(spark, d), _notes(spark, d))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("path", size("links").alias("n_links"), size("embeds").alias("n_embeds"), size("backlinks").alias("n_backlinks"), F.array_min(F.transform("links", lambda x: x["display"])).alias("shown"))


# ---- pages ----
def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages: two tags, and a link to the customer."""
    rows = _table(spark, d, "orders")
    status, urgency = _text("status/", F.lower("o_orderstatus")), F.lower(F.substring("o_orderpriority", 3, 100))
    link = F.struct(_text("n/c", F.col("o_custkey"), ".md").alias("path"), _text("c", F.col("o_custkey")).alias("display"), F.lit(False).alias("embed"))
    return page_source.from_table(rows, _text("c", F.col("o_custkey"), "/o", F.col("o_orderkey"), ".md"), tags=F.array(status, urgency), links=F.array(link), size=F.col("o_orderkey"))


def _page_values(name: str, columns: dict[str, tuple[str, str]], frame=None, table: str = "orders", key: str = "o_orderkey") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pages = (frame or _pages)(spark, d)
        out = []
        for alias, (source, _) in columns.items():
            x = compile_expression(source, pages, now="2024-03-01 12:00:00")
            out.append((F.date_format(x.column, _STAMP) if x.kind == "date" else F.to_json(x.column) if x.kind in ("list", "object", "link") else display(x) if x.kind == "any" else x.column).alias(alias))
        return pages.select(key, *out)

    _register(name, f"SELECT {key}, {', '.join(f'{sql} AS {alias}' for alias, (_, sql) in columns.items())} FROM {table}")(run)


_page_values("page_file", {
    "a": ("file.name", "'o' || o_orderkey"), "b": ("file.folder", "'c' || o_custkey"), "c": ("file.path", _O), "d": ("file.tags.length", "2::DOUBLE"), "e": ("file.ext + file.size", "'md' || o_orderkey"),
    "f": ("note.o_orderstatus", "o_orderstatus"), "g": ("file.properties.o_custkey", "o_custkey::DOUBLE"), "h": ("file.link.display", "'o' || o_orderkey"), "i": ("file.tags[1]", "lower(substr(o_orderpriority, 3))"),
})
_page_values("page_file_methods", {
    "a": ('file.hasTag("status")', "true"), "b": ('file.hasTag("status/f", "low")', "o_orderstatus = 'F' OR o_orderpriority = '5-LOW'"), "c": ('file.inFolder("c7")', "o_custkey = 7"), "d": ('file.hasLink("c9")', "o_custkey = 9"),
    "e": ('file.hasProperty("o_custkey") and not file.hasProperty("nope")', "true"), "f": ('file.asLink("x").display', "'x'"), "g": ("file.links[0].asFile().basename", "'c' || o_custkey"), "h": ('link("a/c9").linksTo("c9.md")', "o_custkey = 9"),
    "i": ("file.links[0] = link(\"c9.md\")", "o_custkey = 9"), "j": ('file("c7/o1.md").basename', "'o1'"), "k": ("file(file.path).folder", "'c' || o_custkey"),
})
_page_values("expr_objects", {
    "a": ('{"k": o_custkey, s: o_orderstatus}["k"]', "o_custkey::DOUBLE"), "b": ("{a: 1, b: o_orderstatus}.keys()", "'[\"a\",\"b\"]'"), "c": ("{a: o_orderstatus, b: 'q'}.values().join('+')", "o_orderstatus || '+q'"), "d": ("{}.isEmpty()", "true"),
    "e": ('contains({a: 1}, o_orderstatus)', "false"), "f": ("length({a: 1, b: 2})", "2::DOUBLE"), "g": ("[o_custkey, o_orderstatus].length", "2::DOUBLE"), "h": ("[o_orderstatus, 3].join()", "o_orderstatus || ',3.0'"), "i": ("[][0]", "NULL::VARCHAR"),
})
_page_values("expr_kinds", {
    "a": ('o_orderstatus.isType("string")', "true"), "b": ('o_custkey.isType("number")', "true"), "c": ('o_orderdate.isType("date") and [1].isType("list") and {a: 1}.isType("object")', "true"), "d": ('duration("1d").isType("duration")', "true"),
    "e": ('link("x").isType("link") and html("x").isType("html") and image("x").isType("image") and icon("x").isType("icon")', "true"), "f": ("nothing.isType('null') and nope(3).isTruthy() = false", "true"), "g": ("/a/.isType('regexp')", "true"),
    "h": ("o_custkey.toString()", "o_custkey::VARCHAR"), "i": ("if(o_custkey > 5, o_custkey, 'few')", "CASE WHEN o_custkey > 5 THEN o_custkey::VARCHAR ELSE 'few' END"),
})
_page_values("expr_durations", {
    "a": ('o_orderdate + (duration("1 day") + duration("2h"))', "strftime(o_orderdate + INTERVAL 26 HOUR, '%Y-%m-%d %H:%M:%S')"), "b": ('o_orderdate + duration("1 week") * 2', "strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d %H:%M:%S')"),
    "c": ('(duration("3d") - duration("1d")).days', "2::DOUBLE"), "d": ('o_orderdate - "1 month"', "strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S')"), "e": ('o_orderdate + duration("2 years")', "strftime(o_orderdate + INTERVAL 24 MONTH, '%Y-%m-%d %H:%M:%S')"), "f": ("o_orderdate - date('1995-01-01')", "(epoch_ms(o_orderdate) - 788918400000)::DOUBLE"),
    "g": ("(o_orderdate + '90s').second + o_orderdate.millisecond", "30::DOUBLE"), "h": ("duration('nothing') = null", "true"),
})
_page_values("expr_dates", {
    "a": ("o_orderdate.relative()", "(epoch_ms(TIMESTAMP '2024-03-01 12:00:00') - epoch_ms(o_orderdate)) // 86400000 || ' days ago'"), "b": ("date('2024-03-01T14:30:00').relative()", "'in 2 hours'"), "c": ("date('2024-03-01T11:59:00').relative()", "'1 minute ago'"),
    "d": ("o_orderdate.time()", "'00:00:00'"), "e": ("o_orderdate.date() = o_orderdate", "true"), "f": ('o_orderdate.format("DD.MM.YYYY [u]")', "strftime(o_orderdate, '%d.%m.%Y') || ' [u]'"), "g": ("o_orderdate.isEmpty()", "false"),
    "h": ('"2001-05-06T07:08:09+02:00".date().hour', "7::DOUBLE"), "i": ('"1996-01-01" > o_orderdate', "o_orderdate < TIMESTAMP '1996-01-01'"), "j": ("number(o_orderdate)", "epoch_ms(o_orderdate)::DOUBLE"),
})
_expressions("expr_text", "part", "p_partkey", {
    "a": ('p_name.replace(/[aeiou]/, "_")', "regexp_replace(p_name, '[aeiou]', '_')"), "b": ('p_name.replace(/[aeiou]/g, "_")', "regexp_replace(p_name, '[aeiou]', '_', 'g')"), "c": ("/RING$/i.matches(p_name)", "regexp_matches(lower(p_name), 'ring$')"),
    "d": ("p_name.title()", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"), "e": ('p_name.containsAny("ring", "bolt") or p_name.containsAll(["a", "e"])', "contains(p_name, 'ring') OR contains(p_name, 'bolt') OR (contains(p_name, 'a') AND contains(p_name, 'e'))"),
    "f": ('escapeHTML("<" + p_name + ">")', "'&lt;' || p_name || '&gt;'"), "g": ('icontains(p_name, "RI") and endswith(p_brand, "2")', "contains(p_name, 'ri') AND ends_with(p_brand, '2')"), "h": ('p_name.split(/ /).reverse().join()', "array_to_string(list_reverse(string_split(p_name, ' ')), ',')"),
    "i": ('join([p_name, p_brand])', "p_name || ', ' || p_brand"), "j": ('"ab".repeat(2) + p_name.trim().lower()', "'abab' || lower(p_name)"), "k": ('p_name.slice(-3)', "right(p_name, 3)"), "l": ("p_name != p_brand", "p_name <> p_brand"),
})
_expressions("expr_numbers", "part", "p_partkey", {
    "a": ("(-p_retailprice / 7).round(1)", "-round(floor(p_retailprice / 7 * 10 + 0.5) / 10, 6)"), "b": ("(p_size / 4).toFixed(2)", "printf('%.2f', p_size / 4)"), "c": ("(-p_size).abs()", "p_size::DOUBLE"), "d": ('number("x")', "NULL::DOUBLE"),
    "e": ("number(p_size > 10)", "CASE WHEN p_size > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), "f": ("min(p_size, 7, 'q')", "least(p_size, 7)::DOUBLE"), "g": ("random() < 1 and random() >= 0", "true"), "h": ("-7 % 4", "-3::DOUBLE"), "i": ("list(p_size).length", "1::DOUBLE"),
})
_expressions("expr_lists", "part", "p_partkey", {
    "a": ("[[p_size, 1], [2]].flat().length", "3::DOUBLE"), "b": ("[3, p_size, 1].sort()[0]", "CASE WHEN p_size = 1 THEN '1' ELSE '1.0' END"), "c": ("[1, 2, 3].slice(1)[0]", "2::DOUBLE"), "d": ("[1, p_size].map(value + index).reduce(acc * value, 1)", "(p_size + 1)::DOUBLE"),
    "e": ("[p_size, 50].containsAll(p_size, 50) and [p_size].containsAny([1, 2])", "p_size IN (1, 2)"), "f": ("[p_size, p_size, 2].unique().length", "CASE WHEN p_size = 2 THEN 1 ELSE 2 END::DOUBLE"), "g": ("[].isEmpty() and not [1].isEmpty()", "true"),
    "h": ("[1, 2, 3].filter(index > 0 and value != p_size).join('')", "CASE p_size WHEN 2 THEN '3.0' WHEN 3 THEN '2.0' ELSE '2.03.0' END"), "i": ("[].reduce(acc + value, 5)", "5::DOUBLE"),
})

_expressions("expr_mixed", "part", "p_partkey", {
    "a": ("[p_size, 9, 'a'].sort().join('-')", "CASE WHEN p_size <= 9 THEN p_size || '-9.0-a' ELSE '9.0-' || p_size || '-a' END"), "b": ("if(p_size > 25, 1, p_name)", "CASE WHEN p_size > 25 THEN '1.0' ELSE p_name END"), "c": ('p_size + "" + p_size * 2', "p_size || '' || p_size * 2 || '.0'"),
    "d": ("[p_name, p_size, 2].contains(2)", "true"), "e": ("if(p_size > 25, p_size, p_name) + 1", "CASE WHEN p_size > 25 THEN p_size + 1 || '.0' ELSE p_name || '1.0' END"), "f": ("if(p_size > 25, p_size, p_name).isType('number')", "p_size > 25"),
    "g": ("if(p_size > 25, p_size, p_name) > 30", "p_size > 30"), "h": ("if(p_size > 25, [p_size], p_name).length", "CASE WHEN p_size > 25 THEN '1.0' ELSE len(p_name) || '.0' END"), "i": ("[p_size, p_name, [1, 'x']].flat().map(value + '!').join(' ')", "p_size || '! ' || p_name || '! 1.0! x!'"),
    "j": ("[1, p_size, '1', p_size].unique().length", "CASE WHEN p_size = 1 THEN 2 ELSE 3 END::DOUBLE"), "k": ("if(p_size > 25, p_name, p_size).toString().length", "CASE WHEN p_size > 25 THEN len(p_name) ELSE len(p_size::VARCHAR) END::DOUBLE"), "l": ("if(p_size > 25, p_name, null).isEmpty()", "p_size <= 25"),
})
_expressions("expr_to_fixed", "part", "p_partkey", {
    "a": ("(p_size / 8).toFixed(2)", "printf('%.2f', p_size / 8)"), "b": ("(p_retailprice / 7).toFixed(3)", "printf('%.3f', p_retailprice / 7)"), "c": ("(-p_size / 2).toFixed()", "printf('%.0f', -p_size / 2)"), "d": ("(1.005).toFixed(2) + (2.5).toFixed(0) + (p_size).toFixed(1)", "'1.002' || p_size || '.0'"),
    "e": ("(p_retailprice / 1000000000).toFixed(12)", "printf('%.12f', p_retailprice / 1000000000)"), "f": ("(p_retailprice * 1000000000000).toFixed(1)", "printf('%.1f', p_retailprice * 1000000000000)"),
})


@_register("page_wiki_mixed", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey END AS path, c_custkey % 2 = 1 AS text, CASE WHEN c_custkey % 2 = 1 THEN 'nation ' || c_nationkey END AS plain,
CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'many' ELSE '2.5' END AS several, CASE WHEN c_custkey % 2 = 0 THEN 'a' END AS first, 'x' || c_custkey AS size FROM customer""")
def page_wiki_mixed(spark: SparkSession, d: str) -> DataFrame:
    even, third = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3
    nation = F.col("c_nationkey").cast("string")
    owner = F.when(even, F.concat(F.lit("[[n"), nation, F.lit("|Nation]]"))).otherwise(F.concat(F.lit("nation "), nation))
    several = F.when(third == 0, F.col("c_custkey").cast("string")).when(third == 1, F.lit('"many"')).otherwise(F.lit("2.5"))
    stored = F.concat(F.lit('{"k":'), F.col("c_custkey").cast("string"), F.lit(',"owner":"'), owner, F.lit('","several":'), several, F.lit(',"many":["'), F.when(even, F.lit("[[a]]")).otherwise(F.lit("a")), F.lit('","b"]}'))
    notes = _customers(spark, d).select("path", "title", F.lit("").alias("body"), stored.alias("frontmatter_json"), F.col("c_custkey").alias("size"))
    pages = page_source.from_notes(notes)
    shown = {"path": "owner.path", "text": "owner.isType('string')", "plain": "if(owner.isType('string'), owner, null)", "several": "several", "first": "many[0].path", "size": "'x' + file.size"}
    made = {k: compile_expression(v, pages) for k, v in shown.items()}
    return pages.select(F.col("k").alias("c_custkey"), *((F.when(x.column.isNotNull(), display(x)) if x.kind == "any" else x.column).alias(k) for k, x in made.items()))


@_register("page_wiki_values", "SELECT c_custkey, 'n' || c_nationkey AS path, 'Nation ' || c_nationkey AS display, 'x' AS plain, 2.0::DOUBLE AS n FROM customer")
def page_wiki_values(spark: SparkSession, d: str) -> DataFrame:
    owner = _text("[[n", F.col("c_nationkey"), "|Nation ", F.col("c_nationkey"), "]]")
    stored = F.to_json(F.struct(F.col("c_custkey").alias("k"), owner.alias("owner"), F.lit("x").alias("plain"), F.array(F.lit("[[a]]"), F.lit("[[b|c]]")).alias("many")))
    notes = _customers(spark, d).select("path", "title", F.lit("").alias("body"), stored.alias("frontmatter_json"))
    pages = page_source.from_notes(notes)
    value = lambda e: compile_expression(e, pages).column
    return pages.select(F.col("k").alias("c_custkey"), value("owner.path").alias("path"), value("owner.display").alias("display"), "plain", value("many.filter(value.display != 'q').length").alias("n"))


@_register("page_inline_tags", "SELECT doc_id, '[\"' || lang || '\",\"a/b\",\"' || source || '\"]' AS tags FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def page_inline_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    notes = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("t").alias("title"), _text("#a/b x#no #", F.col("source"), " #", F.col("lang")).alias("body"), F.to_json(F.struct(F.array("lang").alias("tags"))).alias("frontmatter_json"))
    return page_source.from_notes(notes).select(F.col("path").cast("long").alias("doc_id"), F.to_json("file.tags").alias("tags"))


@_register("note_lookup", "SELECT 'n' || c_nationkey || '/c' || c_custkey || '.md' AS path FROM customer WHERE c_custkey IN (1, 2)")
def note_lookup(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    one = _customers(spark, d).where("c_custkey = 1").first().path
    return page_source.lookup(notes, one.removesuffix(".md").upper()).unionByName(page_source.lookup(notes, "C2")).unionByName(page_source.lookup(notes, "nobody")).select("path")


# ---- views ----
@_register("base_this", "SELECT o_orderkey, o_totalprice > (SELECT arg_min(o_totalprice, o_orderkey) FROM orders) AS more, (SELECT 'o' || min(o_orderkey) FROM orders) AS here FROM orders")
def base_this(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    rows = page_source.with_this(pages, pages.orderBy("o_orderkey").first().path)
    return View(formulas={"more": "o_totalprice > this.o_totalprice"}, order=["o_orderkey", "formula.more", "this.file.name"]).table(rows).toDF("o_orderkey", "more", "here").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@_register("base_sort_formula", "SELECT 'o' || o_orderkey AS name, round(o_totalprice * 2, 4) AS twice, NULL::VARCHAR AS bad FROM orders ORDER BY o_totalprice * 2 DESC, o_orderpriority LIMIT 30")
def base_sort_formula(spark: SparkSession, d: str) -> DataFrame:
    view = View(formulas={"twice": "o_totalprice * 2", "bad": "((", "loop": "formula.loop + 1"}, sort=[("formula.twice", "desc"), ("note.o_orderpriority", "asc")], limit=30, order=["file.name", "formula.twice", "formula.bad"])
    return view.table(_pages(spark, d)).toDF("name", "twice", "bad").withColumn("twice", F.round("twice", 4))


@_register("base_group_rows", """WITH l AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500)
SELECT o_orderpriority AS key, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey) AS rows FROM l GROUP BY 1""")
def base_group_rows(spark: SparkSession, d: str) -> DataFrame:
    groups = View(sort=[("o_totalprice", "desc")], limit=500, order=["o_orderkey"], group_by="o_orderpriority", group_descending=True).groups(_orders(spark, d))
    return groups.select("key", "n", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("long").cast("string")), ",").alias("rows"))


@_register("base_group_flat", "SELECT year(o_orderdate) || '.0' AS key, o_orderkey FROM orders")
def base_group_flat(spark: SparkSession, d: str) -> DataFrame:
    view = View(formulas={"y": "o_orderdate.year"}, group_by="formula.y")
    return view.grouped(_orders(spark, d)).select("key", "o_orderkey")


@_register("base_summary_custom", "SELECT round(sum(p_retailprice), 4) AS total, max(p_size)::DOUBLE AS largest, 25.0::DOUBLE AS n FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25)")
def base_summary_custom(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "part").withColumn("path", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    view = View(sort=[("p_retailprice", "desc")], limit=25, summaries={"p_retailprice": "all", "p_size": "top", "p_partkey": "many"}, custom={"all": "values.reduce(acc + value, 0)", "top": "values.sort().reverse()[0]", "many": "values.length"})
    return view.summarise(rows).toDF("total", "largest", "n").withColumn("total", F.round("total", 4))


@_register("base_summary_flags", "SELECT count_if(p_size > 25) AS checked, count_if(NOT p_size > 25) AS unchecked, NULL::VARCHAR AS nothing FROM part")
def base_summary_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "part").withColumn("path", F.col("p_partkey").cast("string"))
    view = View(formulas={"big": "p_size > 25", "small": "not p_size <= 25"}, summaries={"formula.big": "Checked", "formula.small": "Unchecked", "p_name": "nothing"})
    return view.summarise(rows).toDF("checked", "unchecked", "nothing")


@_register("base_summary_date_texts", "SELECT (epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate)))::DOUBLE AS span, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def base_summary_date_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).withColumn("due", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return View(formulas={"day": "due"}, summaries={"due": "Range", "formula.day": "Latest"}).summarise(rows).toDF("span", "last")


# ---- TABLE, LIST, TASK ----
@_register("dql_words_in_texts", "SELECT 'a WHERE b' AS t, o_orderkey FROM orders WHERE o_orderstatus <> 'x FROM y' AND o_orderkey % 7 = 0")
def dql_words_in_texts(spark: SparkSession, d: str) -> DataFrame:
    out = query('TABLE WITHOUT ID "a WHERE b" AS t, o_orderkey WHERE o_orderstatus != "x FROM y" WHERE o_orderkey % 7 = 0', _orders(spark, d))
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@_register("dql_limit_then_group", "WITH l AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) SELECT o_orderstatus AS key, count(*)::DOUBLE AS n FROM l GROUP BY 1")
def dql_limit_then_group(spark: SparkSession, d: str) -> DataFrame:
    return query("TABLE key, rows.length AS n SORT o_totalprice DESC LIMIT 200 GROUP BY o_orderstatus", _orders(spark, d))


@_register("dql_task", "SELECT 'Part ' || o_orderkey AS w FROM orders WHERE o_orderkey % 2 = 1")
def dql_task(spark: SparkSession, d: str) -> DataFrame:
    rows = query('TASK WHERE is_done and list_marker = "*" SORT line', _orders(spark, d), tasks=_tasks(spark, d))
    return rows.select(F.regexp_extract("description", r"^(Part \d+)", 1).alias("w"))


@_register("dql_group_aggregates", """WITH o AS (SELECT *, 'o' || lpad(o_orderkey::VARCHAR, 9, '0') AS path FROM orders)
SELECT o_orderstatus AS key, count(*)::DOUBLE AS n, round(sum(o_totalprice) FILTER (o_totalprice > 1000), 2) AS total, (array_to_string(list(o_orderkey ORDER BY path)[1:3], ',')) AS firsts, count(DISTINCT o_custkey)::DOUBLE AS customers,
bool_or(o_orderpriority = '1-URGENT') AS urgent, (list(o_orderkey ORDER BY path) FILTER (o_totalprice > 200000))[1] AS dear FROM o GROUP BY 1 HAVING count(*) > 10""")
def dql_group_aggregates(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "orders").withColumn("path", F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))
    source = """TABLE key, rows.length AS n, rows.filter(value.o_totalprice > 1000).map(value.o_totalprice).reduce(acc + value, 0).round(2) AS total, rows.map(value.o_orderkey).slice(0, 3).join(',') AS firsts,
    rows.map(value.o_custkey).unique().length AS customers, rows.map(value.o_orderpriority).contains('1-URGENT') AS urgent, rows.filter(value.o_totalprice > 200000)[0].o_orderkey AS dear GROUP BY o_orderstatus WHERE rows.length > 10 SORT rows.length DESC"""
    return query(source, pages)


# ---- tasks ----
def _day() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def _task_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    mark = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", " ").otherwise("/")
    sign = F.element_at(F.array(*map(F.lit, "🔺⏫🔼🔽⏬")), F.substring("o_orderpriority", 1, 1).cast("int"))
    body = _text(
        "# Orders ##\n- [", mark, "] #task Order ", k, " [clerk:: C", F.col("o_custkey"), "] 📅 ", _day(), " ", sign, " 🆔 o", k, "\n",
        "  * [", F.when(k % 2 == 1, "x").otherwise("!"), "] Part ", k, " of [[c", F.col("o_custkey"), "|customer]] 🛫 ", _day(), " 🔁 every week 🏁 keep ⛔ o", k, " #a/b #c\n## Other\n1. [-] Drop ", k, " [due:: 2024-13-45]",
    )
    return _order_notes(spark, d).select("path", "title", body.alias("body"), F.to_json(F.struct(F.col("o_custkey").alias("customer"), _text("[[c", F.col("o_custkey"), "]]").alias("owner"))).alias("frontmatter_json"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.task_table(_notes_index(spark, d, "notes", lambda: _task_notes(spark, d)), parent=False, note_links=False)


_PRIORITY = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'highest' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'lowest' END"
_NUMBER = "CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 4 ELSE 5 END"
_T = f"""t AS (SELECT {_O} AS path, o_custkey, o_orderkey AS k, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m-%d') AS ds, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'TODO' ELSE 'IN_PROGRESS' END AS type,
  {_PRIORITY} AS priority, {_NUMBER} AS number FROM orders),
a AS (SELECT *, 2 AS line FROM t), b AS (SELECT *, 3 AS line FROM t), c AS (SELECT *, 5 AS line FROM t)"""


@_register("task_fields", f"""WITH {_T} SELECT path, line, '#task Order ' || k AS description, ds AS due, NULL AS start, 'C' || o_custkey AS clerk, 'o' || k AS id, '' AS on_completion, 'Order ' || k AS bare, '#task' AS tags, number AS number, 'Orders' AS heading FROM a
UNION ALL SELECT path, line, 'Part ' || k || ' of [[c' || o_custkey || '|customer]] #a/b #c', NULL, ds, NULL, NULL, 'keep', 'Part ' || k || ' of [[c' || o_custkey || '|customer]]', '#a/b,#c', 3, 'Orders' FROM b
UNION ALL SELECT path, line, 'Drop ' || k, '2024-13-45', NULL, NULL, NULL, '', 'Drop ' || k, '', 3, 'Other' FROM c""")
def task_fields(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select(
        "path", "line", "description", "due", "start", F.try_element_at("fields", F.lit("clerk")).alias("clerk"), "id", "on_completion", F.col("description_without_tags").alias("bare"), F.array_join("tags", ",").alias("tags"),
        F.col("priority_number").alias("number"), "heading",
    )


@_register("task_recurrence", f"""WITH {_T} SELECT path, line, line = 3 AS is_recurring, CASE WHEN line = 3 THEN 'every week' ELSE '' END AS recurrence_rule, CASE WHEN line = 3 THEN 'Recurring' ELSE 'Not Recurring' END AS recurring_group,
  CASE WHEN line = 3 THEN 'every week' ELSE 'None' END AS recurrence_group, CASE WHEN line <> 2 THEN 'Normal priority' ELSE ['Highest priority', 'High priority', 'Medium priority', '', 'Low priority', 'Lowest priority'][number + 1] END AS priority_group
  FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def task_recurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d)
    return rows.select("path", "line", "is_recurring", "recurrence_rule", "recurring_group", "recurrence_group", "priority_group")


@_register("task_status_registry", f"""WITH {_T} SELECT path, line, CASE type WHEN 'DONE' THEN 'Done' WHEN 'TODO' THEN 'Todo' ELSE 'In Progress' END AS name, type, CASE WHEN type = 'DONE' THEN ' ' ELSE 'x' END AS following, type = 'DONE' AS done FROM a
UNION ALL SELECT path, line, CASE WHEN k % 2 = 1 THEN 'Done' ELSE 'Important' END, CASE WHEN k % 2 = 1 THEN 'DONE' ELSE 'ON_HOLD' END, CASE WHEN k % 2 = 1 THEN ' ' ELSE '/' END, k % 2 = 1 FROM b UNION ALL SELECT path, line, 'Cancelled', 'CANCELLED', ' ', true FROM c""")
def task_status_registry(spark: SparkSession, d: str) -> DataFrame:
    rows = tasks.task_table(_notes_index(spark, d, "notes", lambda: _task_notes(spark, d)), statuses=["!=Important:on hold:/"], parent=False, note_links=False)
    return rows.select("path", "line", F.col("status_name").alias("name"), F.col("status_type").alias("type"), F.col("status_next_symbol").alias("following"), F.col("is_done").alias("done"))


@_register("task_files", f"""WITH {_T} SELECT path, line, 'c' || o_custkey || '/' AS folder, 'c' || o_custkey || '/' AS root, 'o' || k || '.md' AS filename, 'o' || k || CASE WHEN line = 5 THEN ' > Other' ELSE ' > Orders' END AS backlink, line - 1 AS line_number,
  CASE line WHEN 2 THEN '-' WHEN 3 THEN '*' ELSE '1.' END AS marker, line = 3 AS sub, 'c' || o_custkey || '.md' AS linked FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def task_files(spark: SparkSession, d: str) -> DataFrame:
    rows = tasks.task_table(_notes_index(spark, d, "notes", lambda: _task_notes(spark, d)), parent=False)
    return rows.select("path", "line", "file.folder", "file.root", "file.filename", "backlink", "line_number", F.col("list_marker").alias("marker"), F.col("is_sub_item").alias("sub"), F.array_join(F.transform("file.outlinks", lambda x: x["path"]), ",").alias("linked"))


@_register("task_outlinks", f"WITH {_T} SELECT path, line, 'c' || o_custkey || '.md' AS target, 'c' || o_custkey AS raw FROM b")
def task_outlinks(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("path", "line", F.explode("outlinks").alias("l")).select("path", "line", F.col("l.path").alias("target"), F.col("l.raw_target").alias("raw"))


@_register("task_parents", f"WITH {_T} SELECT path, line, CASE WHEN line = 3 THEN 2 END AS parent_line FROM (FROM a UNION ALL FROM b UNION ALL FROM c)")
def task_parents(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("path", "line", "parent_line")


@_register("task_dependencies", f"WITH {_T} SELECT path, line, line = 3 AND k % 2 = 0 AND type <> 'DONE' AS is_blocked, line = 2 AND k % 2 = 0 AND type <> 'DONE' AS is_blocking FROM (FROM a UNION ALL FROM b UNION ALL FROM c)")
def task_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return tasks.dependencies(_tasks(spark, d)).select("path", "line", "is_blocked", "is_blocking")


@_register("task_random", "SELECT 3 * count(*) AS n, 3 * count(*) AS other, true AS same FROM orders")
def task_random(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d).select(tasks.random_key(TODAY).alias("r"), tasks.random_key("1998-06-16").alias("s"), tasks.random_key(TODAY).alias("again"))
    return rows.agg(F.count_distinct("r").alias("n"), F.count_if(F.col("r") != F.col("s")).alias("other"), F.bool_and((F.col("r") == F.col("again")) & (F.col("r") >= 0)).alias("same"))


def _query(name: str, source: str, sql: str, columns: tuple[str, ...] = ("path", "line"), prepare=None, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = (prepare or (lambda x: x))(_tasks(spark, d))
        return TaskQuery(source, dt.date.fromisoformat(TODAY), **options).run(rows).select(*columns)

    _register(name, f"WITH {_T}, u AS (FROM a UNION ALL FROM b UNION ALL FROM c) {sql}")(run)


_SELECT = "SELECT path, line FROM u WHERE"
_query("task_has", "has depends on\nhas recurring\nno id\nhas start date\nno due date\nis recurring", f"{_SELECT} line = 3")
_query("task_blocked", "is blocked", f"{_SELECT} line = 3 AND k % 2 = 0 AND type <> 'DONE'", prepare=tasks.dependencies)
_query("task_blocking", "has blocking\nis not blocked", f"{_SELECT} line = 2 AND k % 2 = 0 AND type <> 'DONE'", prepare=tasks.dependencies)
_query("task_invalid_dates", "due date is invalid\nhas due date", f"{_SELECT} line = 5")
_query("task_starts_before", "starts before 1997-01-01\ndone", f"{_SELECT} CASE line WHEN 2 THEN type = 'DONE' WHEN 3 THEN k % 2 = 1 AND day < DATE '1997-01-01' ELSE true END")
_query("task_english_dates", "(due after 20th March 1997) AND (due before in 2 weeks) AND (due on or before June 3, 2001)", f"{_SELECT} line = 2 AND day > DATE '1997-03-20' AND day < DATE '1998-06-29'")
_query("task_weeks", "due in 1997-W10\nhappens on or after last year", f"{_SELECT} line = 2 AND day BETWEEN DATE '1997-03-03' AND DATE '1997-03-09'")
_query("task_paths", "root includes c1\nfolder includes 1/\nfilename includes 7.md\nheading includes ord\ndescriptionWithoutTags does not include #", f"{_SELECT} line < 5 AND contains('c' || o_custkey || '/', 'c1') AND contains(o_custkey || '/', '1/') AND k % 10 = 7")
_query("task_text_fields", "(recurrence includes WEEK) OR (onCompletion regex matches /^keep$/)\nid regex does not match /o/\ntags includes a/B", f"{_SELECT} line = 3")
_query("task_exclude_sub_items", "exclude sub-items\nstatus.name is not cancelled", f"{_SELECT} line = 2")
_query("task_type_checked", "(status.type is nonsense) OR (status.type is cancelled)", f"{_SELECT} line = 5")
_query("task_nested_conditions", "NOT ((done) OR (priority is below medium)) AND (has due date)", f"{_SELECT} line = 2 AND type <> 'DONE' AND number <= 2")
_query("task_layout_and_comments", "hide tags\nshort mode\nexplain {{! the\nrest }}\n# a comment\ndescription \\\n includes drop 1", f"{_SELECT} line = 5 AND starts_with('drop ' || k, 'drop 1')")
_query("task_global_query", "description includes order", f"{_SELECT} line = 2 AND type = 'TODO'", global_query="not done\nstatus.type is todo")
_query("task_placeholders", "folder includes {{query.file.folder}}\nfilename does not include {{query.file.filenameWithoutExtension}}\nexclude sub-items", f"{_SELECT} line <> 3 AND contains('c' || o_custkey || '/', 'c7/') AND NOT contains('o' || k || '.md', 'o1')", current="c7/o1.md")
_query("task_sort_tag", "sort by tag 2 reverse\nsort by id\nlimit to 40 tasks", "SELECT path, line FROM u ORDER BY line = 3 DESC, CASE WHEN line = 2 THEN 'o' || k END NULLS FIRST, k % 2 = 1, day > DATE '1998-06-15', path, line LIMIT 40")
_query("task_sort_dates", "exclude sub-items\nsort by due reverse\nsort by description\nlimit 50", "SELECT path, line FROM u WHERE line <> 3 ORDER BY line = 2 DESC, ds DESC, '#task Order ' || k LIMIT 50")
_query("task_sort_function", "filter by function task.isDone === false\nsort by function reverse task.description.length\nsort by path\nlimit 30", "SELECT path, line FROM u WHERE CASE line WHEN 2 THEN type <> 'DONE' WHEN 3 THEN k % 2 = 0 ELSE false END ORDER BY CASE line WHEN 2 THEN 12 + len(k::VARCHAR) ELSE 5 + len(k::VARCHAR) + 6 + len(o_custkey::VARCHAR) + 19 END DESC, path, line LIMIT 30")
_query("task_filter_function", "filter by function task.due.moment?.isSameOrBefore('1997-03-01') && task.tags.some(t => t.startsWith('#t'))\nfilter by function (task) => { const n = task.priorityNumber; if (n < 1) { return true; } return n === 2; }",
       f"{_SELECT} line = 2 AND day <= DATE '1997-03-01' AND number IN (0, 2)")
_query("task_callable", "filter by function odd", f"{_SELECT} line = 5", functions={"odd": lambda c: F.startswith(c["description"], F.lit("Drop"))})
_query("task_group_function", "exclude sub-items\ngroup by function task.due.format('YYYY [Q]') + task.status.symbol", "SELECT CASE WHEN line = 2 THEN strftime(day, '%Y Q') || CASE type WHEN 'DONE' THEN 'x' WHEN 'TODO' THEN ' ' ELSE '/' END ELSE '-' END AS group_0, path FROM u WHERE line <> 3", ("group_0", "path"))
_query("task_group_tags", "group by tags\ngroup by folder reverse", "SELECT CASE line WHEN 2 THEN '#task' WHEN 5 THEN '(No tags)' ELSE '#a/b' END AS group_0, 'c' || o_custkey || '/' AS group_1, line FROM u UNION ALL SELECT '#c', 'c' || o_custkey || '/', line FROM b", ("group_0", "group_1", "line"))
_query("task_group_dates", "group by due\nlimit groups to 1 task", "SELECT CASE line WHEN 2 THEN ds WHEN 5 THEN 'Invalid due date' ELSE 'No due date' END AS group_0 FROM u GROUP BY 1", ("group_0",))
_query("task_group_priority", "description includes order\ngroup by priority", "SELECT ['Highest priority', 'High priority', 'Medium priority', '', 'Low priority', 'Lowest priority'][number + 1] AS group_0, path FROM a", ("group_0", "path"))
_query("task_group_backlink", "filename includes o11\ngroup by backlink\ngroup by recurring\ngroup by filename", "SELECT 'o' || k || CASE WHEN line = 5 THEN ' > Other' ELSE ' > Orders' END AS group_0, CASE WHEN line = 3 THEN 'Recurring' ELSE 'Not Recurring' END AS group_1, 'o' || k AS group_2, line FROM u WHERE starts_with('o' || k, 'o11')", ("group_0", "group_1", "group_2", "line"))


@_register("task_diagnostics", f"""WITH {_T}, n AS (SELECT count(*) AS n FROM (SELECT type FROM a UNION ALL SELECT CASE WHEN k % 2 = 1 THEN 'DONE' ELSE 'TODO' END FROM b UNION ALL SELECT 'CANCELLED' FROM c) WHERE type IN ('DONE', 'CANCELLED'))
SELECT said, CASE WHEN said LIKE 'not understood%' THEN 0 ELSE n END AS n FROM n, (VALUES ('unknown sort field: sort by nope'), ('limit groups: there are no groups'), ('not understood: this is nothing')) v(said)""")
def task_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for source in ("done\nsort by nope\nlimit groups 3\nsort by clerk", "done\nthis is nothing"):
        asked = TaskQuery(source, dt.date.fromisoformat(TODAY))
        rows = asked.run(_tasks(spark, d)).agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, asked.diagnostics))).alias("said"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@_register("task_script_dates", f"""WITH {_T} SELECT path, CASE WHEN day < DATE '{TODAY}' THEN '%%1%% Overdue' WHEN day = DATE '{TODAY}' THEN '%%2%% Today' ELSE '%%3%% Future' END AS category,
  CASE WHEN day = DATE '{TODAY}' THEN 'today' WHEN day < DATE '{TODAY}' THEN (DATE '{TODAY}' - day) || CASE WHEN DATE '{TODAY}' - day = 1 THEN ' day' ELSE ' days' END || ' ago' ELSE 'in ' || (day - DATE '{TODAY}') || CASE WHEN day - DATE '{TODAY}' = 1 THEN ' day' ELSE ' days' END END AS near,
  strftime(day, '%A %-d %B %y') AS long, ds || 'T00:00:00.000Z' AS iso, ds || ' 00:00' AS clock, strftime(day, 'W%V') AS week, 'none' AS fallback FROM a""")
def task_script_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d).where("line = 2")
    value = lambda s: compile_script(s, rows, TODAY).column
    long = F.concat(value("task.due.format('dddd D MMMM ')"), F.substring(value("task.due.format('YYYY')"), 3, 2))
    return rows.select(
        "path", value("task.due.category.groupText").alias("category"), value("task.due.fromNow.name").alias("near"), long.alias("long"), value("task.due.toISOString()").alias("iso"),
        value("task.due.formatAsDateAndTime()").alias("clock"), value("task.due.format('[W]WW')").alias("week"), value("task.start.formatAsDate('none')").alias("fallback"),
    )


# ---- fluent arrays ----
def _dv(spark: SparkSession, d: str) -> Pages:
    return Pages(_pages(spark, d), views={"cheap": lambda dv, n: dv.pages().where(f"o_totalprice < {n}").map("file.name").array()})


@_register("array_pages", "SELECT o_orderkey FROM orders WHERE starts_with('c' || o_custkey || '/o' || o_orderkey || '.md', 'c1')")
def array_pages(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).pages('"c1"').array().select("o_orderkey")


@_register("array_pages_tag", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def array_pages_tag(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).pages("#low").array().select("o_orderkey")


@_register("array_page", f"SELECT {_O} AS path FROM orders WHERE o_orderkey = 5")
def array_page(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).page("o5").select("path")


@_register("array_map_sort_limit", "SELECT 'o' || o_orderkey AS value FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, 'c' || o_custkey || '/o' || o_orderkey || '.md' LIMIT 15")
def array_map_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).pages().where(lambda p: p.o_orderstatus == "O").sort("o_totalprice", "desc").limit(15).map("file.name").array()


@_register("array_flat_map_distinct", "SELECT DISTINCT unnest(['status/' || lower(o_orderstatus), lower(substr(o_orderpriority, 3))]) AS value FROM orders")
def array_flat_map_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).pages().flatMap("file.tags").distinct("value").array()


@_register("array_group", "SELECT '{\"k\":\"' || o_orderstatus || '\"}' AS key, count(*) AS n FROM orders WHERE o_custkey < 50 GROUP BY 1")
def array_group(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).pages().where("o_custkey < 50").groupBy("o_orderstatus").frame.select(F.col("_key").alias("key"), F.size("rows").cast("long").alias("n"))


@_register("array_distinct_by", "SELECT min_by(o_orderkey, 'c' || o_custkey || '/o' || o_orderkey || '.md') AS o_orderkey, o_orderstatus, o_orderpriority FROM orders GROUP BY 2, 3")
def array_distinct_by(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).pages().distinct(lambda p: F.concat(p.o_orderstatus, p.o_orderpriority)).array().select("o_orderkey", "o_orderstatus", "o_orderpriority")


@_register("array_output", """SELECT 'table' AS render, '{"n":"o' || o_orderkey || '","s":"' || o_orderstatus || '"}' AS value, 0::BIGINT AS position FROM orders WHERE o_custkey = 3
UNION ALL SELECT 'paragraph', 'end', 1 UNION ALL SELECT 'list', '{"value":"o' || o_orderkey || '"}', 2 FROM orders WHERE o_custkey = 4""")
def array_output(spark: SparkSession, d: str) -> DataFrame:
    dv = _dv(spark, d)
    dv.table(["n", "s"], dv.pages().where("o_custkey = 3"), ["file.name", "o_orderstatus"])
    dv.paragraph("end")
    dv.list(dv.pages().where("o_custkey = 4").map("file.name"))
    return dv.output()


@_register("array_view", "SELECT 'o' || o_orderkey AS value FROM orders WHERE o_totalprice < 5000")
def array_view(spark: SparkSession, d: str) -> DataFrame:
    return _dv(spark, d).view("cheap", 5000)


@_register("array_file_link", "SELECT 'a/b.md' AS path, 'b' AS display, false AS embed, '2020-05-06 00:00:00' AS day FROM region")
def array_file_link(spark: SparkSession, d: str) -> DataFrame:
    dv = Pages(_table(spark, d, "region").withColumn("path", F.col("r_name")))
    return dv.all.select(dv.fileLink("a/b.md").alias("l"), F.date_format(dv.date("2020-05-06"), _STAMP).alias("day")).select("l.*", "day")


@_register("page_tasks", f"SELECT {_O} AS path, 3::BIGINT AS n_tasks, '#task Order ' || o_orderkey AS first FROM orders")
def page_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = Pages(_order_notes(spark, d).select("path"), _tasks(spark, d)).with_tasks("description").frame
    return rows.select("path", F.size("tasks").cast("long").alias("n_tasks"), F.col("tasks")[0]["description"].alias("first"))


# ---- reading notes ----
@_register("note_parse", """SELECT 'n' || c_custkey || '.md' AS path, 'n' || c_custkey AS title, '{"area":"' || c_name || '","list":[1,"two",{"k":null}],"deep":{"x":true},"text":"a b\\n"}' AS frontmatter_json, 14 AS body_start_line, 3::BIGINT AS n_chunks,
'|H 1|H 2' AS headings, 'a/b:,c d.md:h,img.png:!,ref.md:' AS links, 'intro [[a/b|x]] [i](c%20d.md#h)' AS opening FROM customer""")
def note_parse(spark: SparkSession, d: str) -> DataFrame:
    head = _text("---\n# made\narea: ", F.col("c_name"), "\nlist:\n  - 1\n  - two\n  - k:\ndeep: {x: true}\ntext: >\n  a\n  b\n\n---\n")
    body = "intro [[a/b|x]] [i](c%20d.md#h)\r\n\r\n# H 1\r\nsome ![p](img.png) [out](https://x.y) [[#same]]\n## H 2 \n[r][1]\n\n[1]: ref.md\n# \n"
    files = _table(spark, d, "customer").select(_text("n", F.col("c_custkey"), ".md").alias("path"), F.encode(F.concat(head, F.lit(body)), "UTF-8").alias("content"))
    notes = vault.parse_notes(files)
    shown = F.array_join(F.transform("links", lambda x: F.concat(x["raw_target"], F.lit(":"), F.coalesce(x["heading"], F.lit("")), F.when(x["is_embed"], "!").otherwise(""))), ",")
    return notes.select(
        "path", "title", "frontmatter_json", "body_start_line", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: F.coalesce(c["heading"], F.lit(""))), "|").alias("headings"),
        shown.alias("links"), F.col("chunks")[0]["body"].alias("opening"),
    )


@_register("chunk_pack", r"""WITH p AS (SELECT doc_id, lang, string_split(trim(replace(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '. ', '.' || chr(10) || chr(10)), ' '), chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
packed AS (SELECT doc_id, lang, list_reduce(ps[2:], lambda done, x: CASE WHEN len(done[-1]) + len(x) > 2400 THEN list_append(done, x) ELSE list_append(done[:-2], done[-1] || chr(10) || chr(10) || x) END, [ps[1]]) AS chunks FROM p WHERE ps[1] <> '')
SELECT doc_id, (unnest(range(len(chunks))))::INTEGER AS ordinal, coalesce(lang, 'none') AS heading, sha256(trim(unnest(chunks), ' ')) AS digest FROM packed""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    body = _text("# ", F.coalesce("lang", F.lit("none")), "\n", F.replace(words, F.lit(". "), F.lit(".\n\n")), "\n")
    files = _table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.encode(body, "UTF-8").alias("content"))
    rows = vault.chunks(vault.parse_notes(files))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "ordinal", "heading", F.sha2("body", 256).alias("digest"))


@_register("line_links", "SELECT c_custkey, 'c' || c_custkey || '.md,x y.md' AS paths, 'h,' AS headings, 'false,true' AS embeds FROM customer")
def line_link_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer").select("c_custkey", line_links(_text("see [[./c", F.col("c_custkey"), "#h|z]] ![q](x%20y.md) [[#s]] [w](http://a.b)")).alias("l"))
    part = lambda k: F.array_join(F.transform("l", lambda x: F.coalesce(x[k].cast("string"), F.lit(""))), ",")
    return rows.select("c_custkey", part("path").alias("paths"), part("heading").alias("headings"), part("embed").alias("embeds"))


_native("native_objects", "part", "p_partkey", "p_size in [1, 2, '3', 4.0] or p_name = 'small ring'", "p_size IN (1, 2) OR p_name = 'small ring'")


@_register("native_title", "SELECT 'p' || p_partkey AS path, CASE WHEN p_size > 25 THEN p_name ELSE 't' END AS title FROM part WHERE p_size % 2 = 0")
def native_title(spark: SparkSession, d: str) -> DataFrame:
    from mdspark.engine import native_notes

    stored = F.when(F.col("p_size") > 25, F.to_json(F.struct("p_size", F.col("p_name").alias("title")))).otherwise(F.to_json(F.struct("p_size")))
    notes = _table(spark, d, "part").select(_text("p", F.col("p_partkey")).alias("path"), F.lit("t").alias("title"), F.when(F.col("p_size") % 2 == 0, stored).alias("frontmatter_json"))
    return native_notes("p_size exists", notes)


# ---- index ----
_TOKENS = r"tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM documents)"


def _bm25(terms: list[list[str]]) -> str:
    """DuckDB's BM25 over the phrases."""
    def count(p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter(t, lambda x: x = '{p[0]}'))"
        same = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len(t) + 1), lambda i: {same}))"

    n = range(len(terms))
    idf = ", ".join(f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END AS i{k}" for k in n)
    score = " + ".join(f"i{k} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / a))" for k in n)
    return f"""{_TOKENS}, tf AS (SELECT doc_id, len(t) AS dl, {', '.join(f'{count(p)} AS f{k}' for k, p in enumerate(terms))} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS a, {', '.join(f'count(*) FILTER (f{k} > 0) AS n{k}' for k in n)} FROM tf), idf AS (SELECT a, {idf} FROM st),
bm AS (SELECT doc_id, {score} AS score FROM tf, idf WHERE {' AND '.join(f'f{k} > 0' for k in n)})"""


def _searched(name: str, text: str, phrases: list[list[str]]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return retrieval.bm25_indexed(_index(spark, d), text, 20).select("chunk_id", F.round("score", 6).alias("score"))

    _register(name, f"WITH {_bm25(phrases)} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")(run)


_searched("bm25_index", "the and of", [["the"], ["and"], ["of"]])
_searched("bm25_index_repeated", "The THAT that", [["the"], ["that"], ["that"]])
_searched("bm25_index_phrase", "of_the that", [["of", "the"], ["that"]])
_searched("bm25_index_rare", "blees", [["blees"]])


@_register("index_postings", f"WITH {_TOKENS} SELECT w AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS w FROM tok) GROUP BY 1")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).table("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).cast("long").alias("tf"))


def _refreshed(spark: SparkSession, d: str) -> Index:
    """The index of an earlier state of the documents, of which a hundredth was different, missing or there in vain, brought up to date with what changed."""
    out, state = Index(spark, default_index(spark, d) + "-refreshed"), fingerprint(spark, _table(spark, d, "documents"))
    made = out.metadata()
    if not made or made["state"] != state:
        chunks = _chunks(spark, d).withColumn("content_hash", F.sha2("search_text", 256))
        note = lambda rows: rows.select("path", "title", F.lit(None).cast("string").alias("frontmatter_json"), F.lit(0).cast("long").alias("mtime"), "n_chars")
        changed, added = F.col("chunk_id") % 300 == 0, F.col("chunk_id") % 300 == 100
        other = F.concat(F.lit("the lost words of "), F.reverse("search_text"))
        before = chunks.where(~added).withColumn("search_text", F.when(changed, other).otherwise(F.col("search_text"))).withColumn("body", F.col("search_text"))
        gone = chunks.where(F.col("chunk_id") % 300 == 200).withColumn("path", F.concat("path", F.lit(".old"))).withColumn("chunk_id", -F.col("chunk_id"))
        before = before.unionByName(gone)
        out.build(before, note(before), source=d)
        now = chunks.where(changed | added)
        out.update(now, note(now), removed=gone.select("path"), state=state)
    return out


@_register("index_refresh", f"WITH {_TOKENS} SELECT w AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS w FROM tok) GROUP BY 1")
def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    return _refreshed(spark, d).table("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).cast("long").alias("tf"))


@_register("index_refresh_search", f"WITH {_bm25([['the'], ['and'], ['of']])} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def index_refresh_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_indexed(_refreshed(spark, d), "the and of", 20).select("chunk_id", F.round("score", 6).alias("score"))


@_register("index_refresh_notes", "SELECT 'doc-' || doc_id AS title, n_chars, 1::BIGINT AS n FROM documents")
def index_refresh_notes(spark: SparkSession, d: str) -> DataFrame:
    index = _refreshed(spark, d)
    chunks = index.table("chunks").groupBy("path").agg(F.count("*").alias("n"))
    return index.table("notes").join(chunks, "path").select("title", "n_chars", "n")


@_register("index_chunks", "SELECT doc_id AS chunk_id, 'doc-' || doc_id AS title, 0.0::DOUBLE AS score FROM documents")
def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).chunks().select("chunk_id", "title", "score")


@_register("index_pages", "SELECT 'doc-' || doc_id AS title, CASE WHEN lang = 'en' THEN json_object('lang', lang, 'source', source)::VARCHAR ELSE '{}' END AS frontmatter_json FROM documents WHERE source IS NOT NULL")
def index_pages(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).pages().where("NOT contains(path, 'nothing')").join(_chunks(spark, d).where("source IS NOT NULL").select("path"), "path", "left_semi").select("title", "frontmatter_json")


@_register("index_bodies", "SELECT doc_id AS chunk_id, len(text)::BIGINT AS n FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def index_bodies(spark: SparkSession, d: str) -> DataFrame:
    hits = _chunks(spark, d).orderBy(F.desc("n_chars"), "chunk_id").limit(12).select("chunk_id")
    return _index(spark, d).bodies(hits).select("chunk_id", F.char_length("body").cast("long").alias("n"))


@_register("index_statistics", "SELECT count(*) AS notes, count(*) AS chunks, count(*) AS links FROM documents")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).statistics()


@_register("index_status", "SELECT true AS has_index, count(*) AS notes, count(*) AS chunks, count(*) AS links, count_if(lang IS DISTINCT FROM 'en') AS unresolved_links, true AS index_stale, true AS embeddings_stale FROM documents")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    listing = index.table("notes").select("path", F.when(F.col("size") % 2 == 0, F.col("mtime")).otherwise(8).alias("mtime"), "size")
    return index.status("none", listing).select("has_index", "notes", "chunks", "links", "unresolved_links", "index_stale", "embeddings_stale")


@_register("embedding_upsert", "SELECT count(*) AS n, count_if(doc_id % 2 = 0) AS fresh FROM (SELECT max(doc_id % 2) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text)")
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = Index(spark, default_index(spark, d) + "-vectors")
    rows = _table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.max(F.col("doc_id") % 2).alias("odd"))
    vector = lambda x: F.array(F.lit(x).cast("float"), F.lit(0).cast("float"))
    made = rows.select("content_hash", "odd", F.lit("m").alias("model"), F.lit(2).alias("dimensions"), vector(1.0).alias("vector"))
    index.store_embeddings(made)
    index.store_embeddings(made.where("odd = 0").withColumn("vector", vector(2.0)))
    return index.embeddings().where("model = 'm'").agg(F.count("*").alias("n"), F.count_if(F.col("vector")[0] == 2).alias("fresh"))


@_register("encoder_equal_texts", "SELECT count(*) AS n, true AS same, 64 AS size FROM documents")
def encoder_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    made = Encoder().encode(docs, "text").groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("vector").alias("k"), F.max(F.size("vector")).alias("size"))
    return made.agg(F.sum("n").cast("long").alias("n"), (F.max("k") == 1).alias("same"), F.max("size").alias("size"))


_DOT = "vs AS (SELECT v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _hybrid(spark: SparkSession, d: str) -> retrieval.Pipeline:
    vector = _table(spark, d, "embeddings").where("vec_id = 0").first().embedding
    chunks = _chunks(spark, d)
    return retrieval.Pipeline(chunks, chunks, _vectors(spark, d), lambda _: list(vector), _index(spark, d))


@_register("rag_stage", f"WITH {_DOT} SELECT vec_id AS chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY vs.score DESC, vec_id) AS rank FROM vs JOIN documents ON doc_id = vec_id WHERE lang = 'en' QUALIFY rank <= 25")
def rag_stage(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).run("filter:lang = en", "rag:anything", limit=25).where("chunk_id >= 0").select("chunk_id", F.round("score", 6).alias("score"), "rank")


@_register("hybrid_stage", f"""WITH {_bm25([['the'], ['that']])}, {_DOT}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM vs JOIN documents ON doc_id = vec_id),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id AS chunk_id, round(sum(1.0 / (60 + r)), 6) AS score FROM u GROUP BY id""")
def hybrid_stage(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).run("bm25+rag:the that").select("chunk_id", F.round("score", 6).alias("score"))


@_register("search_alias", f"""WITH {_bm25([['the'], ['that']])}, {_DOT}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 40), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM vs QUALIFY r <= 40),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM u GROUP BY id) SELECT id AS chunk_id, round(f.score, 6) AS score, row_number() OVER (ORDER BY f.score DESC, id) AS rank FROM f JOIN documents ON doc_id = id QUALIFY rank <= 8""")
def search_alias(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(_hybrid(spark, d), "the that", 8).select("chunk_id", F.round("score", 6).alias("score"), "rank")


# ---- reports ----
@_register("output_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","x":null}' AS line FROM nation""")
def output_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("x"))
    return outputs.record_lines(rows)[0]


@_register("output_hits", f"WITH {_bm25([['that']])} SELECT coalesce(source || '/', '') || coalesce(lang || '/', '') || 'doc-' || doc_id || '.md (score=' || printf('%.6f', score) || ')' AS line FROM bm JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 5")
def output_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search(_hybrid(spark, d), "that", 5, "bm25")
    return outputs.hit_lines(hits, True).select(F.substring_index("line", "\n", 1).alias("line"))


@_register("output_paths", f"SELECT {_C} AS line FROM customer")
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    return outputs.note_paths(_customers(spark, d))


@_register("output_context", "SELECT 'p' || lpad(doc_id::VARCHAR, 6, '0') || '#h' || chr(10) || text AS line FROM documents WHERE text IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 3")
def output_context(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    hits = _table(spark, d, "documents").select(path.alias("path"), F.lit("h").alias("heading"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("rank"), F.col("text").alias("body"))
    return outputs.context_blocks(retrieval.context(hits.where("body IS NOT NULL"), 3, 1 << 30))


@_register("output_links", f"WITH {_LINKS_SQL} SELECT source_path || chr(9) || raw_target || chr(9) || coalesce(target_path, '<unresolved>') AS line FROM links")
def output_links(spark: SparkSession, d: str) -> DataFrame:
    return outputs.link_lines(_links(spark, d))


@_register("output_manual", "SELECT 16::BIGINT AS n, true AS aliased FROM region LIMIT 1")
def output_manual(spark: SparkSession, d: str) -> DataFrame:
    topics = outputs.manual_lines(spark).where(F.col("line").isin(manual.topics()))
    same = outputs.printed(outputs.manual_lines(spark, "dql")) == manual.render("dataview")
    return topics.agg(F.count("*").alias("n"), F.lit(same).alias("aliased"))


@_register("base_document", "SELECT 'o' || o_orderkey AS name FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_totalprice, o_orderkey LIMIT 12")
def base_document(spark: SparkSession, d: str) -> DataFrame:
    from mdspark.engine import base_view
    from mdspark.sources.yaml_subset import properties

    source = 'filters: o_orderstatus = "O"\nviews:\n  - filters: {and: ["o_totalprice > 100000"]}\n    sort:\n      - {property: o_totalprice, direction: ASC}\n    limit: 12\n    order: [file.name]\n'
    return base_view(properties(source)).table(_pages(spark, d), "o_orderkey").toDF("name")

