"""The engine on small vaults, with expected values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mdspark.functions.text import collapse_path, inline_tags, normalize_target, query_tokens, search_tokens, snippet
from mdspark.operators import graph, retrieval, tasks
from mdspark.plans.expression import compile_expression
from mdspark.plans.native_filter import FilterError, compile_filter, scalar
from mdspark.plans.task_query import TaskQuery, date_range
from mdspark.plans.views import View, query
from mdspark.sources import vault
from mdspark.sources.yaml_subset import PropertyError, properties

PAGES = [
    ("Work/alpha.md", 8, 4.5, True, ["work", "project/alpha", "featured"], "Alpha Note", 120, "red", "2026-01-01"),
    ("Work/beta.md", 3, 2.0, False, ["work", "project/beta"], "Beta Note", 45, "blue", "2026-01-03"),
    ("Personal/gamma.md", 5, 3.5, True, ["personal", "archive"], "Gamma Note", 80, "red", "2026-01-05"),
    ("Personal/delta.md", 1, 1.0, False, ["personal"], "Delta Note", 10, "blue", "2026-01-07"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "path string, score int, rating double, active boolean, tags array<string>, title string, word_count int, color string, due string").withColumn("due_date", F.to_date("due"))


def names(df):
    return sorted(r.path for r in df.collect())


def value(df, source, **extra):
    return df.select(compile_expression(source, df, **extra).column.alias("v")).first().v


def test_summaries(pages):
    out = View(summaries={"rating": "Sum"}).summarise(pages).first()
    assert out.rating_sum == 11.0
    one = lambda p, s: View(summaries={p: s}).summarise(pages).first()[0]
    assert one("word_count", "Average") == 63.75 and one("score", "Median") == 4.0 and math.isclose(one("rating", "Stddev"), math.sqrt(1.8125))
    assert one("word_count", "Range") == 110 and one("due_date", "Range") == 518_400_000 and one("color", "Unique") == 2
    assert one("active", "Checked") == 2 and one("active", "Unchecked") == 2 and one("color", "Filled") == 4 and one("color", "nothing") is None


def test_views(pages):
    assert names(View(filters={"and": ['tags.contains("work")', {"not": "score > 5"}]}).rows(pages)) == ["Work/beta.md"]
    rows = View(formulas={"b": "formula.a + 1", "a": "score * 2"}, sort=[("score", "desc")], limit=2, order=["path", "formula.b"]).table(pages).collect()
    assert [r["formula.b"] for r in rows] == [17.0, 11.0]
    # a formula that hands an integer on, and one of several kinds
    view = View(formulas={"n": "score", "m": "if(active, score, title)"}, sort=[("formula.m", "desc")], order=["score", "formula.n", "formula.m"])
    rows = view.table(pages).select("score", "`formula.n`", F.to_json("`formula.m`")).collect()
    assert [tuple(r) for r in rows] == [(8, 8, "8"), (5, 5, "5"), (1, 1, '"Delta Note"'), (3, 3, '"Beta Note"')]
    assert [tuple(r) for r in View(group_by="if(active, score, title)").counts(pages).collect()] == [("5", 1), ("8", 1), ("Beta Note", 1), ("Delta Note", 1)]
    assert [r.key for r in View(group_by="score").counts(pages).collect()] == ["1", "3", "5", "8"]
    assert [tuple(r) for r in View(group_by="color").counts(pages).collect()] == [("blue", 2), ("red", 2)]


def test_queries(pages):
    out = query("TABLE title AS T, score + 1 AS s FROM \"Work\" WHERE score > 1 SORT score DESC LIMIT 1", pages).collect()
    assert [tuple(r) for r in out] == [("Alpha Note", 9.0)]
    assert query("LIST FLATTEN tags AS tag WHERE tag = 'work'", pages).count() == 2
    assert names(query("LIST FROM #archive", pages)) == ["Personal/gamma.md"]
    assert [(r.key, len(r.rows)) for r in query("LIST GROUP BY color", pages).orderBy("key").collect()] == [("blue", 2), ("red", 2)]
    with pytest.raises(ValueError):
        query("SELECT 1", pages)


def test_groups_as_aggregates(pages):
    """What is asked of a group is the same with and without its list, and the plan then brings no group together."""
    asked = {
        "rows.length": [2, 2], "rows.filter(value.score > 2).length": [1, 2], "rows.map(value.score * 2).reduce(acc + value, 1)": [9, 27], "rows.isEmpty()": [False, False],
        "rows.map(value.title).slice(0, 1).join()": ["Delta Note", "Gamma Note"], "rows[1].title": ["Beta Note", "Alpha Note"], "rows.filter(value.score > 3)[0].score + ''": ["", "5"], "rows.map(value.color).unique().length": [1, 1],
        "rows.map(value.title).contains('Beta Note')": [True, False], "rows.filter(value.active).map(value.score)[0]": [None, 5], "rows.length > 1 and key = 'red'": [False, True], "rows.map(value.score)[0] + rows.length": [3.0, 7.0],
    }
    for source, expected in asked.items():
        out = query(f"TABLE {source} AS v FROM \"\" GROUP BY color SORT key", pages)
        assert [r.v for r in out.collect()] == expected, source
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct(path" not in plan.replace("named_struct", "struct")
    many = query("TABLE key, rows.map(value.score).slice(0, 2) AS s WHERE score > 0 GROUP BY active SORT rows.length DESC LIMIT 1", pages)
    assert many.first().s == [1, 3]
    # what needs the list has it
    assert [r.v for r in query("TABLE rows.map(value.title).join('+') AS v GROUP BY color SORT key", pages).collect()] == ["Delta Note+Beta Note", "Gamma Note+Alpha Note"]
    assert [r.v for r in query("TABLE rows.map(value.score + index).reduce(acc * value, 1) AS v GROUP BY color SORT key", pages).collect()] == [4.0, 45.0]
    view = View(summaries={"score": "big", "rating": "all", "title": "list", "color": "kinds"}, custom={"big": "values.filter(value > 2).length + values.reduce(acc + value, 0)", "all": "values.map(value * 2).reduce(acc + value, 1)", "list": "values.slice(0, 2).join('+')", "kinds": "values.unique().length"}, sort=[("score", "asc")])
    assert tuple(view.summarise(pages).first()) == (20.0, 23.0, "Delta Note+Beta Note", 2.0)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("1 + 2 * 3", 7.0), ("10 / 0", None), ("-7 % 4", -3.0), ('"a" + 1', "a1.0"), ("not true or 1", True), ("4.5.round()", 5.0), ('"hello world".title()', "Hello World"), ('"abcdef".slice(-3, -1)', "de"),
        ("[3, 1, 2].sort().join('-')", "1.0-2.0-3.0"), ("[1, 2, 3].reduce(acc + value, 10)", 16.0), ("[1, 2, 3].map(value * index)[2]", 6.0), ("missing", None), ("missing = null", True), ("unknown(1)", None),
        ("'2026-01-03' > 2026-01-02", True), ("2026-01-03 - 2026-01-01", 172_800_000.0), ("(2026-01-31 + duration('1 month')).format('YYYY-MM-DD')", "2026-02-28"), ("if(0, 1, 2)", 2.0), ('"a,b,c".split(",", 2).length', 2.0),
        ('/b+/.matches("abbc")', True), ('"x".repeat(3)', "xxx"), ("min(3, 1, 2)", 1.0), ('escapeHTML("<a&b>")', "&lt;a&amp;b&gt;"), ("today().day", 15.0), ("[].isEmpty()", True), ("8 = 8.0 && !('' || 0)", True),
        # integers of the data are shown as such, numbers of expressions with a decimal place
        ("score.toString() + (score + 1)", "89.0"), ('"#" + word_count', "#120"), ("[score, 9, 'a'].join('-')", "8-9.0-a"), ("[10, 9, 'a'].sort().join('-')", "9.0-10.0-a"), ("[word_count, score, '3', true].sort().join()", "8,120,3,true"),
        ("(2.5).toFixed(0)", "2"), ("(3.5).toFixed()", "4"), ("(1.005).toFixed(2)", "1.00"), ("(-0.125).toFixed(2)", "-0.12"), ("score.toFixed(1)", "8.0"), ("(12345678901).toFixed(3)", "12345678901.000"),
        # values of several kinds
        ("if(score > 2, 1, 'x') + 1", 2.0), ("if(score > 2, 1, 'x').isType('number')", True), ("if(score < 2, 1, 'x').isType('string')", True), ("if(score > 2, 'abc', 1).length + ''", "3.0"), ("if(score > 2, due, score) > '2025-12-31'", True),
        ("[1, 'a', [2, 'b']].flat().length", 4.0), ("[1, 'a', 1, 'a', score].unique().length", 3.0), ("[1, 'a'].contains('a') and not [1, 'a'].contains('1')", True), ("[1, 'a', 2].filter(value.isType('number')).map(value * 2).join(' ')", "2.0 4.0"),
        ("if(true, {a: 1}, 'x').a + ''", "1.0"), ("number(if(true, '7', 1))", 7.0), ("if(false, 1, null).isEmpty()", True), ("if(score > 2, [1, 'x'], 2)[1] = 'x'", True), ("max(if(score > 2, 1, 'x'), 0)", 1.0), ("-if(score > 2, 1, 'x')", -1.0),
    ],
)
def test_expressions(pages, source, expected):
    got = value(pages.limit(1), source, now="2026-06-15 10:00:00")
    assert (got.toPython() if hasattr(got, "toPython") else got) == expected


def test_native_filters(spark):
    rows = [("a", '{"n":3,"f":3.0,"s":"2026-06-14","t":["x","y"],"o":{"k":1},"z":null,"not_x":true}'), ("b", '{"n":5,"s":"abc"}'), ("c", None), ("d", "broken")]
    df = spark.createDataFrame(rows, "path string, frontmatter_json string")
    find = lambda e: names(df.where(compile_filter(e, df)))
    assert find("n = 3") == ["a"] and find("f = 3") == [] and find("f = 3.0") == ["a"] and find("n != 3") == ["b", "d"]
    assert find("s >= 2026-06-01 and s < 2026-07-01") == ["a"] and find("t contains x") == ["a"] and find("t contains_all [x, y]") == ["a"] and find("t overlaps [q, y]") == ["a"]
    assert find("z exists") == ["a"] and find("z missing") == ["b", "d"] and find("o.k = 1") == ["a"] and find("n in [5, 7]") == ["b"] and find("not_x = true") == ["a"]
    assert find("s matches '^a.c$' or (n > 2 and not n > 4)") == ["a", "b"] and find("s starts_with ab") == ["b"]
    for bad in ("n =", "(n = 1", "s matches '['", "= 3", "n = 1 n"):
        with pytest.raises(FilterError):
            compile_filter(bad, df)
    assert scalar("2026-06-14") == "2026-06-14" and scalar("yes") == "yes" and scalar("[1, 'a b', true]") == [1, "a b", True]


@pytest.mark.parametrize(
    ("block", "expected"),
    [
        ("base: &b {x: 1, l: [a, b]}\nother: *b\nlist:\n  - &n 7\n  - *n", {"base": {"x": 1, "l": ["a", "b"]}, "other": {"x": 1, "l": ["a", "b"]}, "list": [7, 7]}),
        ("a: &m\n  k: v\nb:\n  <<: *m\n  z: 1", {"a": {"k": "v"}, "b": {"<<": {"k": "v"}, "z": 1}}), ("f: [&x one, *x, {k: *x}]", {"f": ["one", "one", {"k": "one"}]}),
        ("s: !!str 5\ni: !!int \"5\"\nf: !!float 5\nown: !thing {a: 1}\nt: !!str", {"s": "5", "i": 5, "f": 5.0, "own": {"!thing": {"a": 1}}, "t": ""}),
        ("h: 0x1F\no: 0o17\nb: 0b101\nz: 007\nbig: 123456789012345678901234567890\nneg: -0x10", {"h": 31, "o": 15, "b": 5, "z": "007", "big": 1.2345678901234568e29, "neg": -16}),
        ("i: .inf\nn: .NaN\nm: -.INF\nw: infinity\ne: 1e400", {"i": None, "n": None, "m": None, "w": "infinity", "e": "1e400"}),
        ('q: "first line\n  goes on\n\n  second paragraph \\\n  joined # no comment"\nnext: 1', {"q": "first line goes on\nsecond paragraph joined # no comment", "next": 1}),
        ("q: 'it''s\n  one\n\n\n  two'  # a comment\nnext: 1", {"q": "it's one\n\ntwo", "next": 1}), ("p: plain text\n  goes on\n\n  after a gap\nnext: 1", {"p": "plain text goes on\nafter a gap", "next": 1}),
        ('e: "\\x41\\u00e9\\U0001F600\\t\\e\\_\\/"', {"e": "Aé\U0001F600\t\x1b\xa0/"}), ("t: |2\n    two more\n  none\nu: >-\n  a\n  b\n\n  c\n", {"t": "  two more\nnone\n", "u": "a b\nc"}),
        ("day: 2026-01-01\nyes: no\nn: ~\nf: 1.50\nurl: http://a.b/c#d", {"day": "2026-01-01", "yes": "no", "n": None, "f": 1.5, "url": "http://a.b/c#d"}),
    ],
)
def test_properties(block, expected):
    assert properties(block) == expected


@pytest.mark.parametrize("block", ["a: 1\na: 2", "a: {b: 1, b: 2}", "a: *nowhere", 'a: "open', 'a: "\\q"', "a: !!int x", "a: [1, 2", 'a: "x" y', "- a\nb: 1"])
def test_properties_that_cannot_be_read(block):
    with pytest.raises(PropertyError):
        properties(block)


def test_text(spark):
    df = spark.createDataFrame([("格子暗号 Rust_1 CLI", "x" * 200 + " Needle " + "y" * 200, "./Foo\\Bar.md", "#a/ x#no (#b) #a")], "a string, b string, c string, d string")
    r = df.select(search_tokens(F.col("a")), snippet(F.col("b"), "needle"), normalize_target(F.col("c")), inline_tags(F.col("d")), collapse_path(F.lit("A/./b/../C"))).first()
    assert r[0] == ["格子", "子暗", "暗号", "rust_1", "cli"] == query_tokens("格子暗号 Rust_1 CLI")
    assert r[1].startswith("… ") and r[1].endswith(" …") and "Needle" in r[1] and len(r[1]) == 184
    assert r[2] == "foo/bar" and r[3] == ["a", "b"] and r[4] == "a/c"


NOTE = """---
area: work
tags: [x, y]
nested:
  k: 1
list:
  - a
  - 2
---
Intro [[Other|alias]] and ![pic](img/a.png) and [web](https://x.y).

# First
one

## Plan
- [ ] #task Ship 📅 2026-06-20 🔺 🆔 alpha
- [/] #task Review [due:: 2026-06-18] ⛔ alpha
  - [x] #task Nested ✅ 2026-06-19
- [-] #task Bad 📅 2026-13-40
"""


def test_vault(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "A" / "note.md").write_text(NOTE)
    (tmp_path / "A" / "Other.md").write_text("plain\n")
    (tmp_path / ".hidden" / "no.md").write_text("x")
    notes = vault.read_vault(spark, str(tmp_path)).cache()
    rows = {r.path: r for r in notes.collect()}
    assert sorted(rows) == ["A/Other.md", "A/note.md"] and rows["A/note.md"].frontmatter_json == '{"area":"work","tags":["x","y"],"nested":{"k":1},"list":["a",2]}'
    assert [(c.heading, c.body[:5]) for c in rows["A/note.md"].chunks] == [(None, "Intro"), ("First", "one"), ("Plan", "- [ ]")]
    links = graph.resolve(vault.links(notes), notes.select("path", "title"))
    assert sorted((r.raw_target, r.target_path, r.is_embed) for r in links.collect()) == [("Other", "A/Other.md", False), ("img/a.png", None, True)]
    assert [r.source_path for r in graph.backlinks(links, "A/Other.md").collect()] == ["A/note.md"]
    assert sorted((r.path, r.hop) for r in graph.neighbourhood(links, "A/Other.md").collect()) == [("A/Other.md", 0), ("A/note.md", 1)]
    chunks = vault.chunks(notes)
    hits = retrieval.Pipeline(chunks, notes).run("bm25:plain", "filter:area = work").collect()
    assert [(h.chunk_id, h.path) for h in hits] == [(-1, "A/note.md")]
    found = {r.description: r for r in tasks.dependencies(tasks.extract_tasks(notes)).collect()}
    assert found["#task Ship"].priority == "highest" and found["#task Ship"].due == "2026-06-20" and found["#task Ship"].heading == "Plan" and found["#task Ship"].is_blocking
    assert found["#task Review"].is_blocked and found["#task Review"].due == "2026-06-18" and found["#task Nested"].parent_line == found["#task Review"].line
    assert found["#task Bad"].due == "2026-13-40" and found["#task Ship"].line == 16
    run = lambda q: [r.description.split()[1] for r in TaskQuery(q, dt.date(2026, 6, 19)).run(tasks.dependencies(tasks.extract_tasks(notes))).collect()]
    assert run("not done\nsort by due") == ["Review", "Ship"] and run("due date is invalid") == ["Bad"] and run("exclude sub-items\ndone") == ["Bad"]
    assert run("(due on 2026-06-20) OR (description includes nested)\nsort by description") == ["Nested", "Ship"] and run("is blocked") == ["Review"] and run("nonsense line") == []


def test_dates():
    today = dt.date(2026, 6, 17)
    assert date_range("this week", today) == (dt.date(2026, 6, 15), dt.date(2026, 6, 21)) and date_range("2026-Q2", today) == (dt.date(2026, 4, 1), dt.date(2026, 6, 30))
    assert date_range("next month", today) == (dt.date(2026, 7, 1), dt.date(2026, 7, 31)) and date_range("2026-W25", today)[0] == dt.date(2026, 6, 15) and date_range("2026-13-40", today) is None
    assert date_range("last quarter", today) == (dt.date(2026, 1, 1), dt.date(2026, 3, 31)) and date_range("2026-06-20 2026-06-18", today) == (dt.date(2026, 6, 18), dt.date(2026, 6, 20))


def test_context_budget(spark):
    hits = spark.createDataFrame([("a", None, 3.0, 1, "x" * 50), ("b", "h", 2.0, 2, "y" * 50), ("a", None, 1.0, 3, "z"), ("c", None, 0.5, 4, "w")], "path string, heading string, score double, rank int, body string")
    assert [(r.path, len(r.text)) for r in retrieval.context(hits, 3, 70).collect()] == [("a", 50), ("b", 16)]


def test_entry_and_queries_run_against_sql(spark):
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.001"
    assert __spark_entry__.entry(spark).count() == 10
    con = duckdb.connect()
    for t in ("nation", "region", "orders", "documents", "part"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("bm25_topk", "native_in", "base_group", "task_group", "links_resolve"):
        mine = sorted(map(tuple, __spark_entry__.queries()[name](spark, d).collect()), key=repr)
        df = con.sql(__spark_entry__.oracle_sql()[name])
        order = [df.columns.index(c) for c in __spark_entry__.queries()[name](spark, d).columns]
        assert mine == sorted((tuple(r[k] for k in order) for r in df.fetchall()), key=repr)


def test_task_table_keeps_plain_fields_and_deals_notes(spark, tmp_path):
    from mdspark.sources.index import Index
    notes = spark.range(200).selectExpr("concat('a/n', id, '.md') AS path", "concat('n', id) AS title", r"concat('# H\n- [ ] do ', id, ' #t [due:: 2026-01-0', id % 9 + 1, ']\n  - [x] [k:: 1] [[b]] [k:: 2] 📅 2026-02-01') AS body").coalesce(1)
    chunks = spark.createDataFrame([], "chunk_id long, path string, title string, heading string, body string, search_text string, content_hash string")
    index = Index(spark, str(tmp_path / "i")).build(chunks, notes)
    rows = tasks.task_table(index, parent=False)
    whole = tasks.with_days(tasks.extract_tasks(notes, note_links=True))
    assert sorted(rows.columns) == sorted(whole.columns)
    shown = lambda f: sorted(f.select(F.to_json(F.struct(*sorted(f.columns))).alias("j")).toPandas()["j"])
    assert shown(rows) == shown(whole) and rows.where("fields['k'] = '2' AND get(outlinks, 0).path = 'b.md' AND due = '2026-02-01'").count() == 200
    folder = f"{index.root}/{next(iter(index.metadata()['segments'][0]['derived'].values()))}"
    kept = spark.read.parquet(folder)
    assert not {"description", "fields", "tags", "original_markdown", "file"} & set(kept.columns)
    assert kept.select(F.input_file_name()).distinct().count() > 1  # of one file of notes


def test_dependencies_bring_no_tasks_without_an_id_together(spark):
    rows = spark.createDataFrame([("a", 1, "TODO", "x", []), ("a", 2, "TODO", None, ["x"]), ("b", 1, "DONE", "x", ["x"]), ("b", 2, "TODO", None, ["nope"])], "path string, line int, status_type string, id string, depends_on array<string>")
    out = tasks.dependencies(rows)
    assert sorted((r.path, r.line, r.is_blocked, r.is_blocking) for r in out.collect()) == [("a", 1, False, True), ("a", 2, True, False), ("b", 1, False, False), ("b", 2, False, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join LeftOuter" in x and "(id#" in x]


def test_attached_tasks_have_the_columns_asked_for(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "path string")
    rows = spark.createDataFrame([("a", 2, "y", "t"), ("a", 1, "x", "t")], "path string, line int, description string, text string")
    out = tasks.attach(pages, rows, ("description",))
    assert {r.path: [tuple(t) for t in r.tasks] for r in out.collect()} == {"a": [(1, "x"), (2, "y")], "b": []}
