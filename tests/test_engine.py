"""The commands over a folder of notes: index, search, languages, links, reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mdspark import manual, outputs
from mdspark.engine import Engine, base_view
from mdspark.operators import retrieval
from mdspark.plans.data_array import Pages
from mdspark.plans.expression import compile_expression
from mdspark.sources import pages as page_source
from mdspark.sources import vault
from mdspark.sources.yaml_subset import properties

NOTES = {
    "work/alpha.md": "---\ntags: [work, project/alpha]\nrating: 4.5\nowner: \"[[people/Ann|Ann]]\"\ndue: 2026-01-05\ntitle: The Alpha\n---\nAlpha of café foo_bar lamps. See [[beta]] and ![[Ann]].\n\n# Plan\n- [ ] write report 📅 2026-06-20 🆔 a1 #x\n  - [x] sub [[beta|b]] [project:: Q]\n- [ ] wait ⛔ a1 🔁 every week\n",
    "work/beta.md": "---\ntags: [work]\nrating: 2\nowner: \"[[people/Ann]]\"\ndue: 2026-01-01\n---\nBeta speaks of lamps and lamps. #home [back](alpha.md)\n",
    "people/Ann.md": "Ann is a person. foo bar\n\n## Tasks ##\n> - [/] call 🔺\n",
    "dup/beta.md": "---\n# nothing\n---\nOther beta, see [[nowhere]].\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("vault")
    for name, text in NOTES.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text)
    out = Engine(spark, str(folder), current="work/alpha.md", today=dt.date(2026, 6, 18))
    out.index()
    return out


def test_index_and_reports(spark, engine):
    assert engine._index.statistics().first().asDict() == {"notes": 4, "chunks": 6, "links": 6}
    status = engine.status().first()
    assert status.has_index and status.notes == 4 and status.unresolved_links == 1 and status.embeddings == 6 and not status.index_stale and not status.embeddings_stale
    assert not engine.refresh()
    assert {r.line.split(":")[0] for r in outputs.status_lines(engine.status()).collect()} >= {"notes", "index_stale"}
    assert engine._index.missing("another").count() == 6 and engine._index.embed_missing(engine.encoder) == 0
    rows = spark.createDataFrame([("h", "m", 2, [1.0, 0.0]), ("h", "m", 2, [1.0, 0.0])], "content_hash string, model string, dimensions int, vector array<float>")
    engine._index.store_embeddings(rows)
    engine._index.store_embeddings(rows.withColumn("vector", F.array(F.lit(0.0).cast("float"), F.lit(1.0).cast("float"))))
    assert [r.vector for r in engine._index.embeddings().where("content_hash = 'h'").collect()] == [[0.0, 1.0]]
    assert len(manual.topics()) == 16 and manual.render("dql").startswith("dataview") and "status" in engine.manual()
    with pytest.raises(ValueError):
        manual.render("nope")


def test_search(engine):
    paths = lambda q, **k: [r.path for r in engine.search(q, **k).collect()]
    assert paths("lamps", engine="bm25") == ["work/beta.md", "work/alpha.md"]
    assert paths("cafe", engine="bm25") == ["work/alpha.md"] == paths("CAFÉ", engine="bm25")
    # a token of two terms is a phrase
    assert set(paths("foo_bar", engine="bm25")) == {"work/alpha.md", "people/Ann.md"} and paths("bar_foo", engine="bm25") == []
    assert paths("?!", engine="bm25") == [] and paths("lamps")[0] == "work/beta.md"
    assert paths("Ann is a person", engine="rag")[0] == "people/Ann.md"
    hit = engine.search("lamps", engine="bm25").first()
    assert hit.rank == 1 and "lamps" in hit.snippet
    assert outputs.printed(outputs.hit_lines(engine.search("Plan report", engine="bm25"), True)).startswith("work/alpha.md#Plan (score=")


def test_pipeline(engine):
    rows = engine.pipeline("bm25:lamps", "filter:rating > 3").collect()
    assert [(r.path, r.chunk_id >= 0, r.rank) for r in rows] == [("work/alpha.md", True, 1)]
    rows = engine.pipeline("bm25:person", "filter:rating exists").collect()
    assert [(r.path, r.chunk_id) for r in rows] == [("work/alpha.md", -1), ("work/beta.md", -1)]
    assert [r.path for r in engine.pipeline("filter:rating exists", "bm25+rag:lamps").collect()][0] == "work/beta.md"
    assert engine.context("bm25:lamps", max_chars=30).count() == 1
    for bad in ("nope:x", "bm25@native:x", "filter@sql:x", "bm25:", ":x"):
        with pytest.raises(ValueError):
            engine.pipeline(bad)
    engine2 = Engine(engine.spark, engine.folder, engine._index.root)
    engine2.encoder.model = "other"
    with pytest.raises(ValueError):
        engine2.pipeline("rag:x")
    assert retrieval.found_note(3, 8) == "3 results found"
    # an unlimited list is numbered over all tasks
    many = engine.spark.range(1000).select(F.col("id").alias("chunk_id"), (F.col("id") % 7).cast("double").alias("score"))
    ranks = {r.chunk_id: r["rank"] for r in retrieval.ranked(many).collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert all(ranks[i] == k + 1 for k, i in enumerate(order))


def test_links(engine):
    assert [r.source_path for r in engine.backlinks("people/Ann").collect()] == ["work/alpha.md", "work/beta.md"]
    assert [(r.raw_target, r.target_path, r.is_embed) for r in engine.links("alpha").collect()] == [("beta", "work/beta.md", False), ("Ann", "people/Ann.md", True), ("people/Ann", "people/Ann.md", False)]
    assert {(r.path, r.hop) for r in engine.graph("people/Ann.md", 1).collect()} == {("people/Ann.md", 0), ("work/alpha.md", 1), ("work/beta.md", 1)}
    with pytest.raises(ValueError):
        engine.backlinks("beta")  # two notes are so called
    lines = [r.line for r in outputs.link_lines(engine.links_table().where("target_path IS NULL")).collect()]
    assert lines == ["dup/beta.md\tnowhere\t<unresolved>"]


def test_native_and_files(engine):
    got = [(r.path, r.title) for r in engine.query("rating >= 2").rows.collect()]
    assert got == [("work/alpha.md", "The Alpha"), ("work/beta.md", "beta")]
    assert [r.path for r in engine.query("rating missing").rows.collect()] == ["dup/beta.md"]
    with pytest.raises(ValueError):
        engine.query_file("../x", "native")
    with pytest.raises(ValueError):
        Engine(engine.spark, engine.folder, current="/etc/x.md")
    with pytest.raises(ValueError):
        engine.query("x", "sql")
    engine.register("count", lambda e, s: type(engine.query("rating exists"))(e.notes().limit(int(s))))
    assert engine.query("2", "count").rows.count() == 2


def test_file_namespace(engine):
    pages = engine.pages()
    value = lambda e, p="work/alpha.md": pages.where(F.col("path") == p).select(compile_expression(e, pages).column.alias("v")).first().v
    assert value("file.name") == "alpha" and value("file.folder") == "work" and value("file.ext") == "md" and value("file.size") > 0 and value("file.mtime.year") >= 2024
    assert value("file.tags") == ["work", "project/alpha", "x"] and value("file.tags", "work/beta.md") == ["work", "home"]
    assert value("file.hasTag('project')") and not value("file.hasTag('alpha')") and value("file.inFolder('work')") and value("file.hasLink('people/Ann')")
    assert value("file.hasProperty('rating')") and not value("file.hasProperty('nope')") and value("note.rating") == 4.5 and value("rating") == 4.5
    assert value("owner.path") == "people/Ann" and value("owner.display") == "Ann" and value("owner.display", "work/beta.md") == "people/Ann" and value("owner = link('Ann')")
    assert value("file.links.map(value.path)") == ["work/beta.md", "people/Ann.md", "people/Ann.md"] and value("file.embeds.length") == 1 and value("file.backlinks.length", "people/Ann.md") == 3
    assert value("file.links.unique().length") == 2 and value("link('people/Ann').linksTo('beta')") and value("file.link.asFile().basename") == "alpha"
    assert value("this.file.name", "work/beta.md") == "alpha" and value("file.asLink('x').display") == "x" and value("rating", "people/Ann.md") is None


def test_base(engine):
    source = """
filters: file.hasTag("work")
formulas:
  twice: rating * 2
  bad: "((("
summaries:
  spread: values.reduce(acc + value, 0) + values.length
views:
  - filters:
      not: rating > 100
    sort:
      - property: formula.twice
        direction: desc
    order: [file.name, formula.twice, formula.bad, this.file.name]
    summaries: {rating: spread, due: Range, formula.twice: Max, owner: Unique}
"""
    result = engine.query(source, "base")
    assert [tuple(r) for r in result.rows.collect()] == [("alpha", 9.0, None, "alpha"), ("beta", 4.0, None, "alpha")]
    row = result.summaries.first()
    assert row["rating_spread"] == 8.5 and row["due_range"] == 4 * 86_400_000 and row["formula.twice_max"] == 9.0 and row["owner_unique"] == 2
    first = base_view(properties("views:\n  - summaries: {due: Earliest}\n")).summarise(engine.pages()).first()
    assert first[0] == "2026-01-01"
    grouped = engine.query("views:\n  - groupBy: {property: file.folder, direction: desc}\n    order: [file.name]\n    limit: 10\n", "base").rows.collect()
    assert [(r.key, [x["file.name"] for x in r.rows]) for r in grouped] == [("work", ["alpha", "beta"]), ("people", ["Ann"]), ("dup", ["beta"])]
    assert [(r.key, r.path) for r in engine.query("views:\n  - groupBy: file.folder\n", "base").rows.collect()][0] == ("dup", "dup/beta.md")
    with pytest.raises(ValueError):
        base_view([1])
    with pytest.raises(ValueError):
        base_view({"views": [{"groupBy": "x"}]}).groups(engine.pages())


def test_dataview(engine):
    rows = engine.query('TABLE WITHOUT ID file.name AS "N", rating FROM "work" WHERE rating > 1 AND file.name != "a WHERE b" SORT rating ASC', "dataview").rows
    assert rows.columns == ["N", "rating"] and [tuple(r) for r in rows.collect()] == [("beta", 2.0), ("alpha", 4.5)]
    assert [r.path for r in engine.query("LIST FROM #home", "dataview").rows.collect()] == ["work/beta.md"]
    tasks = engine.query("TASK WHERE is_done SORT line", "dataview").rows.collect()
    assert [(r.path, r.description) for r in tasks] == [("work/alpha.md", "sub [[beta|b]]")]
    assert engine.query("TASK FROM #x", "dataview").rows.count() == 0
    groups = engine.query("TABLE key, rows.length AS n GROUP BY file.folder", "dataview").rows.collect()
    assert [tuple(r) for r in groups] == [("dup", 1.0), ("people", 1.0), ("work", 2.0)]
    assert engine.query("LIST FLATTEN file.tags AS t WHERE t = 'work'", "dataview").rows.count() == 2


def test_tasks(engine):
    run = lambda q: [r.description.split()[0] for r in engine.query(q, "tasks").rows.collect()]
    assert run("not done\nsort by path") == ["call", "write", "wait"] and run("is blocked") == ["wait"] and run("has blocking") == ["write"] and run("due saturday") == ["write"]
    assert run("filename includes {{query.file.filename}}\nis recurring") == ["wait"] and run("folder includes people") == ["call"] and run("tags includes #x") == ["write"]
    assert run("filter by function task.file.outlinks.length > 0 && task.findClosestParentTask() !== null") == ["sub"] and run("description includes sub {{! why }}") == ["sub"]
    assert engine.query("sort by nope\nwhat is this", "tasks").diagnostics == ["unknown sort field: sort by nope", "not understood: what is this"]
    other = Engine(engine.spark, engine.folder, engine._index.root, task_statuses=["/=Waiting:ON_HOLD:x"], task_query="not done", functions={"late": lambda c: c["due"] < "2026-06-21"})
    assert [r.status_name for r in other.query("path includes Ann", "tasks").rows.collect()] == ["Waiting"]
    assert [r.description for r in other.query("filter by function late", "tasks").rows.collect()] == ["write report #x"]
    assert other.query("ignore global query\ndone", "tasks").rows.count() == 1
    groups = engine.query("group by folder\ngroup by status.type", "tasks").rows.collect()
    assert [(r.group_0, r.group_1) for r in groups] == [("people/", "IN_PROGRESS"), ("work/", "TODO"), ("work/", "TODO"), ("work/", "DONE")]


def test_arrays(engine):
    def program(dv):
        pages = dv.pages('"work"')
        dv.list(pages.sort("rating").map("file.name"))
        dv.table(["name", "twice"], pages.where(lambda p: p.rating > 3), ["file.name", lambda p: p.rating * 2])
        dv.paragraph("done")
        dv.taskList(dv.with_tasks().where("tasks.length > 1"))
        with pytest.raises(PermissionError):
            dv.el("b", "x")
        with pytest.raises(PermissionError):
            dv.load("x")
        with pytest.raises(ValueError):
            dv.view("../x")

    rows = [(r.render, r.value) for r in engine.script(program).orderBy("position").collect()]
    assert ("list", '{"value":"beta"}') in rows and ("table", '{"name":"alpha","twice":9.0}') in rows and ("paragraph", "done") in rows
    dv = Pages(engine.pages(), engine.tasks(), "work/alpha.md", {"named": lambda dv, n: dv.pages().limit(n).array()})
    assert dv.view("named", 2).count() == 2 and dv.page("Ann").first().path == "people/Ann.md" and dv.current().first().path == "work/alpha.md"
    assert dv.pages().flatMap("file.tags").distinct("value").length == 4
    assert [(r.key, len(r.rows)) for r in dv.pages().groupBy("file.folder").array().collect()] == [("dup", 1), ("people", 1), ("work", 2)]
    assert [r.path for r in dv.pages("#work").sort("rating", "desc").array().collect()] == ["work/alpha.md", "work/beta.md"]


def test_notes_that_are_odd(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x \xff y\r\n\r\n# H\r\nz")
    (tmp_path / "b.md").write_text("---\nk: {a: [1, 2], b: \"q\"}\ntext: |\n  one\n  two\n---\n[t](c%20d.md) [r][1]\n\n[1]: e.md#h\n")
    (tmp_path / "c.md").write_text("---\nk: [1\n---\nbody")
    rows = {r.path: r for r in vault.read_vault(spark, str(tmp_path)).collect()}
    assert not rows["a.md"].is_utf8 and [(c.heading, c.body) for c in rows["a.md"].chunks] == [(None, "x � y"), ("H", "z")] and rows["a.md"].mtime > 0
    assert rows["b.md"].frontmatter_json == '{"k":{"a":[1,2],"b":"q"},"text":"one\\ntwo\\n"}' and [(x.raw_target, x.heading) for x in rows["b.md"].links] == [("c d.md", None), ("e.md", "h")]
    assert rows["c.md"].frontmatter_json is None and rows["c.md"].body == "body"
    with pytest.raises(Exception, match="utf-8"):
        files = spark.read.format("binaryFile").load(str(tmp_path))
        vault.parse_notes(files, strict=True).collect()
    long = "\n\n".join(["p" * 1000] * 5)
    assert [len(b) for _, b in vault.chunk_body("# A\n" + long)] == [2002, 2002, 1000]


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(1, "x", ["t"])], "k int, path string, tags array<string>")
    pages = page_source.from_table(df, F.concat(F.lit("d/"), F.col("k").cast("string"), F.lit(".md")), tags=F.col("tags"))
    row = pages.select(compile_expression("file.name + note.k", pages).column.alias("v"), compile_expression("file.hasTag('t')", pages).column.alias("w"), "path").first()
    assert tuple(row) == ("11", True, "d/1.md")


def test_command_line(spark, engine, capsys):
    from mdspark.__main__ import main

    def run(*words):
        code = main(["--vault", engine.folder, "--db", engine._index.root, *words], spark)
        said = capsys.readouterr()
        return code, said.out.strip().split("\n"), said.err

    assert run("query", "rating > 3")[:2] == (0, ["work/alpha.md"])
    assert run("backlinks", "people/Ann")[1] == ["work/alpha.md", "work/beta.md"]
    assert run("links", "dup/beta.md")[1] == ["dup/beta.md\tnowhere\t<unresolved>"]
    assert run("search", "lamps", "--engine", "bm25")[1][0] == "work/beta.md"
    code, out, said = run("query", "sort by nope\nlimit 1", "--language", "tasks")
    assert code == 0 and '"path":' in out[0] and "unknown sort field" in said
    assert run("query", "x", "--tasks-status", "a=TODO")[0] == 1 and run("query")[0] == 1 and run("graph", "nobody")[0] == 1
    assert any(line == "notes: 4" for line in run("status")[1]) and main(["man", "dql"]) == 0
    assert "2 results found, the first 1" in run("pipeline", "--stage", "bm25:lamps", "--limit", "1")[2]


def test_stages_and_filter_languages_can_be_added(engine):
    pipe = engine._pipeline()
    extended = retrieval.Pipeline(
        pipe.chunks, pipe.notes, pipe.vectors, pipe.embed, pipe.index,
        filters={"prefix": lambda source: F.startswith(F.col("path"), F.lit(source))},
        stages={"headed": lambda hits, stage: hits.where(F.col("heading") == stage.argument)},
    )
    assert [r.path for r in extended.run("headed:Plan", limit=5).collect()] == ["work/alpha.md"]
    assert {r.path for r in extended.run("bm25:lamps", "filter@prefix:work/a", limit=5).collect()} == {"work/alpha.md"}


def test_a_query_in_a_file(engine):
    from pathlib import Path

    (Path(engine.folder) / "q.txt").write_text("rating > 3")
    assert [r.path for r in engine.query_file("q.txt", "native").rows.collect()] == ["work/alpha.md"]
