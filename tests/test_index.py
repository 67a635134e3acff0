"""The index as a log of commits: updates against fresh builds, writers that die, pinned readers, block bounds."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mdspark.engine import Engine
from mdspark.operators import graph, retrieval
from mdspark.sources import index as index_module
from mdspark.sources.commits import CommitLog, Conflict
from mdspark.sources.index import Index, bucket_number, bucket_of

WORDS = "lamp seed river stone cloud ember field glass heron ivory".split()


def rows_of(n, turn=0):
    """Chunks of 1 to 40 words, a few frequent ones and a rare one."""
    out = []
    for k in range(n):
        words = [WORDS[(k * j + j * j + turn) % (3 + k % 8)] for j in range(1 + (k * 7) % 40)] + ([f"rare{k // 3}"] if k % 3 == 0 else [])
        out.append((k, f"n/{k}.md", f"t{k}", None, " ".join(words) if k % 17 else (None if k % 2 else "")))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id long, path string, title string, heading string, body string")
    return df.select("*", F.col("body").alias("search_text"), F.sha2("body", 256).alias("content_hash"))


def notes(spark, rows):
    return spark.createDataFrame([(p, t, "{}", 1, 1) for _, p, t, _, _ in rows], "path string, title string, frontmatter_json string, mtime long, size long")


def links(spark, rows):
    return spark.createDataFrame([(p, 0, "x", None, False, p) for _, p, _, _, _ in rows], "source_path string, ordinal int, raw_target string, heading string, is_embed boolean, target_path string")


def content(index):
    """All that a reader can see, but for the blocks."""
    postings = sorted((r.term, r.chunk_id, tuple(r.positions), r.dl) for r in index.table("postings").collect())
    tables = {t: sorted(map(repr, index.table(t).select(*c).collect())) for t, c in (("chunks", ["chunk_id", "path", "body"]), ("notes", ["path", "title"]), ("links", ["source_path", "target_path"]))}
    made = index.metadata()
    return postings, tables, made["chunks"], made["texts"], made["length"], round(made["average"], 9)


SEARCHES = ("lamp lamp stone", "rare4 lamp", "ivory heron glass", "seed_river")


def found(index):
    return {q: [(r.chunk_id, round(r.score, 9)) for r in retrieval.bm25_indexed(index, q, 10).collect()] for q in SEARCHES}


def fresh(spark, root, rows):
    return Index(spark, str(root)).build(frame(spark, rows), notes(spark, rows), links(spark, rows))


def test_update_equals_a_fresh_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "FIRST", 2)
    monkeypatch.setattr(index_module, "BLOCK", 8)
    old, new = rows_of(150), rows_of(150, turn=5)
    index = fresh(spark, tmp_path / "a", old)
    now = {r[1]: r for r in old}
    for turn, (changed, removed, added) in enumerate([(range(0, 60, 3), range(100, 110), []), (range(0, 30, 2), [5], [(900 + k, f"n/new{k}.md", "new", None, "lamp seed lamp ivory heron glass") for k in range(9)]), ([140], [6], [])]):
        rows = [new[k] if turn == 0 else (k, f"n/{k}.md", "again", None, f"lamp stone turn{turn} " + "ivory heron glass " * k) for k in changed if f"n/{k}.md" in now] + added
        gone = [f"n/{k}.md" for k in removed]
        index.update(frame(spark, rows), notes(spark, rows), links(spark, rows), spark.createDataFrame([(p,) for p in gone], "path string"))
        now = {p: r for p, r in now.items() if p not in gone} | {r[1]: r for r in rows}
    whole = fresh(spark, tmp_path / "b", list(now.values()))
    assert content(index) == content(whole) and found(index) == found(whole)
    assert len(index.metadata()["segments"]) == 4
    before = content(index), found(index)
    index.compact()
    assert len(index.metadata()["segments"]) == 1 and (content(index), found(index)) == before
    # an update of a merged index
    index.update(frame(spark, [(1, "n/1.md", "t", None, "heron")]), notes(spark, [(1, "n/1.md", "t", None, "")]), links(spark, []))
    assert [r.body for r in index.table("chunks").where("chunk_id = 1").collect()] == ["heron"]


def test_many_updates_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "MANY", 2)
    rows = rows_of(20)
    index = fresh(spark, tmp_path, rows)
    for k in range(3):
        row = [(k + 1, f"n/{k + 1}.md", "t", None, f"fresh{k}")]
        index.update(frame(spark, row), notes(spark, row), links(spark, row))
    assert len(index.metadata()["segments"]) <= 2 and index.table("postings").where("term LIKE 'fresh%'").count() == 3 and index.metadata()["chunks"] == 20


STEPS = ("_segment", "_write_postings", "_write", "_manifest")


@pytest.mark.parametrize("step", [*STEPS, "commit"])
def test_a_writer_that_dies_leaves_the_index(spark, tmp_path, monkeypatch, step):
    rows = rows_of(30)
    index = fresh(spark, tmp_path, rows)
    vector = spark.createDataFrame([("h", "m", 1, [1.0])], "content_hash string, model string, dimensions int, vector array<double>")
    index.store_embeddings(vector)
    before, manifest, vectors = content(index), index.log.read(), index.embeddings().collect()
    row = [(1, "n/1.md", "t", None, "heron")]
    owner, left = (CommitLog if step == "commit" else Index), [0]
    whole = getattr(owner, step)

    def dies(self, *args, **kwargs):
        if left[0]:
            left[0] -= 1
            return whole(self, *args, **kwargs)
        raise RuntimeError("killed")

    for act in (lambda: index.update(frame(spark, row), notes(spark, row), links(spark, row)), lambda: fresh(spark, tmp_path, rows[:5]), lambda: index.store_embeddings(vector)):
        with monkeypatch.context() as m:
            m.setattr(owner, step, dies)
            if step in ("_write", "commit") or "store_embeddings" not in act.__code__.co_names:
                with pytest.raises(RuntimeError, match="killed"):
                    act()
        assert index.log.read() == manifest
    # what the dead writer left goes with time
    folders = lambda: {p.name for p in tmp_path.iterdir() if p.name.startswith(("segment", "vectors"))}
    index.vacuum(hours=-1)
    made = index.metadata()
    assert folders() == {*(s["folder"] for s in made["segments"]), *made["vectors"]} and content(index) == before and index.embeddings().collect() == vectors


def test_a_pinned_reader_finishes(spark, tmp_path):
    rows = rows_of(30)
    index = fresh(spark, tmp_path, rows)
    reader = index.pinned()
    before, lazily = content(reader), reader.table("chunks")
    row = [(1, "n/1.md", "t", None, "heron")]
    index.update(frame(spark, row), notes(spark, row), links(spark, row))
    fresh(spark, tmp_path, rows[:5])
    assert content(reader) == before and lazily.count() == 30 and index.table("chunks").count() == 5
    fresh(spark, tmp_path, rows[:6])
    fresh(spark, tmp_path, rows[:7])
    assert index.table("chunks").count() == 7 and len(index.log.versions()) == index.keep


def test_two_writers(spark, tmp_path):
    rows = rows_of(30)
    index = fresh(spark, tmp_path, rows)
    row = [(1, "n/1.md", "t", None, "heron")]
    other = Index(spark, str(tmp_path))
    begun = Index._segment

    def meanwhile(self, *args):
        made = begun(self, *args)
        other.store_embeddings(spark.createDataFrame([("h", "m", 1, [1.0])], "content_hash string, model string, dimensions int, vector array<double>"))
        return made

    with pytest.MonkeyPatch.context() as m, pytest.raises(Conflict):
        m.setattr(Index, "_segment", meanwhile)
        index.update(frame(spark, row), notes(spark, row), links(spark, row))
    assert index.table("chunks").where("body = 'heron'").count() == 0 and index.embeddings().count() == 1
    log = CommitLog(spark, str(tmp_path / "log"))
    with pytest.raises(Conflict):
        log.commit(log.versions()[-1], {})
    assert json.loads(json.dumps(log.read()))["version"] == log.versions()[-1]


def test_vectors_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "MANY", 3)
    index = Index(spark, str(tmp_path))
    kind = "content_hash string, model string, dimensions int, vector array<double>"
    for k in range(6):
        index.store_embeddings(spark.createDataFrame([("same", "m", 1, [float(k)]), (f"h{k}", "m", 1, [1.0]), ("same", "other", 1, [float(-k)])], kind))
        got = {(r.content_hash, r.model): r.vector for r in index.embeddings().collect()}
        assert got == {("same", "m"): [k], ("same", "other"): [-k]} | {(f"h{j}", "m"): [1] for j in range(k + 1)}
    assert len(index.log.read()["vectors"]) <= 3 and index.metadata() is None


def test_blocks_below_the_bound_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "BLOCK", 4)
    monkeypatch.setattr(retrieval, "FIRST", 4)
    index = fresh(spark, tmp_path, rows_of(400))
    for query in ("seed river", "lamp lamp stone", "rare4 lamp", "nothing"):
        best = retrieval.bm25_best(index, query, 5, count=True)
        chunks = retrieval.bm25(index.table("chunks"), query, 5)
        assert [(r.chunk_id, round(r.score, 9)) for r in best.hits.collect()] == [(r.chunk_id, round(r.score, 9)) for r in chunks.collect()]
        assert best.read <= best.blocks
    best = retrieval.bm25_best(index, "lamp", 5, count=True)
    assert 0 < best.read < best.blocks / 2
    monkeypatch.setattr(retrieval, "NAMED", 1)
    assert [r.chunk_id for r in retrieval.bm25_best(index, "lamp", 5).hits.collect()] == [r.chunk_id for r in best.hits.collect()]


def test_buckets_of_words(spark):
    words = ["the", "café", "日本", "", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"))).collect()
    assert [r[0] for r in got] == [bucket_number(w) for w in words]


def test_refresh_of_files(spark, tmp_path):
    folder = tmp_path / "vault"
    texts = {"a.md": "Alpha [[b]] and [[later]]", "b.md": "Beta [[a]]", "sub/c.md": "See [[b]] [[odd [x]*name]]", "gone.md": "Bye [[b]]"}
    for name, text in texts.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    engine = Engine(spark, str(folder), str(tmp_path / "index"), today=dt.date(2026, 1, 1))
    assert engine.update() == 4 and engine.update() == 0

    def seen(e):
        chunks = sorted((r.path, r.ordinal, r.body) for r in e._index.table("chunks").collect())
        linked = sorted((r.source_path, r.raw_target, r.target_path) for r in e.links_table().collect()) if e else []
        return chunks, [(s, t, str(p)) for s, t, p in sorted(linked, key=repr)], {q: [r.path for r in e.search(q, engine="bm25").collect()] for q in ("beta", "later", "see")}

    (folder / "b.md").write_text("Beta is new. [[a]] [[sub/c]]")
    (folder / "later.md").write_text("Later see [[gone]]")
    (folder / "sub/odd {1}.md").write_text("Odd see [[a]]")
    (folder / "gone.md").unlink()
    assert engine.refresh() and not engine.refresh()
    whole = Engine(spark, str(folder), str(tmp_path / "whole"), today=dt.date(2026, 1, 1))
    whole.index("bm25")
    assert seen(engine) == seen(whole) and engine.status().first().index_stale is False
    assert ("a.md", "later", "later.md") in seen(engine)[1] and len(engine._index.metadata()["segments"]) == 2
    ids = [r.chunk_id for r in engine._index.table("chunks").collect()]
    assert len(ids) == len(set(ids))


def test_edges_of_a_hub(spark, tmp_path):
    """A note that most others link to: rows of edges, and hops that read their buckets."""
    pairs = [(f"n{k}", "hub") for k in range(3000)] + [(f"n{k}", f"n{k + 1}") for k in range(0, 100, 2)] + [("hub", "far"), ("far", "away"), ("away", None)]
    rows = spark.createDataFrame([(a, k, b or "x", None, False, b) for k, (a, b) in enumerate(pairs)], "source_path string, ordinal int, raw_target string, heading string, is_embed boolean, target_path string")
    index = Index(spark, str(tmp_path)).build(frame(spark, []), notes(spark, []), rows)
    for start, depth in (("away", 1), ("away", 3), ("n0", 1), ("n0", 2)):
        want = sorted(map(tuple, graph.neighbourhood(rows, start, depth).collect()))
        assert sorted(map(tuple, graph.neighbourhood_of(index, start, depth).collect())) == want
    assert [r.source_path for r in graph.backlinks_of(index, "n1").collect()] == ["n0"] and graph.backlinks_of(index, "hub").count() == 3000
    # an update replaces a note's edges at both ends
    change = rows.where("source_path = 'far'").withColumn("target_path", F.lit("n7"))
    index.update(frame(spark, [(1, "far", "t", None, "x")]), None, change)
    assert sorted(map(tuple, graph.neighbourhood_of(index, "n7", 1).collect())) == [("far", 1), ("hub", 1), ("n6", 1), ("n7", 0)] and graph.backlinks_of(index, "away").count() == 0
    at_hub = index.edges_at(spark.createDataFrame([("hub",)], "path string"))
    assert "PartitionFilters: [isnotnull(bucket" in at_hub._jdf.queryExecution().executedPlan().toString() or "bucket" in at_hub._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
