"""New notes are appended; what has been read is not read again."""

import time

from mdspark.sources.index import Index
from mdspark.streaming.refresh import current_notes, follow, stream_notes


def test_refresh(spark, tmp_path):
    root, target, state = (tmp_path / n for n in ("vault", "notes", "state"))
    root.mkdir()
    (root / "a.md").write_text("---\nk: 1\n---\nold")
    (root / "b.md").write_text("b")
    stream_notes(spark, str(root), str(target), str(state)).awaitTermination(60)
    (root / "c.md").write_text("c")
    stream_notes(spark, str(root), str(target), str(state)).awaitTermination(60)
    got = {r.title: r.body for r in current_notes(spark, str(target)).collect()}
    assert got == {"a": "old", "b": "b", "c": "c"}
    assert spark.read.parquet(str(target)).count() == 3


def test_an_index_follows_a_folder(spark, tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    for name, text in (("a.md", "first lamp"), ("b.md", "second stone"), ("c.md", "third river")):
        (folder / name).write_text(text)
    index = Index(spark, str(tmp_path / "index"))

    def seen():
        return sorted((r.path, r.body) for r in index.table("chunks").collect()) if index.metadata() else []

    def until(wanted):
        began = time.monotonic()
        while seen() != wanted and time.monotonic() - began < 120:
            time.sleep(1)
        return seen()

    stream = follow(index, str(folder), str(tmp_path / "checkpoint"), 1)
    try:
        assert until([("a.md", "first lamp"), ("b.md", "second stone"), ("c.md", "third river")]) == seen()
        (folder / "a.md").write_text("first lamp, changed")
        (folder / "b.md").unlink()
        (folder / "d.md").write_text("fourth")
        wanted = [("a.md", "first lamp, changed"), ("c.md", "third river"), ("d.md", "fourth")]
        assert until(wanted) == wanted
    finally:
        stream.stop()
    versions = index.log.versions()
    # after a restart nothing is done twice
    (folder / "e.md").write_text("fifth")
    stream = follow(index, str(folder), str(tmp_path / "checkpoint"), 1)
    try:
        assert until([*wanted, ("e.md", "fifth")]) == [*wanted, ("e.md", "fifth")]
        time.sleep(3)
    finally:
        stream.stop()
    assert index.log.versions()[-1] == versions[-1] + 1
