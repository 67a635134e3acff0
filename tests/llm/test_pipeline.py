"""The stages on a small corpus, each held against what it must keep; clean documents stay."""

import re

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 4000, n))


ITEM = "What is the capital of the far blue country beyond the hills? It is the old town of Verlona by the sea."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = {k: prose(k, 60 + k % 50) for k in range(120)}
    junk = {1000 + k: "!! ".join(w.upper() for w in prose(2000 + k, 60).split()) for k in range(40)}
    copies = {200: clean[0], 201: clean[1] + " tail", 202: clean[2].replace("w", "W")}
    others = {300: prose(300, 80) + " " + ITEM, 301: prose(301, 70) + " mail a.b@c.de or +49 30 1234567 now"}
    texts = clean | junk | copies | others
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in [*clean, *junk]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_each_stage(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "quality":
            assert all(i >= 1000 for i in gone) and len(gone) >= 38
        elif name == "near_duplicates":
            assert gone == {200, 201, 202} | {i for i in gone if i >= 1000}
        elif name == "decontamination":
            assert gone == {300}
        else:
            assert not gone and after[301].text.endswith("mail [EMAIL] or [PHONE] now")
            assert all(r.n_chars == len(r.text) and (i == 301 or r.text == texts[i]) for i, r in after.items())
            assert not re.search(r"@", " ".join(r.text for r in after.values()))


def test_repeated_rows_and_null_ids(spark, corpus):
    folder, _ = corpus
    a, b, leak = prose(401, 90), prose(402, 90), prose(403, 80) + " " + ITEM
    rows = [(7, a), (7, a), (7, a), (5, a + " tail"), (None, a), (None, b), (None, b), (None, leak), (9, leak), (9, prose(404, 90)), (None, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    order = lambda rows: sorted(rows, key=repr)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    got = order((r.doc_id, r.text) for r in once.collect())
    assert got == order([(5, a + " tail"), (None, b), (9, leak), (9, prose(404, 90)), (None, None), (11, "")])
    left = order((r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, folder).collect())
    assert left == order(r for r in rows if r[1] != leak)


def test_stages_on_empty_tables_nulls_and_long_texts(spark, corpus):
    folder, _ = corpus
    empty = spark.createDataFrame([], SCHEMA)
    odd = [(1, None), (1, None), (None, ""), (2, prose(500, 40000) + " a.b@c.de"), (3, "  ")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.keep_good(spark, empty, folder).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, docs, folder).count() == 5 == corpus_pipeline.drop_leaks(spark, docs, folder).count()
    text = {r.text for r in corpus_pipeline.redact_private_data(spark, docs, folder).collect()}
    assert None in text and any(t and t.endswith(" [EMAIL]") for t in text)
    rows = corpus_pipeline.encode(spark, docs, folder).collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows) and sorted(r.n_tokens == 0 for r in rows) == [False, False, True, True, True]


def test_run(spark, corpus):
    folder, _ = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows if r.doc_id < 1000} == {*range(120), 301}
    assert all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in rows)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_columns_of_any_name_stay(spark, corpus):
    folder, texts = corpus
    names = ["_row", "_score", "_ROW_", "k", "t", "row", "m", "_source", "id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in names), "-doc_id AS `a.b`")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    rows = corpus_pipeline.encode(spark, docs, folder).collect()
    assert len(rows) > 100 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names) and all(r["a.b"] == -r.doc_id and r.n_chars for r in rows)
