"""What keeps the figures of large inputs in proportion: parts by size, packed postings, texts that are read once."""

import pytest
from pyspark.sql import functions as F

from mdspark.functions.plain_terms import PLAIN, count_plain_terms, plain_terms
from mdspark.functions.text import fold, index_terms, search_tokens
from mdspark.operators import retrieval
from mdspark.shipping import ship_package
from mdspark.sources import index as index_module
from mdspark.sources.index import Index


def chunks(spark, n=400):
    words = "lamp seed river stone cloud ember field glass heron ivory".split()
    rows = [(k, f"n/{k}.md", " ".join([words[(k * j + j * j) % (3 + k % 8)] for j in range(1 + (k * 7) % 40)] + [f"rare{k}"])) for k in range(n)]
    df = spark.createDataFrame(rows, "chunk_id long, path string, search_text string")
    return df.select("*", F.lit("t").alias("title"), F.lit(None).cast("string").alias("heading"), F.col("search_text").alias("body"), F.lit("h").alias("content_hash"))


def content(index):
    rows = index._read_postings("term", "block", "n", F.round("impact", 9).alias("impact"), "ids", "freqs", "dls", "positions")
    return sorted(map(repr, rows.collect()))


@pytest.mark.parametrize("words", [1 << 20, 300])
def test_parts_grow_with_the_text_and_hold_the_same_postings(spark, tmp_path, monkeypatch, words):
    rows = chunks(spark)
    whole = Index(spark, str(tmp_path / "a")).build(rows)
    monkeypatch.setattr(index_module, "PART", 500)  # more parts than buckets, so that these have slices
    monkeypatch.setattr(index_module, "WORDS", words)
    index = Index(spark, str(tmp_path / "b")).build(rows)
    folder = tmp_path / "b" / index.metadata()["segments"][0]["folder"]
    assert len(list((folder / "chunks").glob("part-*"))) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert any(len(list(bucket.glob("part-*"))) > 1 for bucket in (folder / "postings").glob("bucket=*"))
    assert content(index) == content(whole)
    assert [tuple(r) for r in retrieval.bm25_indexed(index, "lamp stone", 5).collect()] == [tuple(r) for r in retrieval.bm25_indexed(whole, "lamp stone", 5).collect()]


def test_terms_of_texts_searched_once_are_those_taken_token_by_token(spark):
    texts = ["Plain a_b__c _ 12_x", "É_é Ñandú", "ΆΈ ύ;ω x·y", "éa ͅ aͣb", "İstanbul K", "日本語 é_x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.filter(F.flatten(F.transform(search_tokens(F.col("t")), lambda t: F.split(fold(t), "_+"))), lambda t: t != "")
    for row in df.select(index_terms(F.col("t")).alias("a"), each.alias("b")).collect():
        assert row.a == row.b


def test_bm25_without_an_index_parts_texts_into_words_once(spark):
    hits = retrieval.bm25(chunks(spark), "lamp stone", 5)
    assert "regexp_extract_all" not in hits._jdf.queryExecution().optimizedPlan().toString()  # what is left reads counts
    assert len(hits.collect()) == 5


def test_ranks_of_restricted_hits_write_no_bodies(spark, monkeypatch):
    from mdspark import queries
    from mdspark.operators import ordering

    folders, scratch = [], ordering.scratch
    monkeypatch.setattr(ordering, "scratch", lambda spark, name: folders.append(scratch(spark, name)) or folders[-1])
    queries.queries()["bm25_restrict_filter"](spark, "/root/testdata/sf0.001").collect()
    assert [spark.read.parquet(f).columns for f in folders] == [["chunk_id", "score", "_at"]]


def test_terms_of_plain_texts_are_those_of_the_index(spark):
    ship_package(spark)
    plain = [f"{chr(c)} x{chr(c)}y {chr(c)}A {chr(c)}{chr(c)}" for a, b in PLAIN for c in range(a, b + 1)] + ["", "_", "Émile_ça-va  été"]
    odd = ["日本語 é_x", "ΑΣ σ", "İx", "e\u0301a b", "\U0001f600 a", None]
    df = spark.createDataFrame([(t,) for t in plain + odd], "t string")
    rows = df.select("t", index_terms(F.col("t")).alias("terms"), count_plain_terms(F.col("t")).alias("n")).collect()
    for row in rows[: len(plain)]:
        assert (row.n, next(plain_terms([row.t])).to_pylist()) == (len(row.terms), row.terms)
    assert [row.n for row in rows[len(plain) :]] == [-1] * len(odd)
    assert [w.to_pylist() for w in plain_terms(["a B", "", "é ß д", "x"])] == [["a", "b"], [], ["e", "ß", "д"], ["x"]]
    bad = spark.range(1).select(F.expr("cast(X'61FF62' AS string)").alias("t"))
    assert bad.select(count_plain_terms(F.col("t"))).first()[0] == -1


def test_postings_of_plain_and_other_texts_come_sorted_and_scores_read_no_positions(spark, tmp_path):
    more = [(1000, "a 日本語 b"), (1001, "Été a_B"), (1002, ""), (1003, None), (1004, "İ lamp")]
    rows = chunks(spark, 60).unionByName(chunks(spark, 1).drop("chunk_id", "search_text").join(spark.createDataFrame(more, "chunk_id long, search_text string")))
    index = Index(spark, str(tmp_path / "a")).build(rows)
    want = rows.select("chunk_id", F.posexplode(index_terms(F.col("search_text"))).alias("p", "term")).groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("p")).alias("positions"))
    found = index.table("postings").select("term", "chunk_id", "positions")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    folder = tmp_path / "a" / index.metadata()["segments"][0]["folder"] / "chunks"
    made = index_module.postings_of(spark.read.parquet(str(folder)), 1.0, parts=3).select(F.spark_partition_id().alias("k"), "bucket", "term", "block")
    listed = [(r.k, r.bucket, r.term.encode(), r.block) for r in made.collect()]
    assert listed == sorted(listed)
    assert "positions" not in retrieval.bm25_indexed(index, "lamp stone")._jdf.queryExecution().executedPlan().toString()
