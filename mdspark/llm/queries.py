"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.llm import (
    byte_bpe, decontamination, hard_negatives, html_text, language_model, lz_fingerprint, near_dedup, neighbours, periodic_runs, private_data, quality, substring_dedup, url_filter,
)
from mdspark.llm.common import table, text_of


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
elements AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.doc_id),
low AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low USING (doc_id)
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scores.withColumn("score", F.round("score", 6))


OP5_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (
  SELECT r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM docs),
tokens AS MATERIALIZED (SELECT r, unnest(l) AS w, unnest(range(len(l))) AS i FROM words),
grams AS MATERIALIZED (SELECT r, i, w, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM tokens WINDOW d AS (PARTITION BY r ORDER BY i)),
counts AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY w) AS f1, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS e1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) AS e2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) AS e3 FROM grams),
contexts AS (SELECT *, lag(e1) OVER d AS c1, lag(e2) OVER d AS c2 FROM counts WINDOW d AS (PARTITION BY r ORDER BY i)),
scores AS (
  SELECT r, u IS NOT NULL AND e3 > 0 AS shared, CASE WHEN u IS NOT NULL AND e3 > 0 THEN log10(e3 / c2)
    WHEN v IS NOT NULL AND e2 > 0 THEN log10(e2 / c1) + CASE WHEN u IS NULL THEN 0 ELSE log10(0.4) END
    ELSE log10(f1 / (SELECT count(*) FROM tokens)) + least(i, 2) * log10(0.4) END AS s FROM contexts),
sums AS (SELECT r, count(*) AS n, sum(shared::INT) AS shared, sum(s) / count(*) AS score FROM scores GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(shared, 0)::BIGINT AS n_shared, round(score, 6) AS score FROM docs LEFT JOIN sums USING (r)
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.spans_of(table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rules(verdict, host, prefix) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id, lower(regexp_extract(r, '^([^/?#]*)', 1)) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT n, rules.verdict, rules.host || rules.prefix AS rule,
    row_number() OVER (PARTITION BY n ORDER BY len(rules.host) DESC, len(prefix) DESC, rules.verdict DESC) AS k
  FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(path, prefix))
SELECT page_id, parts.host AS host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.n = parts.n AND k = 1
"""


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, words=51)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "repeated_words"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """``docs`` whose words repeat from word a on with period p in every tenth text or so, by the crc32 of doc_id; words are then joined by one space. Without a doc_id or a word the text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def altered(words, g):
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # values of a lambda are bound once, so that the words are not found again for each place
        place = lambda a, p: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        bound = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(place(x.a, x.p), " "))
        return F.when(n > 0, F.get(bound, F.lit(0))).otherwise(F.lit(""))

    words = F.regexp_extract_all(text_of(), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    periodic = F.get(F.transform(F.array(words), lambda w: altered(w, F.floor(h / 10))), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, periodic).otherwise(text_of()))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_ends(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, min_length=6, min_exponent=4)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", longest.alias("longest"), F.array_join(lines, "").alias("lines"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# A run of at least max(6, 4 * q) words has five places in a row that equal the words q further on, so pairs of equal
# five-word windows hold every run; neighbouring pairs of one distance make up its stretch.
OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS t),
hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295) AS h
  FROM documents, crc),
shape AS (SELECT r, doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
words AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM shape),
grams AS MATERIALIZED (SELECT r, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: hash(w[i + 1:i + 5]))) AS f FROM words WHERE n > 5),
pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.r = y.r AND x.f = y.f AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
runs AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l),
of_doc AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list(struct_pack(f := s + q, t := s + l)) AS gone,
    arg_min(struct_pack(s := s, l := l, q := q), struct_pack(a := -l, b := s, c := q)) AS best FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(gone, lambda x: x.f <= i AND i < x.t)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM words LEFT JOIN of_doc USING (r)
"""


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(table(spark, sf_dir, "documents"), share=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=5, positives=5, lower=80, upper=100, label=label)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest_neighbours": OP1_SQL,
        "op2_minhash_near_dedup": OP2_SQL,
        "op5_language_model": OP5_SQL,
        "op8_url_filter": OP8_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
