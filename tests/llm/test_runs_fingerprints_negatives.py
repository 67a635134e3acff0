"""Periodic runs, fingerprints and hard negatives against brute force, on tables with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdspark.llm import hard_negatives, lz_fingerprint, periodic_runs, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---- periodic runs ----
def runs_by_definition(w, min_length, min_exponent):
    """All places and periods, one after the other."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made_words(rng, n):
    if rng.random() < 0.4:
        return [rng.randrange(rng.randint(1, 4)) for _ in range(n)]
    out = []
    while len(out) < n:
        out += [rng.randrange(4) for _ in range(rng.randint(1, 7))] * rng.randint(1, 7)
    return out


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (5, 3), (10, 2)])
def test_runs_by_definition(least):
    rng = random.Random(sum(least))
    for _ in range(3000):
        words = made_words(rng, rng.randint(0, 70))
        assert periodic_runs.find_runs(words, *least) == runs_by_definition(words, *least)


def test_factors_are_the_longest_pieces_seen_before():
    rng = random.Random(7)
    for _ in range(500):
        w = made_words(rng, rng.randint(1, 40))
        at = 0
        for start, length, source in periodic_runs.lz_factors(w):
            assert start == at
            seen = [n for n in range(1, len(w) - at + 1) if any(w[s : s + n] == w[at : at + n] for s in range(at))]
            assert length == max(seen, default=1)
            assert source == at if not seen else source < at and w[source : source + length] == w[at : at + length]
            at += length
        assert at == len(w)


def test_runs_of_long_texts_take_time_in_proportion():
    for words in ([0] * 100_000, list(range(700)) * 150, [k % 3 + 7 * (k // 9000) for k in range(100_000)]):
        runs = periodic_runs.find_runs(words)
        assert runs and all(n >= max(6, 4 * q) for _, n, q in runs)
    assert periodic_runs.find_runs([0] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.find_runs(list(range(700)) * 150) == [(0, 105_000, 700)]


TEXTS = [
    (1, "a b c d"), (2, " ".join(["spam"] * 9) + " end"), (3, "x " + "p q r " * 5 + "y"), (4, None), (5, ""), (6, " \n\t "), (7, "na na na na na na"), (7, "na na na na na na"), (None, "go go go go go go go"),
    (8, "é 日本 é 日本 é 日本 é 日本 é 日本"), (9, "no-break space " * 8), (10, " ".join(f"w{k}" for k in range(4000)) + " z z z z z z z"),
]


@pytest.fixture(scope="module")
def texts(spark):
    more = [(100 + k, " ".join(f"v{(k * j * j) % 23}" for j in range(20 + k)) if k % 3 else f"one{k}") for k in range(60)]
    return spark.createDataFrame([(i, t, "en", None, 0) for i, t in TEXTS + more], SCHEMA), TEXTS + more


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_periodic_runs(spark, texts):
    docs, rows = texts
    clash = docs.withColumn("runs", F.lit("clash")).withColumn("_text", F.lit(3)).withColumn("a.b", F.lit(1))
    out = periodic_runs.periodic_runs(clash)
    assert out.columns == [*docs.columns, "_text", "a.b", "runs", "collapsed"]

    def brute(text):
        w = words_of(text)
        runs = runs_by_definition(w, 6, 4)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        return runs, " ".join(x for k, x in enumerate(w) if k not in gone)

    order = lambda rows: sorted(rows, key=repr)
    got = order((r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r._text) for r in out.collect())
    assert got == order((i, *brute(t), 3) for i, t in rows)
    assert dict((i, c) for i, _, c, _ in got)[2] == "spam end" and dict((i, c) for i, _, c, _ in got)[3] == "x p q r y"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_of_runs(spark, texts, tmp_path):
    docs, rows = texts
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def brute(i, text):
        w = words_of(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = runs_by_definition(w, 6, 4)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return i, len(runs), s, n, q, n and 1000 * n // q, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))

    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and len(words_of(t)) > 8 for i, t in rows if i is not None)


# ---- fingerprints ----
def phrases_by_definition(text):
    known, held = set(), ""
    for c in text:
        held += c
        if held not in known:
            known.add(held)
            held = ""
    return known


def test_phrases_and_edits():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdé\U0001f600 ") for _ in range(rng.randint(0, 90)))
        ends = lz_fingerprint.phrase_ends(text, 0, {})
        assert {text[a:b] for a, b in zip([0, *ends], ends, strict=False)} == phrases_by_definition(text)
        cut, tail = rng.randint(0, len(text)), "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert lz_fingerprint.fingerprints_of_edit(text, cut, tail) == (lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(text[:cut] + tail))


def test_likeness_estimates_the_share_of_common_phrases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    errors = []
    for k in range(60):
        a = " ".join(word() for _ in range(300))
        b = a[: len(a) * k // 60] + " ".join(word() for _ in range(300 - 5 * k))
        x, y = phrases_by_definition(a), phrases_by_definition(b)
        errors.append(lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    empty, one = lz_fingerprint.fingerprint(""), lz_fingerprint.fingerprint("a")
    assert lz_fingerprint.likeness(empty, empty) == 1 == lz_fingerprint.likeness(one, one) and lz_fingerprint.likeness(empty, one) == 0
    assert len(empty) == lz_fingerprint.SLOTS * lz_fingerprint.DIGITS == len(one)


@pytest.mark.parametrize("ranges", [1, 40])
def test_compare_with_next(spark, texts, ranges, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "RANGES", ranges)
    docs, rows = texts
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, range int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        end = len(t) // 3
        edited = t[: len(t) - end] + u[:end]
        a, b, c = map(lz_fingerprint.fingerprint, (t, edited, u))
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c))
    got = {r.doc_id: tuple(r)[1:] for r in lz_fingerprint.compare_with_next(docs).collect()}
    assert got == want
    assert lz_fingerprint.compare_with_next(docs.limit(0)).count() == 0
    alone = lz_fingerprint.compare_with_next(docs.where("doc_id = 3")).first()
    assert alone.near_next == 1 and alone.n_chars == 33


def test_compare_repeated_rows_and_ids(spark):
    rows = [(5, "abc abd abe"), (5, "abc abd abe"), (5, "other text"), (None, "x"), (None, "x"), (None, None), (-(2**63), "low")] * 20
    got = lz_fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)


def test_fingerprint_columns(spark, texts):
    docs, rows = texts
    out = lz_fingerprint.add_fingerprints(docs.withColumn("fingerprint", F.lit(1)))
    out = out.withColumn("near", lz_fingerprint.likeness_of("fingerprint", F.lit(lz_fingerprint.fingerprint("na na na na na na")))).collect()
    assert {r.fingerprint for r in out if r.doc_id == 7} == {lz_fingerprint.fingerprint("na na na na na na")} and all((r.near == 1) == (r.doc_id == 7) for r in out)


# ---- hard negatives ----
def negatives_by_definition(rows, scale=256, lower=80, upper=100, k=5, positives=5):
    vectors = {(i, c): [int(np.floor(float(x) * scale)) for x in v] for i, c, v in rows}
    out = []
    for (a, label), v in vectors.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, c) for (i, c), w in vectors.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(i, t) for t, i, c in scored if c != label and lower * -s <= 100 * -t <= upper * -s][:k]
            out += [(a, p, r, i, -s, -t) for r, (i, t) in enumerate(fits, 1)]
    return sorted(out)


ODD = [(3000, None, [1.0] * 8), (3100, 1, None), (3200, 1, [float("nan")] * 8), (3300, 1, [1.0, None] + [1.0] * 6), (3400, 1, [float("inf")] + [1.0] * 7), (None, 1, [1.0] * 8), (3500, 1, [1.0, 2.0])]
KIND = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "SCORES", 128)
    rng = np.random.default_rng(6)
    rows = [(k, int(k % 4), rng.normal(0.2, 1, 8).tolist()) for k in range(1001)]
    # one vector and label holds a third of all rows; ties go to the smaller id
    rows += [(5000 + k, 2, rows[100][2]) for k in range(500)]
    df = spark.createDataFrame(rows + ODD + rows[:3], KIND).withColumn("row", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 100 == 0).collect())
    want = negatives_by_definition(rows)
    assert got == want and len({a for a, *_ in want}) > 10
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id = 100"), F.col("id") % 100 == 0).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    """Exact beyond 2**53; beyond 64 bits a score stays at the bound."""
    big = [(0, 1, [2.0**30, 1.0]), (1, 1, [2.0**30, 3.0]), (2, 2, [2.0**30, 2.0]), (3, 2, [2.0**30, 4.0]), (100, 2, [-1.0, 0.0]), (4, 2, [-2.0, 0.0]), (5, 1, [-1.7, 0.0])]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(big, KIND), F.col("id") % 100 == 0, scale=1).collect())
    assert got == negatives_by_definition(big, scale=1) and (0, 1, 1, 2, 2**60 + 3, 2**60 + 2) in got
    huge = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 3.0]), (2, 2, [1e300, 2.0])]
    assert [tuple(r)[:4] for r in hard_negatives.hard_negatives(spark.createDataFrame(huge, KIND), F.col("id") == 0).collect()] == [(0, 1, 1, 2)]
