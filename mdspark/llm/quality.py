"""Quality scores by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import small_arrow_batches

#: Hash buckets for words, rank of the interactions, labelled rows that are fitted to at most, passes over them.
BUCKETS, RANK, MAX_FIT_ROWS, PASSES = 1 << 16, 8, 6000, 6
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_SYMBOLS = b"!#$%&*|@+=<>"
N_STATS = 12 + len(_SYMBOLS)
_CLASS = np.zeros((256, 6))
for _b in range(256):
    _CLASS[_b] = [65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _b in b" \t\n\r\v\f", 32 < _b < 127 and not chr(_b).isalnum(), _b >= 128]


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    """Structure and size of a text; zeros for an empty one."""
    raw = text.encode()
    if not words:
        return [0.0] * N_STATS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, space, punctuation, wide = (counts @ _CLASS / len(raw)).tolist()
    lines = text.split("\n")
    n = len(words)
    symbols = (counts[list(_SYMBOLS)] / n).tolist()
    return [
        np.log1p(len(raw)).item(), np.log1p(n).item(), upper / (upper + lower + 1e-9), digit, space, punctuation, wide, len(raw) / n / 10,
        distinct / n, np.log1p(len(lines)).item(), len(set(lines)) / len(lines), sum(map(str.isupper, words)) / n,
        *[min(s, 2.0) for s in symbols],
    ]


def features(text: str | None) -> tuple[np.ndarray, list[float]]:
    """Hash buckets of the distinct lower-cased words, and the statistics."""
    text = text or ""
    words = text.split()
    distinct = set(text.lower().split())
    ids = np.fromiter((zlib.crc32(w.encode()) for w in distinct), np.uint32, len(distinct)) & np.uint32(BUCKETS - 1)
    return np.unique(ids).astype(np.int64), statistics(text, words, len(distinct))


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def sums(self, ids: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids with their values and rows, the dense part, and for each row sum v x; then the logits."""
        x = self.dense(stats)
        sizes = np.array([len(i) for i in ids])
        row = np.repeat(np.arange(len(ids)), sizes)
        flat = np.concatenate(ids) if len(row) else np.empty(0, np.int64)
        value = (1 / np.sqrt(np.maximum(sizes, 1)))[row]
        v = self.factors[flat] * value[:, None]
        dense_v = self.factors[BUCKETS:]
        total, squares = x @ dense_v, (x**2) @ (dense_v**2)
        linear = self.bias + x @ self.weights[BUCKETS:]
        if len(row):
            for k in range(self.factors.shape[1]):
                total[:, k] += np.bincount(row, v[:, k], len(ids))
                squares[:, k] += np.bincount(row, v[:, k] ** 2, len(ids))
            linear = linear + np.bincount(row, self.weights[flat] * value, len(ids))
        return flat, value, row, total, linear + 0.5 * (total**2 - squares).sum(axis=1)

    def score(self, ids: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(ids, stats)[-1], -40, 40)))


def fit(ids: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, AdaGrad over small batches. Without rows of both labels it scores the share of ones (or 0.5)."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    d = BUCKETS + N_STATS
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if n else (np.zeros(N_STATS), np.ones(N_STATS))
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(d), rng.normal(0, 0.02, (d, RANK)), mean, scale)
    if not 0 < labels.sum() < n:
        model.factors[:] = 0
        return model
    gw, gv, gb = np.full(d, 1e-4), np.full((d, RANK), 1e-4), 1e-4
    for step in range(PASSES):
        rate = 0.1 / (1 + step)
        order = rng.permutation(n)
        for at in range(0, n, 32):
            rows = order[at : at + 32]
            x = model.dense(stats[rows])
            flat, value, row, total, logit = model.sums([ids[r] for r in rows], stats[rows])
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[rows]) / len(rows)
            gb += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(gb)
            dense = slice(BUCKETS, d)
            g = error @ x + 1e-5 * model.weights[dense]
            gw[dense] += g**2
            model.weights[dense] -= rate * g / np.sqrt(gw[dense])
            v = model.factors[dense]
            g = x.T @ (error[:, None] * total) - ((error @ x**2)[:, None] * v) + 1e-4 * v
            gv[dense] += g**2
            model.factors[dense] -= rate * g / np.sqrt(gv[dense])
            if len(flat):
                used, place = np.unique(flat, return_inverse=True)
                e = error[row] * value
                g = np.bincount(place, e, len(used)) + 1e-5 * model.weights[used]
                gw[used] += g**2
                model.weights[used] -= rate * g / np.sqrt(gw[used])
                v = model.factors[used]
                own = np.bincount(place, e * value, len(used))
                for k in range(RANK):
                    g = np.bincount(place, e * total[row, k], len(used)) - own * v[:, k] + 1e-4 * v[:, k]
                    gv[used, k] += g**2
                    model.factors[used, k] -= rate * g / np.sqrt(gv[used, k])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> FactorisationMachine:
    """Fits to at most ``max_rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Labels other than 0 and 1 are left out; of several labels of a document the largest counts, of
    several texts of an id the least in order. Rows without an id are not learnt from.
    The chosen ids (bounded by max_rows) are broadcast; what comes to the driver is their
    features, not their texts.
    """
    small_arrow_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # one text for each id, however often rows repeat it
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i for i, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.float64())), batch.column(2).cast(pa.int32())],
                ["doc_id", "ids", "stats", "label"],
            )

    rows = sample.mapInArrow(run, "doc_id long, ids array<bigint>, stats array<double>, label int").toArrow().sort_by("doc_id")
    ids = [np.array(i.as_py(), np.int64) for i in rows.column("ids")]
    stats = np.array(rows.column("stats").to_pylist(), float).reshape(-1, N_STATS)
    return fit(ids, stats, rows.column("label").to_numpy().astype(float))


def score_quality(df: DataFrame, model: FactorisationMachine, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1, in column ``to`` (which replaces a column so named).

    Null and empty texts have a score of their own like any other, and texts of any length are read
    whole. Rows that repeat are scored alike; an empty table gives an empty table. No shuffle; the
    model, of a fixed size, is broadcast.
    """
    small_arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [features(t.as_py()) for t in texts]
        if not found:
            return pa.array([], pa.float64())
        return pa.array(shared.value.score([i for i, _ in found], np.array([s for _, s in found])), pa.float64())

    return df.withColumn(to, score(text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted (1 if score >= threshold) and held_out, which replace columns so named.

    held_out is false for a null id. Without labels every score is 0.5. An empty table gives an
    empty table; rows that repeat an id each have their own score.
    """
    scored = score_quality(docs, train(docs, labels))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.withColumn("predicted", predicted).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
