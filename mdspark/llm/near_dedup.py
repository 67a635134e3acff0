"""Near duplicates by SuperMinHash signatures, banding, verification and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import Workspace, connected_components

#: Slots of a signature; BANDS bands of ROWS slots. A pair at 0.8 is missed with a chance of (1 - 0.8**4)**32 < 5e-8.
SLOTS, BANDS, ROWS = 128, 32, 4
#: Elements handled at once, so that their permutations stay within a few megabytes.
BLOCK = 1 << 16

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MULTIPLIERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        steps = np.full(size, base & (1 << 64) - 1, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased."""
    codes = np.frombuffer(text.lower(), np.uint8)
    if not len(codes):
        return np.empty(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * _power(_BASE, len(codes)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(codes) + 1)[starts])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence if it has fewer words; none without words."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total += hashes[k : len(hashes) - width + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mix(total))


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (len(sets) x SLOTS), each value its round in the upper and its random part in the lower half.

    All elements of a block go through the rounds together: in round j an element draws a random
    part and the next place of its own random permutation. A document stops as soon as all of its
    slots hold values of rounds up to j, as later ones are larger; large sets stop after round 0.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= BLOCK):
            size += len(sets[last])
            last += 1
        _rounds(sets[first:last], out[first:last])
        first = last
    return out


def _rounds(sets: list[np.ndarray], sig: np.ndarray) -> None:
    flat = sig.reshape(-1)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = None
    for j in range(SLOTS):
        if not len(elements):
            return
        drawn = mix(elements + _U((j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        at = (_U(j) + (((drawn & _U(0xFFFFFFFF)) * _U(SLOTS - j)) >> _U(32))).astype(np.int64)
        if places is None:
            slot = at
        else:
            rows = np.arange(len(elements))
            slot = places[rows, at].astype(np.int64)
            places[rows, at] = places[:, j]
        np.minimum.at(flat, owner * SLOTS + slot, (_U(j) << _U(32)) | (drawn >> _U(32)))
        going = (sig.max(axis=1) >= (_U(j + 1) << _U(32)))[owner]
        if not going.all():
            elements, owner, at = elements[going], owner[going], at[going]
            if places is not None:
                places = places[going]
        if places is None and len(elements):
            places = np.broadcast_to(np.arange(SLOTS, dtype=np.uint8), (len(elements), SLOTS)).copy()
            places[np.arange(len(elements)), at] = 0


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit hashes a row; the number of the band is part of each."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total * _MULTIPLIERS[40 + k] + parts[:, :, k])
    return total


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, print, bands): size and 128-bit print of each document's set, and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set((t.as_py() or "").encode(), words) for t in batch.column(1)]
            bands = band_hashes(super_minhash(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                    pa.array(list(bands), pa.list_(pa.int64())),
                ],
                ["id", "n", "print", "bands"],
            )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, n long, print string, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set((t.as_py() or "").encode(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "elements"])

    return docs.mapInArrow(run, "id long, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _across_components(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may still reach the similarity.

    Prefix filter: with the elements of each set in one common order, rarest first, two sets that
    share s elements share one before their last s - 1. The order keeps what all of a large group
    have in common out of nearly all comparisons. No pair that reaches the similarity is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                e = np.frombuffer(raw.as_py(), np.int64)
                n = np.full(len(e), len(e))
                columns = [np.full(len(e), key, np.int64), np.full(len(e), c, np.int64), n, e]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "c", "n", "e"])

    elements = sets.select("id", "c", "elements").mapInArrow(run, "id long, c long, n long, e long")
    elements = ws.write(elements, "elements")
    often = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    shared = elements.join(often, "e").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    at = shared.select("id", "c", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode("s").alias("k", "x"))
    at = at.select("id", "c", "n", "x.e", (F.col("n") - F.col("alone") - F.col("k")).alias("rest"))
    at = at.where(100 * F.col("rest") >= percent * F.col("n"))
    x, y = at.alias("x"), at.alias("y")
    needed = percent * (F.col("x.n") + F.col("y.n"))
    fits = ((100 + percent) * F.col("x.rest") >= needed) & ((100 + percent) * F.col("y.rest") >= needed)
    pairs = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & fits)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _sizes_fit(m: Column, n: Column, percent: int) -> Column:
    """A smaller set than this share of the larger can't reach the similarity."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Documents are linked when the Jaccard similarity of their sets of word shingles is at least
    ``percent`` hundredths, confirmed on full sets; component_id is the smallest id that links
    lead to, kept marks that document. Null and empty texts have no shingles and no links. Rows
    that repeat an id repeat its result; if their texts differ, they are one document, compared by
    the least of its sets in byte order. A null id stands alone and is kept. Texts of any length
    are read whole. An empty table gives an empty table; other columns play no part.

    Equal sets count as one class, so a group of copies is pre-aggregated to one row. Classes
    that share a band are compared first with the smallest of the band; what that leaves in
    several components is compared across components only. So no pair that shares a band goes
    unseen, and a large group of near copies needs a number of comparisons in proportion to it.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    sig = ws.write(signatures(docs, words, key, text), "sig")
    some = sig.where("n > 0 AND id IS NOT NULL")
    classes = ws.write(some.groupBy("print").agg(F.min("id").alias("rep")), "classes")
    reps = some.join(classes.select("print", F.col("rep").alias("id")), ["print", "id"]).select("id", "n", "bands")
    buckets = ws.write(reps.select("id", "n", F.explode("bands").alias("h")), "buckets")
    shared = buckets.groupBy("h").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high")).where("low.id < high")
    hubs = ws.write(shared.select("h", F.col("low.id").alias("a"), F.col("low.n").alias("na")), "hubs")
    crowded = ws.write(buckets.join(hubs, "h"), "crowded")
    ws.drop("buckets", "hubs")

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    wanted = crowded.select("id").distinct()
    sets = ws.write(_sets(texts.join(wanted, "id", "left_semi"), words).groupBy("id").agg(F.min("elements").alias("elements")), "sets")
    first = crowded.where((F.col("id") != F.col("a")) & _sizes_fit(F.col("n"), F.col("na"), percent))
    tried = ws.write(first.select("a", F.col("id").alias("b")).distinct(), "tried")
    edges = ws.write(_verified(tried, sets, percent), "edges")

    comps = ws.write(connected_components(ws, edges, "cc"), "comps")
    at = crowded.join(comps, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("c"))
    at = ws.write(at, "at")
    split = at.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
    left = ws.write(at.join(split, "h", "left_semi").select("id", "c").distinct(), "left")
    across = _across_components(ws, sets.join(left, "id"), percent).join(tried, ["a", "b"], "left_anti")
    more = ws.write(_verified(across, sets, percent), "more")
    if more.isEmpty():
        final = comps
    else:
        final = ws.write(connected_components(ws, edges.unionByName(more), "cd"), "final")
    ws.drop("crowded", "sets", "tried", "at", "left", "elements")

    of_class = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("print", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("id", "n", F.when(F.col("id").isNull() | (F.col("n") == 0), None).otherwise(F.col("print")).alias("print"))
    out = out.join(of_class, "print", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("id")).alias("kept"),
    )
