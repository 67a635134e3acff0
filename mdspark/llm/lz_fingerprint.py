"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest piece not yet in the dictionary, which it then
joins (the incremental parse of 1978). The set of phrases says which strings recur in a text;
two texts that compress well with each other's dictionary share many. The phrases are hashed
and dealt into SLOTS slots by their hash, each slot keeps its least hash, and the share of equal
slots among those that either text fills estimates the Jaccard similarity of the two sets.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdspark.llm.common import shuffle_partitions, small_arrow_batches
from mdspark.llm.near_dedup import _BASE, _INVERSE, _power, mix

#: Slots of a fingerprint, hexadecimal digits of each; a slot that no phrase falls into is all zeros.
SLOTS, DIGITS = 128, 4
#: Ranges for each shuffle partition, so that partitions which several of them share come out alike.
RANGES = 4
_U, _NONE = np.uint64, np.iinfo(np.uint64).max
_MIXED = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def phrase_ends(text: str, start: int, trie: dict, added: list | None = None) -> list[int]:
    """Ends of the phrases from ``start`` on; they join ``trie``, whose nodes are dicts by character, None where nothing follows.

    What is left at the end, if anything, is a phrase that is known. ``added`` takes the node and
    character of each new phrase.
    """
    ends, node = [], trie
    for at, c in enumerate(text[start:] if start else text, start + 1):
        if c in node:
            below = node[c]
            if below is None:
                below = node[c] = {}
            node = below
        else:
            node[c] = None
            if added is not None:
                added.append((node, c))
            ends.append(at)
            node = trie
    return ends


def _sums(text: str, before: int = 0, total: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial over the mixed code points; the text has ``before`` others before it, which sum to ``total``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = total
    terms = _MIXED[codes] if not len(codes) or codes.max() < len(_MIXED) else mix(codes.astype(np.uint64) + _U(1))
    np.cumsum(terms * _power(_BASE, before + len(codes))[before:], out=sums[1:])
    sums[1:] += sums[0]
    return sums


def _slots(sums: np.ndarray, start: int, ends: list[int]) -> np.ndarray:
    """The least hash in each slot of the phrases with these ends, the first of which begins at ``start``; the greatest number for an empty slot. sums[0] belongs to ``start``."""
    least = np.full(SLOTS, _NONE)
    if ends:
        stops = np.array(ends) - start
        starts = np.concatenate(([0], stops[:-1]))
        hashes = mix((sums[stops] - sums[starts]) * _power(_INVERSE, start + len(sums))[start:][starts] + (stops - starts).astype(np.uint64))
        np.minimum.at(least, (hashes % _U(SLOTS)).astype(np.int64), hashes // _U(SLOTS))
    return least


def _shown(least: np.ndarray) -> str:
    """DIGITS hexadecimal digits a slot: 1 and more for a hash, 0 for none."""
    values = mix(least) % _U(16**DIGITS - 1) + _U(1)
    values[least == _NONE] = 0
    return values.astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    """SLOTS * DIGITS hexadecimal digits; equal texts have equal fingerprints, an empty text has zeros."""
    return _shown(_slots(_sums(text), 0, phrase_ends(text, 0, {})))


def fingerprints_of_edit(text: str, cut: int, tail: str) -> tuple[str, str]:
    """Fingerprints of the text, and of its first ``cut`` characters with ``tail`` after them; what both begin with is parsed once."""
    trie: dict = {}
    head = text[:cut]
    common = phrase_ends(head, 0, trie)
    sums, at = _sums(head), common[-1] if common else 0
    least, total = _slots(sums, 0, common), int(sums[at])

    def with_rest(rest: str, added: list | None) -> str:
        ends = phrase_ends(rest, 0, trie, added)
        return _shown(np.minimum(least, _slots(_sums(rest, at, total), at, [at + e for e in ends])))

    added: list = []
    own = with_rest(text[at:], added)
    for node, c in reversed(added):
        del node[c]
    return own, with_rest(head[at:] + tail, None)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of the phrase sets of two fingerprints, 0 to 1; two empty ones are alike."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v.encode(), f"S{DIGITS}") for v in (a, b))
    filled = (x != b"0" * DIGITS) | (y != b"0" * DIGITS)
    return float(((x == y) & filled).sum() / filled.sum())


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """The likeness of two columns of fingerprints; null if one is null."""

    @F.arrow_udf("double")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else likeness(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return compare(a, b)


def add_fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text in column ``to`` (which replaces a column so named).

    Null counts as empty. Whole texts are parsed, in time and memory that grow with them. Each
    row by itself: no shuffle, repeated rows repeat their fingerprint, an empty table gives an
    empty table, other columns stay as they are.
    """
    small_arrow_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.string())

    return docs.withColumn(to, run(F.col(f"`{text}`")))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """Each text's fingerprint held against that of the next text, and of itself with its end replaced by the next one's beginning.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for
    each row. Rows are in descending order of ``key``, nulls last, equal ones by a hash of the
    text; the next of the last is the first, and a single row is its own next. The edited text has
    the last floor(n / share) of the n code points replaced by as many of the next text, or all.
    Null counts as empty. Repeated rows follow each other. Whole texts are read; an empty table
    gives an empty table; other columns are not read.

    The texts are shuffled once, into ranges of the key whose limits are quantiles. The first row
    of each range goes to the range before it, too: one row a range, found from the keys alone. A
    task holds two texts at a time, however many rows its range has.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    n = RANGES * shuffle_partitions(spark)
    limits = rows.where("id IS NOT NULL").approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n)
    limits = F.array(*(F.lit(x).cast("long") for x in sorted({int(x) for x in limits}))).cast("array<bigint>")
    # range 0 has the largest keys, the last one the rows without a key
    above = F.when(F.col("id").isNull(), F.size(limits) + 1).otherwise(F.size(F.filter(limits, lambda x: x > F.col("id"))))
    rows = rows.select("id", "body", F.xxhash64("body").alias("tie"), above.alias("range"))
    heads = [(h.range, h.head.id, h.head.tie) for h in rows.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head")).orderBy("range").collect()]
    if not heads:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(*h, heads[k - 1][0]) for k, h in enumerate(heads)], "range int, first_id long, first_tie long, before int")
    own, again = F.struct("range", F.lit(False).alias("again")), F.struct(F.col("before").alias("range"), F.lit(True).alias("again"))
    is_head = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    dealt = rows.join(F.broadcast(table), "range")  # a row a range
    dealt = dealt.select("id", "body", "tie", F.explode(F.when(is_head, F.array(own, again)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("at.range", "at.again", "id", "tie", "body").repartition("range")
    dealt = dealt.sortWithinPartitions("range", "again", F.col("id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("range", "again", "id", "body").mapInArrow(_walk(key, share), schema)


def _walk(key: str, share: int):
    """Task that holds each row of a range against the one after it; the last, which is there again, only ends the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # tries have no cycles, and are gone with their text
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, waiting, done = None, None, []

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for place, again, name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == place:
                    _, number, text = held
                    end = len(text) // share
                    cut, tail = len(text) - end, body[:end]
                    own, edited = fingerprints_of_edit(text, cut, tail)
                    if waiting:
                        done.append((*waiting, likeness(waiting[3], own)))
                    sha = hashlib.sha256((text[:cut] + tail).encode("utf-8", "surrogatepass")).hexdigest()
                    waiting = (number, len(text), sha, own, edited, likeness(own, edited))
                    if again:
                        done.append((*waiting, likeness(own, fingerprint(body))))
                        waiting = None
                held = None if again else (place, name, body)
            if len(done) >= 64:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    return run
