"""Removal of long repeated byte strings, by column-wise construction of suffix order and common prefixes.

Inserting one symbol of every whole document per round needs as many rounds over the collection
as the longest document has bytes. Windows of the sought length are therefore first dealt into
groups that hold all their equals (see ``_segments``); within a group the strings are aligned, so
the columns are at most 2 * length, and each round inserts one symbol of every string, re-sorts
the suffixes stably by symbol (the step of the Burrows-Wheeler transform) and updates the common
prefixes of neighbours. Only the newest suffix of each string has to be kept, because equal
windows of a group stand in the same column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdspark.llm.common import Workspace
from mdspark.llm.near_dedup import _BYTE, _INVERSE, _power, mix, word_hashes

#: Bytes of the gram that deals windows into groups.
GRAM = 50
#: Windows of a document handled at once; positions have to fit below the hash in 64 bits.
CHUNK = 1 << 21
_POSITION = np.uint64((1 << 24) - 1)
#: Strings whose columns are built together, and the largest group that is built at once; larger ones are built in parts.
BLOCK, LARGE = 1 << 13, 1 << 14
#: Bytes that stand for a word where runs of words are sought.
CODE = 4


def _gram_hashes(codes: np.ndarray, step: int) -> np.ndarray:
    """A hash of the gram at every ``step``-th place."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * _power(0x9E3779B97F4A7C15, len(codes)), out=sums[1:])
    return mix((sums[GRAM:][::step] - sums[:-GRAM][::step]) * _power(_INVERSE, len(codes) + 1)[: len(codes) - GRAM + 1][::step])


def _segments(text: bytes, length: int, step: int = 1) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, anchor, first, last) of each run of windows [first, last] that share an anchor; windows begin at every ``step``-th byte.

    The anchor of a window is the place of its least gram hash, so equal windows have equal
    anchor hashes at the same place in the window. Runs part all windows of a document.
    """
    out = []
    codes = np.frombuffer(text, np.uint8)
    width = (length - GRAM) // step + 1
    for base in range(0, max(0, len(codes) - length + 1), CHUNK):
        part = codes[base : base + CHUNK + length - 1]
        hashes = _gram_hashes(part, step)
        least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: reach - width], least[width - reach :])
        anchor = (least[: (len(part) - length) // step + 1] & _POSITION).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
        out.append((hashes[anchor[first]].view(np.int64), anchor[first] * step + base, first * step + base, last * step + base))
    return out


def _print(piece: bytes, offset: int) -> bytes:
    return hashlib.blake2b(piece, digest_size=16, salt=offset.to_bytes(4, "little")).digest()


_OCCURRENCE = "k long, k2 long, h long, print binary, p long, lo int, hi int"


def _occurrences(docs: DataFrame, length: int, step: int) -> DataFrame:
    """A row for each run: lo and hi are the bounds of its bytes, counted from the anchor p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[bytes] = []
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for key, key2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                for hashes, anchors, first, last in _segments(raw, length, step):
                    prints += [_print(raw[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), anchors.tolist(), strict=True)]
                    row = np.full(len(first), key, np.int64), np.full(len(first), key2, np.int64), hashes, anchors, (first - anchors).astype(np.int32), (last + length - anchors).astype(np.int32)
                    for column, values in zip(columns, row, strict=True):
                        column.append(values)
            if prints:
                k, k2, h, p, lo, hi = (pa.array(np.concatenate(c)) for c in columns)
                yield pa.RecordBatch.from_arrays([k, k2, h, pa.array(prints, pa.binary()), p, lo, hi], ["k", "k2", "h", "print", "p", "lo", "hi"])

    return docs.select("k", "k2", "bytes").mapInArrow(run, _OCCURRENCE)


def _strings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs, cut from a document that holds each; n is how often a run occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                rows += [(r["h"], r["print"], r["lo"], raw[r["p"] + r["lo"] : r["p"] + r["hi"]], r["n"]) for r in runs.as_py()]
            rows = [r for r in rows if _print(r[3], -r[2]) == r[1]]
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "print", "lo", "bytes", "n"])

    runs = wanted.groupBy("k", "k2").agg(F.collect_list(F.struct("h", "print", "p", "lo", "hi", "n")).alias("runs"))
    return docs.join(runs, ["k", "k2"]).select("bytes", "runs").mapInArrow(run, "h long, print binary, lo int, bytes binary, n long")


def columnwise_repeats(groups: np.ndarray, offsets: np.ndarray, strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the first and last column at which ``length`` of its bytes are also in another string of its group.

    ``groups`` is ascending. Columns count from the strings' common place (offsets[i] in string
    i); strings without such a column get (1, 0) times a large number. Right to left, a symbol
    of each string a round.
    """
    m = len(strings)
    far = 1 << 30
    left, right = -int(offsets.max()), max(len(s) - int(o) for s, o in zip(strings, offsets, strict=True))
    table = np.full((right - left, m), 256, np.uint16)
    for i, s in enumerate(strings):
        at = -int(offsets[i]) - left
        table[at : at + len(s), i] = np.frombuffer(s, np.uint8)
    group_key = groups * 512
    order, prefix = np.arange(m), np.zeros(m + 1, np.int64)
    low, high = np.full(m, far), np.full(m, -far)
    for column in range(right - left - 1, -1, -1):
        symbol = table[column]
        keys = (group_key + symbol)[order]
        moved = np.argsort(keys, kind="stable")
        keys = keys[moved]
        same = np.zeros(m, bool)
        same[1:] = (keys[1:] == keys[:-1]) & ((keys[1:] & 511) < 256)
        fresh = np.zeros(m + 1, np.int64)
        v = np.flatnonzero(same)
        if len(v):
            upper, lower = moved[v], moved[v - 1] + 1
            near = lower == upper
            fresh[v[near]] = prefix[upper[near]] + 1
            if not near.all():
                bounds = np.empty(2 * int((~near).sum()), np.int64)
                bounds[::2], bounds[1::2] = lower[~near], upper[~near] + 1
                fresh[v[~near]] = np.minimum.reduceat(prefix, bounds)[::2] + 1
        order, prefix = order[moved], fresh
        found = np.maximum(prefix[:-1], prefix[1:]) >= length
        if found.any():
            who = order[found]
            low[who] = column + left
            high[who] = np.maximum(high[who], column + left)
    return low, high


_FOUND = "h long, print binary, lo int, hi int"


def _small_groups(strings: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes, int]] = []

        def built() -> pa.RecordBatch:
            names = np.array([r[0] for r in held], np.int64)
            groups = np.concatenate(([0], np.cumsum(names[1:] != names[:-1])))
            low, high = columnwise_repeats(groups, np.array([-r[2] for r in held]), [r[3] for r in held], length)
            keep = np.array([k for k in np.flatnonzero(low <= high).tolist() if not k or held[k][:2] != held[k - 1][:2]], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(names[keep]),
                    pa.array([held[k][1] for k in keep], pa.binary()),
                    pa.array(low[keep].astype(np.int32)),
                    pa.array((high[keep] + length).astype(np.int32)),
                ],
                ["h", "print", "lo", "hi"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue
                if len(held) >= BLOCK and held[-1][0] != row[0]:
                    yield built()
                    held.clear()
                held += [row] * min(2, row[4])  # a string that occurs more often is inserted twice
        if held:
            yield built()

    dealt = strings.select("h", "print", "lo", "bytes", "n").repartition(F.col("h")).sortWithinPartitions("h", "print")
    return dealt.mapInArrow(run, _FOUND)


_WINDOW = "h long, print binary, lo int, hi int, w binary"


def _large_groups(ws: Workspace, strings: DataFrame, length: int, tag: str, step: int) -> DataFrame:
    """The same for groups too large for one task: dealt into parts of about LARGE strings, each built by columns.

    What a part has twice is found in it. Of each other window it sends one row, and of those it
    has found, too; what comes from two parts is repeated for the strings that have it once in
    theirs. So a window has at most one row a part, however many strings share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int, bytes, int]] = []

        def built() -> pa.RecordBatch:
            low, high = columnwise_repeats(np.zeros(len(held), np.int64), np.array([-r[3] for r in held]), [r[4] for r in held], length)
            rows, seen, before = [], set(), None
            for (h, _, print_, lo, raw, _), first, last in zip(held, low.tolist(), high.tolist(), strict=True):
                if print_ == before:
                    continue
                before = print_
                if first <= last:
                    rows.append((h, print_, first, last + length, None))
                for k in range(0, len(raw) - length + 1, step):
                    window = hashlib.blake2b(raw[k : k + length], digest_size=16).digest()
                    if (lo + k, window) not in seen:
                        seen.add((lo + k, window))
                        rows.append((h, None if first <= lo + k <= last else print_, lo + k, lo + k + length, window))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["h", "print", "lo", "hi", "w"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] == row[:3]:
                    continue
                if held and held[-1][:2] != row[:2]:
                    yield built()
                    held.clear()
                held += [row] * min(2, row[5])
        if held:
            yield built()

    part = F.pmod(F.xxhash64("print"), F.ceil(F.col("kinds") / LARGE)).cast("long")
    dealt = strings.select("h", part.alias("part"), "print", "lo", "bytes", "n").repartition("h", "part").sortWithinPartitions("h", "part", "print")
    windows = ws.write(dealt.mapInArrow(run, _WINDOW), f"{tag}-windows")
    often = windows.where("w IS NOT NULL").groupBy("h", "lo", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    across = windows.where("w IS NOT NULL AND print IS NOT NULL").join(often, ["h", "lo", "w"], "left_semi")
    hits = across.unionByName(windows.where("w IS NULL")).groupBy("h", "print")
    return hits.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _merged(found: list | None) -> list[list[int]]:
    """Maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _cut(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept, words = [], [], [], []
            for text, found, repeated in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                raw, merged = text.as_py(), _merged(found.as_py())
                edges = [0, *(x for m in merged for x in m), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                words.append(sum((b - a) // CODE for a, b in _merged(repeated.as_py())))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept", "repeated_words"])

    span = T.StructType().add("start", T.LongType()).add("stop", T.LongType())
    schema = T.StructType([docs.schema["doc_id"]])
    schema = schema.add("n_bytes", T.LongType()).add("removed", T.ArrayType(span)).add("kept", T.BinaryType()).add("repeated_words", T.LongType())
    return docs.select("doc_id", "bytes", "found", "repeated").mapInArrow(run, schema)


def _repeats(ws: Workspace, docs: DataFrame, length: int, tag: str, step: int = 1) -> DataFrame:
    """(k, k2, found) of the rows of ``docs`` (k, k2, bytes) that have a string of ``length`` bytes which also starts elsewhere, at every ``step``-th byte."""
    occurrences = ws.write(_occurrences(docs, length, step), f"{tag}-occurrences")
    runs = occurrences.groupBy("h", "print").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k", "k2", "p", "lo", "hi"))
    )
    runs = ws.write(runs, f"{tag}-runs")
    groups = runs.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    runs = ws.write(runs.join(groups, "h"), f"{tag}-grouped")
    ws.drop(f"{tag}-runs")
    strings = ws.write(_strings(docs, runs), f"{tag}-strings")
    sizes = runs.where(F.col("kinds") > LARGE).select("h", "kinds").distinct()
    sizes = ws.write(sizes, f"{tag}-large")
    found = _small_groups(strings.join(sizes, "h", "left_anti"), length)
    found = ws.write(found.unionByName(_large_groups(ws, strings.join(sizes, "h"), length, tag, step)), f"{tag}-found")
    ws.drop(f"{tag}-strings", f"{tag}-large", f"{tag}-windows")
    hits = occurrences.select("k", "k2", "h", "print", "p").join(found, ["h", "print"])
    span = F.struct((F.col("p") + F.col("lo")).alias("a"), (F.col("p") + F.col("hi")).alias("b"))
    hits = ws.write(hits.groupBy("k", "k2").agg(F.collect_set(span).alias("found")), f"{tag}-hits")
    ws.drop(f"{tag}-occurrences", f"{tag}-grouped", f"{tag}-found")
    return hits


def _word_codes(docs: DataFrame) -> DataFrame:
    """``docs`` with CODE bytes of its hash for each word of the text, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [(word_hashes(t) >> np.uint64(64 - 8 * CODE)).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["k", "k2", "bytes"])

    return docs.select("k", "k2", "bytes").mapInArrow(run, "k long, k2 long, bytes binary")


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed, kept) of each row: all bytes go that lie in a string of ``length`` bytes which also starts elsewhere.

    Elsewhere is any other place of the same or another row; rows that repeat are copies of each
    other. Strings are judged on the input, matches never cross rows. ``removed`` are the maximal
    removed runs, ``kept`` the other bytes, which need not be valid UTF-8. Null counts as empty;
    texts shorter than ``length`` stay whole, long ones are read whole; ids may be null or repeat;
    other columns are not read; an empty table gives an empty table.

    A passage of many short words may be shorter than ``length``. With ``words`` a column
    repeated_words counts the words that lie in a run of so many words which also starts
    elsewhere, found by the same construction over texts of CODE bytes a word; it removes nothing,
    and takes as long again.

    Equal runs are counted with map-side sums, so copies cost one row a task, and are then two
    equal strings of their group. All groups with more than one run are built column by column;
    groups above LARGE strings are built in parts, and what no part has twice is counted by window. The only large shuffles are passes of the texts. Rows
    are told apart by 128 bits of their id and text.
    """
    ws = Workspace(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "bytes")).withColumn("k2", F.xxhash64(F.lit("row"), "bytes", "doc_id"))
    hits = _repeats(ws, rows, length, "bytes")
    # strings of words begin at a word; two neighbours of a run agree in all their bytes with a chance of 1 in 2**32
    joined = rows.join(hits, ["k", "k2"], "left")
    if words is None:
        return _cut(joined.withColumn("repeated", F.lit(None))).drop("repeated_words").withColumnRenamed("doc_id", key)
    repeated = _repeats(ws, _word_codes(rows), words * CODE, "words", CODE).withColumnRenamed("found", "repeated")
    return _cut(joined.join(repeated, ["k", "k2"], "left")).withColumnRenamed("doc_id", key)
