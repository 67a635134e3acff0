"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap of question and answer.

Each overlapping passage of every document is a query against the index of test items. Impacts
are BM25 weights over an item's score for its own text, so a score is the share of the item that
the passage matches and one threshold fits items of any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import Workspace, small_arrow_batches

#: BM25 constants; the least score; the least share of n-grams of the question and of the answer; words of an n-gram.
K1, B, THRESHOLD, OVERLAP, GRAM = 1.2, 0.75, 0.6, 0.6, 3
#: Words between passage starts; a passage has twice as many. Longer items are looked for in parts of PART words.
STRIDE, PART = 128, 128
#: Items shorter than this have too few n-grams for a share: all their words must be there in a row.
SHORT = 5
#: Postings in a block; bytes of items in one index, which is broadcast. More items are searched in several passes.
BLOCK, MAX_INDEX_BYTES = 16, 16 << 20
#: Terms whose postings a task keeps as lists, for the search.
ROWS = 1 << 14
#: Scripts without spaces between words: Han, kana, Thai, Lao, Myanmar, Khmer. Each character is a word.
UNSEGMENTED = (
    "\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3041-\u3096\u3099\u309a\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ebd\u0ec0-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3"
)
_WORD = re.compile(rf"[{UNSEGMENTED}]|[^\W_{UNSEGMENTED}]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer follows the last question mark; without one, all is question.

    Also if one of the two is so short that a changed word in it, which is in GRAM n-grams, takes
    its share below OVERLAP: then they are judged together.
    """
    cut = text.rfind("?") + 1
    parts = words(text[:cut]), words(text[cut:])
    if any((1 - OVERLAP) * (len(w) - GRAM + 1) < GRAM for w in parts):
        return parts[0] + parts[1], []
    return parts


def _grams(w: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def parts_of(text: str) -> list[list[str]]:
    """The parts of PART words or fewer in which an item is looked for; none of an item that is short."""
    w = words(text)
    n = math.ceil(len(w) / PART) if len(w) >= SHORT else 0
    return [w[k * len(w) // n : (k + 1) * len(w) // n] for k in range(n)]


class ItemIndex:
    """Postings by term, in blocks of BLOCK parts with the largest impact of each block; short items by their first word.

    ``statistics`` has the number of parts, their mean length and the number of parts of each term
    over all items, also those of other indexes, so that a score is the same in all of them.
    Postings are flat arrays: a term's part of them begins at ``starts`` of its number.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: tuple[int, float, dict[str, int]] | None = None):
        self.parts: list[int] = []
        self.items: list[tuple[int, list[str], list[str]]] = []
        self.short: dict[str, list[tuple[int, list[str]]]] = {}
        texts: list[list[str]] = []
        for item, text in items:
            w = words(text)
            if len(w) < SHORT:
                if w:
                    self.short.setdefault(w[0], []).append((item, w))
                continue
            self.items.append((item, *question_and_answer(text)))
            for part in parts_of(text):
                self.parts.append(len(self.items) - 1)
                texts.append(part)
        own = Counter(t for w in texts for t in set(w))
        self.terms = {t: k for k, t in enumerate(sorted(own))}
        n, mean, df = statistics or (len(texts), sum(map(len, texts)) / max(1, len(texts)), own)
        idf = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in self.terms])
        rows = []
        for part, w in enumerate(texts):
            counts = Counter(w)
            terms = np.array([self.terms[t] for t in counts], np.int64)
            f = np.array(list(counts.values()), float)
            weights = idf[terms] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean))
            rows.append((terms, np.full(len(terms), part, np.int64), weights / weights.sum()))
        terms, docs, impacts = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((docs, terms))
        self.flat_docs, self.flat_impacts = docs[order].astype(np.int32), impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(self.terms) + 1))
        self.tops = np.maximum.reduceat(self.flat_impacts, self.starts[:-1]) if len(self.terms) else np.empty(0)
        # Rare terms first: what the other terms can add to a part is less than half the threshold,
        # so a part over the threshold has at least the rest of it from rare terms.
        sizes = np.diff(self.starts)
        self.common = np.zeros(len(self.terms), bool)
        slack = np.full(len(texts), THRESHOLD / 2)
        for t in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
            at = slice(self.starts[t], self.starts[t + 1])
            if sizes[t] > 1 and (slack[self.flat_docs[at]] > self.flat_impacts[at]).all():
                self.common[t] = True
                slack[self.flat_docs[at]] -= self.flat_impacts[at]
        self.need = THRESHOLD / 2 + slack - 1e-9
        rare = np.repeat(~self.common, sizes)
        self.rare_at = np.concatenate(([0], np.cumsum(np.where(self.common, 0, sizes))))
        self.rare_parts, self.rare_impacts = self.flat_docs[rare].astype(np.int64), self.flat_impacts[rare]
        self._rows: dict[int, tuple] = {}

    def row(self, t: int) -> tuple[list[int], list[float], list[float], list[int]]:
        """Parts and impacts of a term, and the largest impact and the last part of each block; kept for the terms that searches have met."""
        if t not in self._rows:
            docs, impacts = (x[self.starts[t] : self.starts[t + 1]] for x in (self.flat_docs, self.flat_impacts))
            begins = np.arange(0, len(docs), BLOCK)
            if len(self._rows) >= ROWS:
                self._rows.clear()
            self._rows[t] = docs.tolist(), impacts.tolist(), np.maximum.reduceat(impacts, begins).tolist(), docs[np.minimum(begins + BLOCK, len(docs)) - 1].tolist()
        return self._rows[t]

    def promising(self, terms: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """Passages in which the rare terms alone give some part what it needs from them.

        ``terms`` and ``passages``: distinct pairs of a term and a passage it is in.
        """
        counts = self.rare_at[terms + 1] - self.rare_at[terms]
        some = counts > 0
        terms, passages, counts = terms[some], passages[some], counts[some]
        if not len(terms):
            return np.empty(0, np.int64)
        first = np.repeat(self.rare_at[terms] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        at = first + np.arange(int(counts.sum()))
        parts = self.rare_parts[at]
        pairs, place = np.unique(np.repeat(passages, counts) * len(self.parts) + parts, return_inverse=True)
        total = np.bincount(place, self.rare_impacts[at])
        return np.unique(pairs[total >= self.need[pairs % len(self.parts)]] // len(self.parts))

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every (part, score) with at least ``threshold`` for distinct terms, by block-max WAND."""
        rows = {t: self.row(t) for t in terms}
        cursors = sorted((rows[t][0][0], t, 0) for t in terms)
        out = []
        while cursors:
            bound, pivot = 0.0, None
            for k, (_, t, _) in enumerate(cursors):
                bound += self.tops[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return out
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            blocks, bound, next_start = [], 0.0, None
            for _, t, at in cursors[: pivot + 1]:
                block = at // BLOCK
                ends = rows[t][3]
                while block < len(ends) and ends[block] < part:
                    block += 1
                if block < len(ends):
                    bound += rows[t][2][block]
                    next_start = min(next_start, ends[block] + 1) if next_start is not None else ends[block] + 1
                blocks.append(block)
            if bound >= threshold - 1e-9:
                score, target = 0.0, part + 1
                for _, t, at in cursors[: pivot + 1]:
                    row = rows[t][0]
                    while at < len(row) and row[at] < part:
                        at += 1
                    if at < len(row) and row[at] == part:
                        score += rows[t][1][at]
                if score >= threshold - 1e-9:
                    out.append((part, score))
            else:
                target = max(part + 1, next_start if next_start is not None else part + 1)
                if pivot + 1 < len(cursors):
                    target = min(target, max(cursors[pivot + 1][0], part + 1))
            moved = []
            for k, (_, t, at) in enumerate(cursors[: pivot + 1]):
                row, ends = rows[t][0], rows[t][3]
                block = blocks[k]
                while block < len(ends) and ends[block] < target:
                    block += 1
                at = max(at, block * BLOCK)
                while at < len(row) and row[at] < target:
                    at += 1
                if at < len(row):
                    moved.append((row[at], t, at))
            cursors = sorted(moved + cursors[pivot + 1 :])
        return out


def _leaks(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
    """(number of the text, item, score, overlap of the question, overlap of the answer) of each confirmed item."""
    get = index.terms.get
    all_words, ids, window = [], [], []
    first = 0
    firsts = []
    for text in texts:
        w = words(text)
        all_words.append(w)
        firsts.append(first)
        known = np.array([get(x, -1) for x in w], np.int64)
        at = np.flatnonzero(known >= 0)
        ids.append(known[at])
        window.append(at // STRIDE + 1 + first)
        first += len(w) // STRIDE + 2
    if index.short:
        for k, w in enumerate(all_words):
            for item in _short_items(index, w):
                yield k, item, 1.0, 1.0, 1.0
    if not index.parts:
        return
    terms, spot = np.concatenate(ids), np.concatenate(window)
    # a passage begins at each stride and has two; number n has the strides n and n + 1
    pairs = np.unique(np.concatenate((spot * len(index.terms) + terms, (spot - 1) * len(index.terms) + terms)))
    terms, passages = pairs % len(index.terms), pairs // len(index.terms)
    for passage in index.promising(terms, passages).tolist():
        lo, hi = np.searchsorted(passages, [passage, passage + 1])
        hits = index.search(terms[lo:hi].tolist())
        if not hits:
            continue
        k = int(np.searchsorted(firsts, passage, side="right")) - 1
        begin = max(0, (passage - firsts[k] - 1) * STRIDE)
        for entry, score in {(index.parts[p], s) for p, s in hits}:
            item, question, answer = index.items[entry]
            reach = max(0, len(question) + len(answer) - STRIDE)
            there = _grams_of_text(all_words[k][max(0, begin - reach) : begin + 2 * STRIDE + reach], {len(g) for part in (question, answer) for g in list(_grams(part))[:1]})
            shares = [len(g & there) / len(g) if (g := _grams(part)) else 1.0 for part in (question, answer)]
            if min(shares) >= OVERLAP:
                yield k, item, score, shares[0], shares[1]


def _short_items(index: ItemIndex, w: list[str]) -> set[int]:
    return {item for at, first in enumerate(w) if first in index.short for item, whole in index.short[first] if w[at : at + len(whole)] == whole}


def _grams_of_text(w: list[str], sizes: set[int]) -> set[tuple[str, ...]]:
    return {tuple(w[k : k + n]) for n in sizes for k in range(len(w) - n + 1)}


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each test item that a document holds, at its best passage.

    A passage is found if its BM25 score is at least THRESHOLD of the item's own, and confirmed
    if it has at least OVERLAP of the word trigrams of the item's question and of its answer, or
    of all its text if it has no question mark or one of them is short (answer_overlap is 1 then).
    Items shorter than SHORT words are found where all their words follow each other (all figures
    are 1 then). Words are runs of letters and digits, lower-cased, and single characters in
    scripts without spaces. Null and empty texts hold nothing; items that are null or without a
    word are not looked for; each text of an item_id is; rows that repeat an item or an id count
    once; an empty table on either side gives an empty table.

    The index is broadcast; its size is checked, and more items are searched in passes over the
    documents, with the statistics of all items in each, so that no score depends on the number of
    passes. Texts of any length are searched whole. Documents are mapped where they are read; only confirmed pairs are shuffled.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    small_arrow_batches(spark)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // MAX_INDEX_BYTES)
    out = spark.createDataFrame([], schema)
    known = _statistics(items) if passes > 1 else None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        index = ItemIndex(sorted((r.item_id, r.text) for r in part), known and _of_terms(known, [r.text for r in part]))
        if not index.parts and not index.short:
            continue
        out = out.unionByName(_map_leaks(docs.select(F.col(key).cast("long").alias("doc_id"), text), spark.sparkContext.broadcast(index), schema))
    best = out.groupBy("doc_id", "item_id")
    return best.agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def _statistics(items: DataFrame) -> DataFrame:
    """(term, parts, words): how many parts of items have a term; for the term '' the number of all parts, and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df: Counter = Counter()
            length = 0
            for text in batch.column(0).to_pylist():
                for part in parts_of(text):
                    df.update({"", *part})
                    length += len(part)
            sizes = [length if t == "" else 0 for t in df]
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array(sizes, pa.int64())], ["term", "parts", "words"])

    counted = items.select("text").mapInArrow(run, "term string, parts long, words long")
    return Workspace(items.sparkSession, "decontamination").write(counted.groupBy("term").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words")), "statistics")


def _of_terms(known: DataFrame, texts: list[str]) -> tuple[int, float, dict[str, int]]:
    """The statistics of the terms of one index, whose size is bounded."""
    terms = {t for text in texts for t in words(text)} | {""}
    wanted = known.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string")
    found = {r.term: r for r in known.join(F.broadcast(wanted), "term").collect()}
    if "" not in found:
        return 0, 1.0, {}
    return found[""].parts, found[""].words / found[""].parts, {t: r.parts for t, r in found.items()}


def _map_leaks(docs: DataFrame, shared, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            found = [(ids[k], *rest) for k, *rest in _leaks(shared.value, [t or "" for t in batch.column(1).to_pylist()])]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, schema)
