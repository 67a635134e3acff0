"""Periodic runs of words, after Kolpakov and Kucherov.

The Lempel-Ziv factors of a text come from its suffix automaton: each is the longest piece that
also begins earlier. A run either meets a border of two factors or lies within one factor. Runs
at borders are found with Main's algorithm, by common extensions to both sides; as whatever
follows a run's first period is a copy from one period before, it is covered by the two factors
at a border, so the extensions are no longer than these. Runs within a factor are copies of runs
within its earlier occurrence. All three steps take time in proportion to the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdspark.llm.common import small_arrow_batches

#: Words are what stands between these.
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]


def lz_factors(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of its first occurrence) of each factor: the longest prefix of the rest that also begins earlier, or one new word.

    States 0..n of the automaton stand for the prefixes; the step from a prefix to the next one is
    not stored. ``ends`` is where the strings of a state end first.
    """
    n = len(words)
    size, ends = list(range(n + 1)), list(range(n + 1))
    link: list[int] = [-1] + [0] * n
    steps: list[dict[int, int] | None] = [None] * (n + 1)
    after = [*words, -1]
    for i in range(n):
        word, p = words[i], link[i]
        while p >= 0:
            known = steps[p]
            if p < n and after[p] == word:
                link[i + 1] = p + 1
                break
            if known is None:
                steps[p] = {word: i + 1}
            elif word in known:
                q = known[word]
                if size[p] + 1 == size[q]:
                    link[i + 1] = q
                    break
                clone = len(size)
                size.append(size[p] + 1)
                ends.append(ends[q])
                copy = dict(steps[q] or ())
                if q <= i:
                    copy[after[q]] = q + 1
                steps.append(copy)
                after.append(-1)
                link.append(link[q])
                link[q] = link[i + 1] = clone
                while p >= 0 and (known := steps[p]) is not None and known.get(word) == q:
                    known[word] = clone
                    p = link[p]
                break
            else:
                known[word] = i + 1
            p = link[p]
    factors = []
    start = 0
    while start < n:
        state, at = 0, start
        while at < n:
            word = words[at]
            step = state + 1 if after[state] == word else steps[state][word]
            if ends[step] > at:
                break
            state, at = step, at + 1
        length = max(1, at - start)
        factors.append((start, length, ends[state] - length if at > start else start))
        start += length
    return factors


def _prefixes(x: list[int]) -> list[int]:
    """For each place the length of what begins there and also begins the list."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    low = high = 0
    for i in range(1, n):
        k = z[i - low] if i < high else 0
        if k >= high - i:
            k = max(0, high - i)
            while i + k < n and x[k] == x[i + k]:
                k += 1
            low, high = i, i + k
        z[i] = k
    return z


def _at_border(words: list[int], border: int, left: int, right: int, longest: int, fits, found: dict[tuple[int, int], int]) -> None:
    """Runs of a period up to ``longest`` that meet the border and reach at most ``left`` and ``right`` words from it."""
    x, y = words[border - left : border], words[border : border + right]
    back = x[::-1]
    y_in_y, x_in_x = _prefixes(y), _prefixes(back)
    # what precedes the border and the place q words after it, and what follows the border and the place q words before it
    before = _prefixes([*back, -1, *y[::-1], *back])[left + 1 : left + 1 + right]
    beyond = _prefixes([*y, -1, *x, *y])[right + 1 : right + 1 + left]
    n = len(words)

    def add(start: int, stop: int, q: int) -> None:
        if fits(stop - start, q) and (not start or words[start - 1] != words[start - 1 + q]) and (stop == n or words[stop] != words[stop - q]):
            found[start, stop] = min(q, found.get((start, stop), q))

    for q in range(1, min(longest, right) + 1):  # at least a period after the border
        add(border - before[right - q], border + q + (y_in_y[q] if q < right else 0), q)
    for q in range(1, min(longest, left) + 1):  # at least a period before it
        add(border - q - (x_in_x[q] if q < left else 0), border + beyond[left - q], q)


def find_runs(words: list[int], min_length: int = 6, min_exponent: int = 4) -> list[Run]:
    """(start, length, period) of each run by start, then period: the stretches of smallest period q and at least max(min_length, min_exponent * q) words which no neighbour extends."""
    if min_exponent < 2:
        raise ValueError("a run has its period twice at least")
    n = len(words)
    least = max(min_length, min_exponent)
    if n < least:
        return []

    def fits(length: int, q: int) -> bool:
        return length >= min_length and length >= min_exponent * q

    factors = lz_factors(words)
    # what a run has beyond its first period lies in the two factors at a border
    rest = least - least // min_exponent
    found: dict[tuple[int, int], int] = {}
    before = 0
    for start, length, _ in [*factors, (n, 0, n)]:
        if before + length >= rest:
            longest = (before + length) // (min_exponent - 1)
            _at_border(words, start, min(start, before + longest), length, longest, fits, found)
        before = length
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (start, stop), q in found.items():
        by_start.setdefault(start, []).append((stop, q))
    if found:
        for start, length, source in factors:
            if length < least + 2 or source == start:
                continue
            # a copied run may be a source itself where the factor overlaps its earlier occurrence
            for s in range(source + 1, source + length - least):
                for stop, q in by_start.get(s, ()):
                    if stop < source + length:
                        by_start.setdefault(s + start - source, []).append((stop + start - source, q))
    return sorted((s, stop - s, q) for s, many in by_start.items() for stop, q in many)


def beyond_first_period(n: int, runs: list[Run]) -> list[bool]:
    """Whether a run contains each of ``n`` words after its first period."""
    gone, reach, k = [False] * n, 0, 0
    spans = sorted((s + q, s + length) for s, length, q in runs)
    for at in range(n if spans else 0):
        while k < len(spans) and spans[k][0] <= at:
            reach = max(reach, spans[k][1])
            k += 1
        gone[at] = at < reach
    return gone


def runs_of_text(text: str, min_length: int = 6, min_exponent: int = 4) -> tuple[list[Run], str]:
    """The runs of the text's words, and the words but for those that repeat a run's first period, joined by one space."""
    words = _WORDS.findall(text)
    numbers: dict[str, int] = {}
    runs = find_runs([numbers.setdefault(w, len(numbers)) for w in words], min_length, min_exponent)
    if not runs:
        return runs, " ".join(words)
    return runs, " ".join(w for w, g in zip(words, beyond_first_period(len(words), runs), strict=True) if not g)


def periodic_runs(docs: DataFrame, text: str | Column = "text", min_length: int = 6, min_exponent: int = 4, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the periodic runs of each text and the text without what repeats a run's first period.

    Column ``runs`` has array<struct<start, length, period>>, by start and then period, counted in
    words from 0; column ``collapsed`` has the words that stay, joined by one space. Columns so
    named are replaced, others stay. Null and empty texts have no runs and an empty rest. Whole
    texts are read, in time and memory that grow with their words. Rows are mapped one by one:
    no shuffle, rows that repeat repeat their result, an empty table gives an empty table.
    """
    small_arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (runs, collapsed)]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`") if isinstance(text, str) else text)
    run = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(runs, T.ArrayType(run)), T.StructField(collapsed, T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rest = zip(*(runs_of_text(t.as_py() or "", min_length, min_exponent) for t in batch.column(len(kept))), strict=True) if batch.num_rows else ((), ())
            found = [[{"start": s, "length": n, "period": q} for s, n, q in some] for some in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind), pa.array(rest, pa.string())], [*kept, runs, collapsed])

    return source.toDF(*map(str, range(len(kept) + 1))).mapInArrow(find, schema)
