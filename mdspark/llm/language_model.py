"""Stupid-backoff scores from n-gram count tables, computed relationally.

The count table is partitioned by hash of the n-gram. Texts are packed into blocks of bounded
size, so a block's exploded n-grams come to the count table once each, not once a document: a
row of the exploded table holds all n-grams of one block in one partition of the count table,
sorted, with their counts in the block. The table sums them and is joined back to the blocks it
got them from; as a block knows its sorted n-grams, only the sums travel back. Each block then
has all counts of its n-grams, and adds up the scores of its documents.

A frequent n-gram is thus one entry a block, whatever the number of documents that have it, and
the partitions of the count table are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdspark.llm.common import Workspace, shuffle_partitions
from mdspark.llm.near_dedup import _MULTIPLIERS, _SPACE, mix

ALPHA, ORDER = 0.4, 3
#: Bytes of text in a block, and for each partition of the count table. They bound memory only, at some 20 bytes for one.
BLOCK_BYTES = 10 << 20
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z lower-cased, in order, and the number of the text it is in."""
    whole = b"\n".join(texts).lower() + bytes(8)
    space = _SPACE[np.frombuffer(whole, np.uint8)]
    space[-8:] = True
    edges = np.flatnonzero(np.diff(space, prepend=True))
    start, left = edges[::2], edges[1::2] - edges[::2]
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.searchsorted(first, start, side="right") - 1
    # eight bytes at a time, of all words that still have some
    lanes = np.ndarray(len(whole) - 7, "<u8", whole, strides=1)
    out = left.astype(np.uint64) * _MULTIPLIERS[1]
    todo, spot = np.arange(len(start)), start
    while len(todo):
        out[todo] = mix((out[todo] ^ (lanes[spot] & _LOW_BYTES[np.minimum(left, 8)])) * _MULTIPLIERS[0])
        more = left > 8
        todo, spot, left = todo[more], spot[more] + 8, left[more] - 8
    return out, owner


def _ngrams(words: np.ndarray, owner: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside a text, and where they begin. Each n has its own part of the range, in order."""
    at = np.flatnonzero(owner[: max(0, len(words) - n + 1)] == owner[n - 1 :])
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total += words[at + k] * _MULTIPLIERS[k + 2]
    return mix(total) // np.uint64(order) + np.uint64(((n - 1) << 64) // order), at


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, the highest last; ascending ones as their differences."""
    planes = numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def _bounds(ngrams: np.ndarray, parts: int) -> list[int]:
    """Where each partition of the count table begins among sorted hashes."""
    limits = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
    return [*np.searchsorted(ngrams, limits).tolist(), len(ngrams)]


_BLOCK = "block long, ids array<long>, sizes array<int>, packed binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Texts packed into blocks; a text is in one block, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            joined = b"".join(texts)
            columns = [
                pa.array([number]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                pa.array([pa.compress(joined, codec="zstd", asbytes=True) if joined else b""], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "packed"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(key)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= size:
                    yield packed()
                    number, held = number + 1, 0
                    ids.clear()
                    texts.clear()
        if ids:
            yield packed()

    return rows.mapInArrow(run, _BLOCK)


def _texts(sizes: list[int], packed: bytes) -> list[bytes]:
    total = sum(sizes)
    joined = pa.decompress(packed, total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum(sizes).tolist()
    return [joined[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def _exploded(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, block, n, ngrams, counts): the n different n-grams of a block in a partition of the count table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, sizes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, owner = _words(_texts(sizes, packed))
                each = []
                for n in range(1, order + 1):
                    hashes = np.sort(_ngrams(words, owner, n, order)[0])
                    begins = _begins(hashes)
                    each.append((hashes[begins], np.diff(begins, append=len(hashes)).astype(np.int32)))
                ngrams, counts = (np.concatenate(c) for c in zip(*each, strict=True))
                each.clear()
                edges = _bounds(ngrams, parts)
                found = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in found], pa.int64()),
                        pa.array([block] * len(found), pa.int64()),
                        pa.array([b - a for _, a, b in found], pa.int32()),
                        pa.array([_pack(np.diff(ngrams[a:b], prepend=np.uint64(0))) for _, a, b in found], pa.binary()),
                        pa.array([_pack(counts[a:b]) for _, a, b in found], pa.binary()),
                    ],
                    ["part", "block", "n", "ngrams", "counts"],
                )

    # all columns are read, so that both uses of the blocks share one exchange
    return blocks.mapInArrow(run, "part long, block long, n int, ngrams binary, counts binary")


def _count(part: pa.Table) -> pa.Table:
    """One partition of the count table: the sums of its n-grams, for each block in the order of the block's n-grams."""
    sizes = part.column("n").to_pylist()
    ngrams = np.concatenate([np.cumsum(_unpack(x, n), dtype=np.uint64) for x, n in zip(part.column("ngrams").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([_unpack(x, n) for x, n in zip(part.column("counts").to_pylist(), sizes, strict=True)])
    order = np.argsort(ngrams, kind="stable")
    ngrams = ngrams[order]
    begins = _begins(ngrams)
    sums = np.empty(len(order), np.uint64)
    sums[order] = np.repeat(np.add.reduceat(counts[order], begins), np.diff(begins, append=len(order)))
    ends = np.cumsum(sizes).tolist()
    packed = [_pack(sums[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    return pa.table({"block": part.column("block"), "part": part.column("part"), "n": part.column("n"), "sums": pa.array(packed, pa.binary())})


_SCORED = "id long, n_tokens long, n_shared long, n_single long, log double"


def _score_block(ids: list, texts: list[bytes], sums: np.ndarray, order: int) -> pa.Table:
    """Scores of a block's texts, the size of the corpus left out: n_single tokens still lack the division by it."""
    words, owner = _words(texts)
    n = len(words)
    spot = np.arange(n) - np.searchsorted(owner, owner)
    log, single, longest = np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
    used, context = 0, np.empty(0)
    # tokens by themselves, then by ever longer contexts where those are found
    for k in range(order):
        hashes, at = _ngrams(words, owner, k + 1, order)
        place = np.argsort(hashes, kind="stable")
        hashes = hashes[place]
        begins = _begins(hashes)
        every = np.repeat(sums[used : used + len(begins)].astype(np.float64), np.diff(begins, append=len(hashes))[: max(0, len(sums) - used)])
        used += len(begins)
        if len(every) != len(hashes):
            break
        # equal n-grams of a text stand together, as the order is stable
        runs = _begins(hashes, owner[at][place])
        own = np.diff(runs, append=len(hashes))
        rest = np.empty(len(hashes))
        rest[place] = every - np.repeat(own, own)
        if not k:
            log[place] = np.log10(every)
            log += np.minimum(spot, order - 1) * np.log10(ALPHA)
        else:
            seen = rest > 0
            last = at[seen] + k
            log[last] = np.log10(rest[seen] / context[at[seen]]) + (np.minimum(spot[last], order - 1) - k) * np.log10(ALPHA)
            single[last] = False
            longest[:] = False
            longest[last] = True
        context = np.zeros(n)
        context[at] = rest
    if used != len(sums):
        raise RuntimeError("a block of texts changed between two reads of the input")
    add = lambda x: np.bincount(owner, x, len(texts))
    columns = [pa.array(ids, pa.int64()), *(pa.array(add(x).astype(np.int64)) for x in (np.ones(n), longest, single)), pa.array(add(log).astype(float))]
    return pa.Table.from_arrays(columns, ["id", "n_tokens", "n_shared", "n_single", "log"])


def backoff_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_tokens, n_shared, score) of each row: its tokens, those whose n-gram of the full order is also elsewhere, and the mean log10 score of a token.

    Words are runs without ASCII white space, A-Z lower-cased. A token after its context scores
    f(context token) / f(context) for the longest context, of at most order - 1 words of its
    text, with which it is found in another row; each word that the context lacks costs a factor
    ALPHA. These counts are those of all other rows. A token found with no context scores its
    share of all tokens.

    Each row is a document of its own, so rows that repeat an id, null too, each have a result
    and count for one another. Without tokens, as with a null or empty text, the score is null.
    Texts of any length are scored whole; a block holds whole texts, so the longest one bounds
    what a task holds at least. An empty table gives an empty table. Other columns are not read.
    N-grams are told apart by 64 bits.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "language-model")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    held = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-held // block_bytes))
    blocks = _blocks(rows, block_bytes).repartition(parts, "block")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        found = sorted(right.select(["part", "n", "sums"]).to_pylist(), key=lambda r: r["part"])
        sums = np.concatenate([np.empty(0, np.uint64), *(_unpack(r["sums"], r["n"]) for r in found)])
        return _score_block(row["ids"], _texts(row["sizes"], row["packed"]), sums, order)

    table = _exploded(blocks, order, parts).repartition(parts, "part").groupBy("part").applyInArrow(_count, "block long, part long, n int, sums binary")
    scored = blocks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(score, _SCORED)
    scored = ws.write(scored, "scores")
    total = scored.agg(F.sum("n_tokens")).first()[0] or 1
    mean = (F.col("log") - F.col("n_single") * F.log10(F.lit(float(total)))) / F.col("n_tokens")
    return scored.select(F.col("id").alias(key), "n_tokens", "n_shared", F.when(F.col("n_tokens") > 0, mean).alias("score"))
