"""Byte-level BPE without a merge loop.

Candidates come from one pass of an Aho-Corasick automaton over the piece's bytes, written as
Latin-1 so that each byte is one character. The encoder takes the longest match at each place
and goes back to shorter ones while a token cannot stand next to its left neighbour; whether
two tokens can be neighbours depends on these two alone and is remembered. Every place is left
at most once for good, so the time is linear in the length of a piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdspark.llm.common import small_arrow_batches

#: The vocabulary is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces that a worker remembers in each of two generations, and pairs; when one is full, the elder goes.
CACHE_ENTRIES = 300_000
CACHED_PIECE_CHARS = 48
#: Text that one output batch stands for.
BATCH_CHARS = 1 << 20


class BytePairEncoder:
    def __init__(self, vocabulary: bytes, pattern: str):
        """``vocabulary``: lines of base64 token and rank, all 256 single bytes among them."""
        pairs = [line.split() for line in vocabulary.splitlines() if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        order = sorted(ranks, key=ranks.get)
        self.token_bytes = dict((ranks[t], t) for t in order)
        self.find = regex.compile(pattern).findall
        self.ranks = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.ranks.items():
            self.automaton.add_word(text, (len(text), rank))
        self.automaton.make_automaton()
        self.length = {r: len(t) for t, r in self.ranks.items()}
        #: the next shorter token that begins a token, or None
        self.shorter = {r: next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), None) for t, r in self.ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token in order:
            self._learn_halves(token.decode("latin-1"))
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.elder: dict[str, tuple[int, ...]] = {}

    def _learn_halves(self, text: str) -> None:
        """The last merge that makes this token; a token that no merge makes is whole."""
        rank = self.ranks[text]
        left = self.shorter[rank]
        while left is not None:
            right = self.ranks.get(text[self.length[left] :])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.halves[rank], self.joined[left, right] = (left, right), rank
                return
            left = self.shorter[left]
        self.halves[rank] = (rank, rank)

    def _compatible(self, left: int, right: int) -> bool:
        """Would merging leave a border here?

        Undoes the merges of both tokens, latest first, and looks whether at some time a merge
        across the border would have come first.
        """
        bound = None
        while True:
            across = self.joined.get((left, right))
            if across is not None and (bound is None or across < bound):
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (inner_left != left and left > right):
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ranks of one piece, given as Latin-1."""
        whole = self.ranks.get(text)
        if whole is not None:
            return (whole,)
        longest = [0] * len(text)
        for end, (size, rank) in self.automaton.iter(text):
            longest[end - size + 1] = rank  # matches come by their ends, so the longest is the last
        open_at = bytearray(b"\x01") * (len(text) + 1)
        length, shorter, neighbours = self.length, self.shorter, self.neighbours
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            fits = open_at[end]
            if fits and out:
                pair = (out[-1], token)
                fits = neighbours.get(pair)
                if fits is None:
                    if len(neighbours) >= CACHE_ENTRIES:
                        neighbours.clear()
                    fits = neighbours[pair] = self._compatible(*pair)
            if fits:
                out.append(token)
                if end == len(text):
                    return tuple(out)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token is None:  # nothing fits here: this place is closed, the last token gives way
                open_at[at] = 0
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in self.find(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.elder.get(piece)
                if ids is None:
                    ids = self._piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= CACHED_PIECE_CHARS:
                    if len(pieces) >= CACHE_ENTRIES:
                        self.elder = pieces
                        pieces = self.pieces = {}
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_encoders: dict[tuple[int, str], BytePairEncoder] = {}


def encode_decode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns, if not given) with ids array<int> and decoded binary.

    Whole texts are encoded; null counts as empty and gives no ids. Columns named ids or decoded
    are replaced, others of any name stay. Rows that repeat repeat their result; an empty table
    gives an empty table. The vocabulary file is read on the driver and broadcast, its size is checked.
    Each partition is mapped by itself: no shuffle, and a lost executor repeats its own tasks.
    """
    with open(vocabulary_path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(raw)
    small_arrow_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in ("ids", "decoded")]
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`"))
    schema = T.StructType(source.schema.fields[:-1]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())
    key = (hash(raw), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders[key] = BytePairEncoder(shared.value, pattern)
        encoder = _encoders[key]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start = 0
            while start < len(texts):
                ids, decoded, chars, stop = [], [], 0, start
                while stop < len(texts) and chars < BATCH_CHARS:
                    one = texts[stop].as_py() or ""
                    ids.append(encoder.encode(one))
                    decoded.append(encoder.decode(ids[-1]))
                    chars += len(one)
                    stop += 1
                columns = [batch.column(k).slice(start, stop - start) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], [*keep, "ids", "decoded"]
                )
                start = stop

    return source.toDF(*map(str, range(len(keep) + 1))).mapInArrow(run, schema)
