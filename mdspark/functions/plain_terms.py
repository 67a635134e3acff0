"""Terms of texts of common characters, found for many texts at once; they are those of ``index_terms``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mdspark.functions.text import _folded

#: Fixed value: Latin, Cyrillic and punctuation, without marks of their own and letters whose lower case is not one letter.
PLAIN = ((0x00, 0x12F), (0x131, 0x24F), (0x400, 0x482), (0x48A, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x2500, 0x27BF))
#: Characters of texts that are parted at once; the mark of one that is not plain.
CHARS, ODD = 1 << 20, 0xFFFF

def _letters() -> np.ndarray:
    """What each character is in a term, 0 if it is in none, ODD if it is not plain; the last one stands for all beyond."""
    one, other = _folded()
    bare = dict(zip(one, other, strict=False))
    table = np.full(PLAIN[-1][1] + 2, ODD, np.uint16)
    for a, b in PLAIN:
        for code in range(a, b + 1):
            low = chr(code).lower()
            table[code] = ord(bare.get(low, low)) if low.isalnum() else 0
    return table


_LETTERS = _letters()


def count_plain_terms(text: Column) -> Column:
    """How many terms a text has; -1 if it is not plain, or not UTF-8."""

    @F.arrow_udf("int")
    def counts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            known = part.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(len(part), -1, np.int32)
            out[known] = [n for texts in _groups(part.drop_null().to_pylist()) for n in _read(texts)[3].tolist()]
            yield pa.array(out)

    return counts(F.when(F.is_valid_utf8(text), text))


def plain_terms(texts: list[str]) -> Iterator[pa.StringArray]:
    """The terms of each of some plain texts."""
    for some in _groups(texts):
        letters, inside, first, counts = _read(some)
        starts, letters = np.flatnonzero(first[inside]), letters[inside]
        if len(letters) and letters.max() > 0x7F:
            data = letters.astype("<u4").tobytes().decode("utf-32-le").encode()
            at = np.concatenate(([0], np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF))))
        else:
            data, at = letters.astype(np.uint8).tobytes(), np.arange(len(letters) + 1)
        offsets = at[np.concatenate((starts, [len(letters)]))].astype(np.int32)
        words, k = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), 0
        for n in counts.tolist():
            yield words.slice(k, n)
            k += n


def _groups(texts: list[str]) -> Iterator[list[str]]:
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHARS):
            size += len(texts[b])
            b += 1
        yield texts[a:b]
        a = b


def _read(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the texts, with a line end after each: what each character is in a term, whether it is in one, or begins one; and the number of each text's terms, or -1."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    letters = _LETTERS[np.minimum(codes, len(_LETTERS) - 1)]
    inside = letters != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    counts[np.searchsorted(ends, np.flatnonzero(letters == ODD), side="right")] = -1
    return letters, inside, first, counts
