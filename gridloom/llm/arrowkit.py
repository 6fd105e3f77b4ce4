"""Arrow batches as bytes, and word shingles as hashed numpy arrays, for the operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)
#: Entries of a task's memory of words; it starts anew when full.
MEMO_WORDS = 400_000


def binary_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of width words; of the whole sequence if it is shorter; none for no words."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    s = h[:n].copy()
    for j in range(1, width):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mixed(s ^ np.uint64(width))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 50_000) -> Iterable[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
