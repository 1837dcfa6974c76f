"""Word shingles of text slices as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from seriesloom.llm.arrays import LOWER, SPACE, Powers, SpanHash, Texts, mix, runs, seeded

SIZE = 5
_BYTES = seeded(256, 11)
_PLACE = seeded(64, 12) | np.uint64(1)


def shingle_hashes(texts: Texts, powers: Powers, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every row (repeats kept) and the row of each.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A row with fewer than
    ``size`` words has its whole word sequence as one shingle, a row without words none.
    """
    data = LOWER[texts.data]
    start, end, row = runs(~SPACE[data], texts.offsets)
    word = SpanHash(_BYTES, powers, data)(start, end)
    count = np.bincount(row, minlength=len(texts))
    full = np.flatnonzero(row[: max(len(row) - size + 1, 0)] == row[size - 1 :]) if len(row) >= size else np.empty(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for j in range(size):
        value += word[full + j] * _PLACE[j]
    short = np.flatnonzero((count > 0) & (count < size))
    first = (np.cumsum(count) - count)[short]
    few = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = count[short] > j
        few[has] += word[first[has] + j] * _PLACE[j]
    few += count[short].astype(np.uint64) * _PLACE[63]
    hashes, rows = np.concatenate([mix(value), mix(few)]), np.concatenate([row[full], short])
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def shingle_sets(texts: Texts, powers: Powers, size: int = SIZE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every row."""
    hashes, rows = shingle_hashes(texts, powers, size)
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def digest(values: np.ndarray) -> bytes:
    """128-bit digest of a sorted set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
