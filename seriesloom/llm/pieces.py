"""Ids of text pieces met before in this task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from seriesloom.llm.arrays import expand, mix

# spans up to this many bytes are read eight bytes at a time, longer ones one by one
SHORT = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each span's content, and for each number the first span and a hash. Equal numbers mean equal bytes."""
    n, length = len(start), end - start
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    keys, parts = mix(length.astype(np.uint64)), []
    live = np.flatnonzero(length <= SHORT)
    for at in range(0, SHORT, 8):
        live = live[np.flatnonzero(length[live] > at)]
        if not len(live):
            break
        part = np.zeros(n, np.uint64)
        part[live] = eight[start[live] + at] & _FIRST[np.minimum(length[live] - at, 8)]
        keys[live] = mix(keys[live] ^ part[live])
        parts.append((live, part))
    body = data.tobytes()
    large = {i: body[start[i] : end[i]] for i in np.flatnonzero(length > SHORT).tolist()}
    keys[list(large)] = np.array([hash(x) for x in large.values()], np.int64).view(np.uint64)
    codes, _ = pd.factorize(keys, size_hint=n // 2)
    first = _first(codes)
    of = first[codes]
    if (length != length[of]).any() or any((part[live] != part[of[live]]).any() for live, part in parts) or any(x != large.get(int(of[i])) for i, x in large.items()):
        codes, _ = pd.factorize(np.array([body[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] + [None], object)[:-1])
        first = _first(codes)
    return codes, first, keys[first]


def _first(codes: np.ndarray) -> np.ndarray:
    first = np.zeros(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


class PieceStore:
    """Bounded cache of encoded pieces. ``encode`` takes new pieces and gives all their ids and the count of each.

    Pieces are found by their hash and compared byte by byte with the kept one;
    arrays hold them, so a worker needs a few bytes a piece.
    """

    LIMIT = 300_000
    BODY_BYTES = 32 << 20

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        # ascending hashes, and the number of the piece each stands for
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.body, self.begin = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _known(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which spans are, byte by byte, the kept pieces of these numbers."""
        same = self.begin[number + 1] - self.begin[number] == length
        some = np.flatnonzero(same & (length > 0))
        other = data[expand(start[some], length[some])] != self.body[expand(self.begin[number[some]], length[some])]
        if other.any():
            same[np.repeat(some, length[some])[other]] = False
        return same

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans in order, and the number of ids of each span."""
        codes, first, keys = distinct(data, start, end)
        if not len(keys):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first, length = keys[order], start[first[order]], (end - start)[first[order]]
        if len(self.keys) > self.LIMIT or len(self.body) > self.BODY_BYTES:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = np.flatnonzero(place < len(self.keys))
        there[inside] = self.keys[place[inside]] == keys[inside]
        number, met = np.zeros(len(keys), np.int64), np.flatnonzero(there)
        number[met] = self.number[place[met]]
        fresh = ~there
        fresh[met] = ~self._known(data, first[met], length[met], number[met])
        new = np.flatnonzero(fresh)
        if len(new):
            body = data.tobytes()
            ids, counts = self.encode([body[a:b] for a, b in zip(first[new].tolist(), (first[new] + length[new]).tolist(), strict=True)])
            number[new] = len(self.at) - 1 + np.arange(len(new))
            # a kept piece of the same hash and other bytes makes room
            again, added = new[there[new]], new[~there[new]]
            self.number[place[again]] = number[again]
            self.keys, self.number = np.insert(self.keys, place[added], keys[added]), np.insert(self.number, place[added], number[added])
            self.body = np.concatenate([self.body, data[expand(first[new], length[new])]])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(length[new])])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        by_code = np.empty(len(keys), np.int64)
        by_code[order] = number
        number = by_code[codes]
        counts = self.at[number + 1] - self.at[number]
        return self.flat[expand(self.at[number], counts)], counts
