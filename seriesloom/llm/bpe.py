"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

The split pattern is a small automaton over code point classes. Each code point
is a transition function on eight states; functions compose associatively, so
blocks of text are scanned side by side: first the function of every block,
then a scan over blocks for the state each one starts in, then all blocks again
from their state, which yields the match starts. No regular expression runs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.arrays import codepoints, expand, released, slices
from seriesloom.llm.pieces import PieceStore
from seriesloom.llm.tables import bounded_batches

# classes of code points
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# symbols of the automaton
_L, _N, _O, _LAST_BLANK, _LAST_SPACE, _SPACE, _SHORT, _LONG = range(8)
# states: nothing open, in letters, in numbers, in others, after a blank that the next match takes, in white space,
# one or two letters of a contraction to come
_FREE, _IN_L, _IN_N, _IN_O, _BLANK, _IN_S, _ONE, _TWO = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a match starts here", by symbol (plus 8 for the first of a text) and state."""
    to, starts = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for s in range(8):
        for x, inside in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O)):
            to[x, s], starts[x, s] = inside, s not in (inside, _BLANK)
        for x, state in ((_SHORT, _ONE), (_LONG, _TWO)):
            joined = s in (_IN_O, _BLANK)
            to[x, s], starts[x, s] = _IN_O if joined else state, not joined
        to[_LAST_BLANK, s], starts[_LAST_BLANK, s] = _BLANK, True
        to[_LAST_SPACE, s], starts[_LAST_SPACE, s] = _FREE, True
        to[_SPACE, s], starts[_SPACE, s] = _IN_S, s != _IN_S
    to[_L, _TWO], to[_L, _ONE], starts[_L, _TWO], starts[_L, _ONE] = _ONE, _FREE, False, False
    to[8:], starts[8:] = to[:8, :1], starts[:8, :1]
    return to, starts


def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    # fixed values: code points with the White_Space property
    for low, high in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[low : high + 1] = SPACE
    return table


def match_starts(points: np.ndarray, first: np.ndarray, table: np.ndarray, block: int = 256) -> np.ndarray:
    """Flags of the code points that start a match; ``first`` flags the first code point of each text."""
    n = len(points)
    if not n:
        return np.empty(0, bool)
    kind = table[points]
    ends = np.append(first[1:], True)
    symbol = np.array([_L, _N, _SPACE, _O], np.uint8)[kind]
    space = kind == SPACE
    last = space & ~ends & ~np.append(space[1:], False)
    symbol[last] = np.where(points[last] == 0x20, _LAST_BLANK, _LAST_SPACE)
    quote = np.flatnonzero((points == 0x27) & ~ends)
    if len(quote):
        one = points[quote + 1]
        two = np.where(ends[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quote[short]] = _SHORT
        symbol[quote[long]] = _LONG
    symbol[first] += 8
    to, starts = _automaton()
    width = -(-n // block)
    # a column per block; padding repeats a symbol and is cut off below
    grid = np.full(width * block, _O, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(width, block).T)
    flat = to.ravel()
    function = np.tile(np.arange(8, dtype=np.uint8), (width, 1))
    for row in grid:
        function = flat[row[:, None] * np.uint8(8) + function]
    # exclusive scan by doubling: composed[i] is the function of blocks up to i
    step = 1
    while step < width:
        function[step:] = np.take_along_axis(function[step:], function[:-step], 1)
        step *= 2
    state = np.append(np.uint8(_FREE), function[:-1, _FREE])
    out = np.empty((block, width), bool)
    begin = starts.ravel()
    for i, row in enumerate(grid):
        at = row * np.uint8(8) + state
        out[i] = begin[at]
        state = flat[at]
    return out.T.ravel()[:n]


class Merger:
    """Merges byte sequences by the ranks of a vocabulary file."""

    LONG = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.merged = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.offsets = np.append(0, np.cumsum(lengths))
        self.body = np.zeros(self.offsets[-1], np.uint8)
        for token, rank in ranks.items():
            self.body[self.offsets[rank] : self.offsets[rank + 1]] = np.frombuffer(token, np.uint8)

    @classmethod
    def from_file(cls, path: str) -> Merger:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], np.iinfo(np.int64).max)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each piece.

        Short pieces advance together: in each round every piece merges its lowest pair.
        """
        out: list[np.ndarray | None] = [None] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole])
            elif len(piece) > self.LONG:
                out[i] = self.merge_long(piece)
            else:
                short.append(i)
        if short:
            lengths = np.array([len(pieces[i]) for i in short], np.int64)
            ids = self.single[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
            owner = np.repeat(np.arange(len(short)), lengths)
            kept_ids, kept_owner = [], []
            none = np.iinfo(np.int64).max
            while len(ids):
                rank = np.full(len(ids), none)
                rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank(ids[:-1], ids[1:]), none)
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                low = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
                done = low == none
                kept_ids.append(ids[done])
                kept_owner.append(owner[done])
                hit = (rank == low) & ~done
                # in a run of overlapping pairs (a a a) every other one merges, from the left
                at = np.flatnonzero(hit)
                run = np.cumsum(np.r_[True, np.diff(at) != 1]) if len(at) else at
                place = np.arange(len(at)) - np.flatnonzero(np.r_[True, np.diff(at) != 1])[run - 1] if len(at) else at
                at = at[place % 2 == 0]
                ids = ids.copy()
                ids[at] = rank[at]
                keep = ~done
                keep[at + 1] = False
                ids, owner = ids[keep], owner[keep]
            ids, owner = np.concatenate(kept_ids), np.concatenate(kept_owner)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(short) + 1))
            ids = ids[order]
            for j, i in enumerate(short):
                out[i] = ids[cuts[j] : cuts[j + 1]]
        counts = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.empty(0, np.int64)), counts

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One piece of any length with a heap of pairs."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        table = dict(zip(self.pairs.tolist(), self.merged.tolist(), strict=True))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := table.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (r := table.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        return self.body[expand(self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])]


class Encoder:
    """Encodes slices of texts; ids of pieces met before come from a bounded cache."""

    def __init__(self, merger: Merger):
        self.merger, self.classes, self.store = merger, class_table(), PieceStore(merger.merge)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte start and end of every match, in order."""
        points, at = codepoints(data)
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(at, offsets)] = True
        start = at[:-1][match_starts(points, first[:-1], self.classes)]
        return start, np.append(start[1:], len(data))[: len(start)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offset of each text among them."""
        start, end = self.pieces(data, offsets)
        ids, counts = self.store.ids(data, start, end)
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(start, offsets, "left")]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text by the ranks in ``path``, decode the ids, and describe both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes. Null texts
    are empty: no ids, digests of nothing. Repeated rows stay; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merger.from_file(path))
        merger = encoder.merger
        names = np.array([str(i) for i in range(len(merger.offsets) - 1)], object)
        for texts in slices(batches):
            ids, at = encoder.encode(texts.data, texts.offsets)
            words = names[ids].tolist()
            decoded = merger.decode(ids)
            ends = np.append(0, np.cumsum(merger.offsets[ids + 1] - merger.offsets[ids]))[at]
            at, cut = at.tolist(), ends.tolist()
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column(0), pa.array(np.diff(at), pa.int64()),
                 pa.array([hashlib.sha256(",".join(words[a:b]).encode()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                 pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
                 pa.array(np.diff(texts.offsets), pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(
        released(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
