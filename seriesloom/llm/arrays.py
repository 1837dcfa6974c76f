"""Arrow and numpy helpers shared by the text operators.

Texts of an Arrow batch stay one byte buffer. Operators work on slices of about
a megabyte, so memory in a task depends on the longest text, not on the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values from a counter."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _ODD)


PRIME = np.uint64((1 << 31) - 1)
_HALF = np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**62 as values of at most 2**31 with the same remainder modulo ``PRIME``."""
    x = (x & PRIME) + (x >> _HALF)
    return (x & PRIME) + (x >> _HALF)


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, _fold(out * np.uint64(step))])
        step = step * step % int(PRIME)
    return out[:n].astype(np.uint32)


class Powers:
    """Powers of two bases and of their inverses modulo ``PRIME``, grown on demand; ``kind`` picks the bases."""

    BASES = ((1_103_515_245, 1_812_433_253), (741_103_597, 1_597_334_677))

    def __init__(self, kind: int = 0):
        self.bases = self.BASES[kind]
        self.up, self.down = ([np.ones(1, np.uint32)] * 2 for _ in range(2))

    def upto(self, n: int) -> None:
        if n > len(self.up[0]):
            n = max(n, 2 * len(self.up[0]))
            self.up = [_powers(b, n) for b in self.bases]
            self.down = [_powers(pow(b, -1, int(PRIME)), n) for b in self.bases]


class SpanHash:
    """Content hashes of any spans of an array of small integers, in constant time per span.

    Polynomials in two bases over a prime field, 62 bits together. (Modulo a
    power of two, texts built by doubling with a swap collide in every base.)
    """

    def __init__(self, table: np.ndarray, powers: Powers, symbols: np.ndarray):
        powers.upto(len(symbols) + 1)
        self.powers, self.sums = powers, []
        for k, up in enumerate(powers.up):
            terms = (table >> np.uint64(32 * k) & PRIME)[symbols]
            terms *= up[: len(symbols)]
            low = terms & PRIME
            terms >>= _HALF
            terms += low
            # sums of terms below 2**32 stay exact in 64 bits
            sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)

    def _mixed(self, parts: list[np.ndarray], length: np.ndarray | np.uint64) -> np.ndarray:
        for part in parts:
            part -= PRIME * (part >= PRIME)
        return mix((parts[0] << _HALF | parts[1]) + length * _ODD)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mixed([_fold(_fold(sums[end] - sums[start]) * down[start]) for sums, down in zip(self.sums, self.powers.down, strict=True)], (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, by their starts."""
        n = len(self.sums[0]) - length
        return self._mixed([_fold(_fold(sums[length:] - sums[:n]) * down[:n]) for sums, down in zip(self.sums, self.powers.down, strict=True)], np.array([length], np.uint64))


class Texts:
    """Texts of a few rows as one byte array; ``offsets`` has one more entry than rows. Null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch, null: np.ndarray):
        self.data, self.offsets, self.rows, self.null = data, offsets, rows, null

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that hands freed memory back to the system at the end of a task; workers live on and would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets from 0 and null flags of a string or binary column."""
    null = np.asarray(column.is_null())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body and len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0], null


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of rows whose texts have about ``limit`` bytes together; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets, null = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], batch.slice(at, end - at), null[at:end])
            at = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of true positions that don't cross rows."""
    n = len(inside)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of each word ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[texts.data], texts.offsets)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte offset of each with the end appended."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, np.arange(len(data) + 1)
    return points, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
