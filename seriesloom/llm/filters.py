"""Bit arrays that stand for sets of 64-bit values inside tasks.

An array has ten bits a value and never more than 64 MB. It lets every value of
the set through and some others, which later exact steps drop; a full array
saves no work but loses no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.arrays import mix, released

LARGEST = 64 << 20


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(values ^ np.uint64(salt)) % np.uint64(bits)).astype(np.int64) for salt in (0x51, 0x52)]


def build(values: DataFrame, count: int) -> np.ndarray:
    """Array for the first column (long) of ``values``, which has ``count`` rows."""
    bits = 8 * min(max(1024, 10 * count // 8), LARGEST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                have[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(have).tobytes()], pa.binary())], names=["have"])

    out = np.zeros(bits // 8, np.uint8)
    for row in values.coalesce(4).mapInArrow(released(work), "have binary").toLocalIterator():
        out |= np.frombuffer(row["have"], np.uint8)
    return out


def contains(have: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``values`` may be in the set."""
    found = np.ones(len(values), bool)
    for at in _places(values, 8 * len(have)):
        found &= (have[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found
