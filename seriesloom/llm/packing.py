"""Packing into training sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Tasks
pack runs of documents of bounded size on their own, so nothing is shuffled.
Within a run, the open sequence takes the item with the largest dot product of
its demand and what is left, both as shares of the limits. When nothing fits
whole, an item is cut to fill the sequence. The last sequence of a run is cut
into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seriesloom.llm.arrays import released, slices
from seriesloom.llm.library_tokens import worker_encoder
from seriesloom.llm.tables import bounded_batches

LENGTH = 2048
SEGMENTS = 256
END_ID = 1
RUN_BYTES = 2 << 20


def pack(tokens: np.ndarray, loss: np.ndarray, length: int = LENGTH, segments: int = SEGMENTS, loss_limit: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for items of ``tokens`` tokens whose last ``loss`` tokens bear loss.

    Equal dot products go to the first item. Items without tokens get no piece.
    """
    out, sequence = [], 0
    left, at = tokens.astype(np.int64).copy(), np.zeros(len(tokens), np.int64)
    loss_limit = max(1, min(loss_limit, length))

    def bearing(start: np.ndarray, size: np.ndarray, who=slice(None)) -> np.ndarray:
        silent = (tokens - loss)[who]
        return np.maximum(0, start + size - np.maximum(start, silent))

    room, seats, budget, fill = length, segments, loss_limit, 0
    while True:
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        size = left[open_]
        need = bearing(at[open_], size, open_)
        fits = (size <= room) & (need <= budget)
        if fits.any():
            value = size * (room / length**2) + seats / segments**2 + need * (budget / loss_limit**2)
            i = int(open_[np.argmax(np.where(fits, value, -1.0))])
            take = int(left[i])
        else:
            # cut the item that can put the most tokens into what is left
            silent = np.maximum(0, (tokens - loss)[open_] - at[open_])
            most = np.minimum(np.minimum(size, room), silent + budget)
            j = int(np.argmax(most))
            i, take = int(open_[j]), int(most[j])
        if take:
            budget -= int(bearing(at[i : i + 1], np.array([take]), slice(i, i + 1))[0])
            out.append((i, int(at[i]), take, sequence, fill))
            at[i] += take
            left[i] -= take
            room, fill, seats = room - take, fill + take, seats - 1
        if not room or not seats or not take or (not budget and not (np.maximum(0, (tokens - loss) - at)[left > 0] > 0).any()):
            sequence, room, seats, budget, fill = sequence + 1, length, segments, loss_limit, 0
    return _powers(out, sequence, fill)


def _powers(pieces: list[tuple[int, int, int, int, int]], last: int, fill: int) -> list[tuple[int, int, int, int, int]]:
    """Cut sequence ``last`` of ``fill`` tokens into sequences whose lengths are powers of two."""
    bits = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
    if len(bits) < 2:
        return pieces
    ends = np.cumsum(bits).tolist()
    out = [p for p in pieces if p[3] != last]
    for i, start, size, _, offset in (p for p in pieces if p[3] == last):
        while size:
            k = int(np.searchsorted(ends, offset, "right"))
            take = min(size, ends[k] - offset)
            out.append((i, start, take, last + k, offset - (ends[k] - bits[k])))
            start, size, offset = start + take, size - take, offset + take
    return out


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, segments: int = SEGMENTS, loss_limit: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Encode every text with the tokenizer file ``path``, append ``end_id``, and pack the ids.

    Returns a row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. Null and empty texts have the end
    id alone. Repeated rows are packed each; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, "kept")
        base, sequence = TaskContext.get().partitionId() << 36, 0
        for texts in slices(batches, limit=RUN_BYTES):
            ids, at = encoder.encode(texts.data, texts.offsets)
            tokens = np.diff(at) + 1
            doc_ids = texts.rows.column(0)
            pieces = pack(tokens, tokens, length, segments, loss_limit)
            whole = np.insert(ids, at[1:], end_id).astype("<u4")
            first = at[:-1] + np.arange(len(texts))
            who = np.array([p[0] for p in pieces], np.int64)
            start, size, seq, offset = (np.array([p[k] for p in pieces], np.int64) for k in range(1, 5))
            begin = (first[who] + start).tolist()
            blobs = [whole[a : a + n].tobytes() for a, n in zip(begin, size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(who)), pa.array(start), pa.array(size), pa.array(blobs, pa.binary()), pa.array(tokens[who]), pa.array(base + sequence + seq), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += int(seq.max()) + 1

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(
        released(work), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
