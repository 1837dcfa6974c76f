"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; its value at a byte depends on the
32 bytes up to there. A chunk ends where the value is the least within 24 bytes
on either side, so ends depend on nearby content only and come back in step
right after an insertion. Chunks with equal digests are copies: the one with
the smallest (doc_id, position) stays. The digest of a chunk under 64 bytes
covers the bytes around it that placed its ends too (56 before, 24 after), so
phrases of a few words are no copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import filters
from seriesloom.llm.arrays import Powers, SpanHash, Texts, mix, released, seeded, slices
from seriesloom.llm.cutting import ADDED, cut, text_key, with_spans
from seriesloom.llm.tables import bounded_batches
from seriesloom.staging import stage

MEMORY = 32
REACH = 24
# ends lie 25 bytes apart at least, and inside a character move on by up to three
LEAST_CHUNK = REACH + 1 - 3
# shorter chunks repeat by chance (sf0.01: 46 of 210 good documents without a shared passage lost text), so
# their digest takes in the bytes that placed their ends; those lie inside any longer copied passage
SHORT = 64
_GEAR = np.append(mix(seeded(256, 71)) >> np.uint64(32), 0).astype(np.uint32)
_ONE, _TWO = seeded(256, 72), seeded(256, 73)


def chunk_starts(texts: Texts) -> np.ndarray:
    """Ascending byte positions where a chunk starts; every non-empty text starts one."""
    lengths = np.diff(texts.offsets)
    gap = MEMORY + REACH
    # texts stand apart, so that no value depends on a neighbour
    place = np.arange(len(texts.data)) + np.repeat(gap * (1 + np.arange(len(texts))), lengths)
    symbols = np.full(len(texts.data) + gap * (len(texts) + 1), 256, np.uint16)
    symbols[place] = texts.data
    value = _GEAR[symbols]
    shift = 1
    while shift < MEMORY:
        value[shift:] = value[shift:] + (value[:-shift] << np.uint32(shift))
        shift *= 2
    value[symbols == 256] = np.iinfo(np.uint32).max
    wide = value.astype(np.uint64)
    span, low = 1, wide
    while 2 * span <= REACH:
        low = np.minimum(low, np.append(low[span:], np.full(span, np.iinfo(np.uint64).max, np.uint64)))
        span *= 2
    # low[i] is the least of wide[i : i + span]; two of them cover REACH values
    reach = np.minimum(low[: len(low) - (REACH - span)], low[REACH - span :])
    at = place[1:] - 1 if len(place) > 1 else place[:0]
    here = wide[at]
    ends = (here < reach[at - REACH]) & (here <= reach[np.minimum(at + 1, len(reach) - 1)])
    new = np.zeros(len(texts.data) + 1, bool)
    new[1 : len(ends) + 1] = ends
    # inside a character the chunk starts at the next one
    inner = np.flatnonzero(new[:-1] & ((texts.data & 0xC0) == 0x80))
    while len(inner):
        new[inner] = False
        inner = inner + 1
        inner = inner[inner < len(texts.data)]
        new[inner] = True
        inner = inner[(texts.data[inner] & 0xC0) == 0x80]
    new[texts.offsets] = True
    return np.flatnonzero(new[:-1])


def chunks(docs: DataFrame, member: np.ndarray | None = None) -> DataFrame:
    """(one, two, doc_id, tk, start, stop) of the chunks; with ``member``, of those that may be copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, others = Powers(), Powers(1)
        for texts in slices(batches):
            start = chunk_starts(texts)
            stop = np.append(start[1:], len(texts.data))[: len(start)]
            row = np.searchsorted(texts.offsets, start, "right") - 1
            size = np.diff(texts.offsets)[row]
            # a text too short for surroundings is one chunk
            keep = np.where(size < SHORT, start == texts.offsets[row], stop - start >= LEAST_CHUNK)
            start, stop, row, size = start[keep], stop[keep], row[keep], size[keep]
            stop = np.where(size < SHORT, start + size, stop)
            short = stop - start < SHORT
            left = np.maximum(start - np.where(short, MEMORY + REACH, 0), texts.offsets[row])
            right = np.minimum(stop + np.where(short, REACH, 0), texts.offsets[row + 1])
            one = SpanHash(_ONE, powers, texts.data)(left, right)
            if member is not None:
                keep = filters.contains(member, one)
                start, stop, left, right, row, one = (x[keep] for x in (start, stop, left, right, row, one))
            two = SpanHash(_TWO, others, texts.data)(left, right)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), texts.rows.column(0).take(at), texts.rows.column(1).take(at),
                 pa.array((start - texts.offsets[row]).astype(np.int32)), pa.array((stop - texts.offsets[row]).astype(np.int32))],
                names=["one", "two", "doc_id", "tk", "start", "stop"])

    return bounded_batches(docs.select("doc_id", text_key().alias("tk"), "text")).mapInArrow(released(work), "one long, two long, doc_id long, tk long, start int, stop int")


def substring_dedup(docs: DataFrame, least_run: int = 1) -> DataFrame:
    """Remove repeated chunks from texts.

    Adds n_bytes, n_removed, n_spans and kept (bytes of the remaining text) in
    place of text; other columns stay, those with an added name are replaced. Every chunk between two ends counts; only
    the first and last of a text can have under 22 bytes, and then don't. A text
    under 64 bytes is one chunk. Runs of neighbouring copies under ``least_run`` bytes
    stay, unless they are the whole text (default: all go). Null texts have kept null. Rows that repeat a doc_id and its text count once, so
    both are treated alike. A null doc_id comes before all others.
    """
    docs = docs.drop(*ADDED)
    copied = stage(chunks(docs).groupBy("one").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one"), "chunk-copied")
    count = copied.count()
    some = stage(chunks(docs, filters.build(copied, count)), "chunk-rows")
    first = some.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tk", "start")).alias("first")).filter("n > 1").drop("n")
    gone = some.join(first, ["one", "two"]).filter(~F.struct("doc_id", "tk", "start").eqNullSafe(F.col("first"))).select("doc_id", "tk", "start", "stop")
    return cut(with_spans(docs, gone), least_run)
