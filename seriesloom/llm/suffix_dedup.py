"""Exact substring dedup by refining q-gram buckets.

A string of ``length`` bytes that occurs twice is removed from both places.

* Every window of that length has an anchor: the rightmost least q-gram inside
  it. Equal windows have equal anchors at equal places, so the first buckets
  hold the windows by the q-gram at their anchor. Singleton buckets are done.
* A bucket is refined by the identifiers of later and earlier offsets: windows
  whose anchors lie in one stretch of places share most of their bytes, and the
  identifier of those bytes parts the bucket. Parts that are single are done,
  so text that repeats for only a q-gram goes no further than two identifiers.
* The windows around one anchor lie side by side. They are named together by
  the identifier of the text they span: places with the same identifier are
  resolved at once and go on as one.
* Buckets with several identifiers are refined: the windows of each get the
  identifier of what follows, and sorting on (bucket, identifier) leaves
  the groups of equal windows. Identifiers of any stretch come from the same
  prefix sums, so each level reuses the one before.

A bucket with very many different surroundings is dealt out by the identifier
of the window, so no task holds more than a bounded share of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import filters
from seriesloom.llm.arrays import Powers, SpanHash, Texts, buffers, expand, mix, released, seeded, slices
from seriesloom.llm.cutting import ADDED, cut, text_key, with_spans
from seriesloom.llm.tables import bounded_batches
from seriesloom.staging import stage

LENGTH = 200
Q = 32
# stretches of anchor places that get an identifier of their own
PARTS = 4
HOT = 20_000
WORK_BYTES = 2 << 20
# many arrays of eight bytes a byte stay in the processor's cache
SLICE_BYTES = 1 << 18
_GRAM, _ONE, _WINDOW, _PART = (seeded(256, s) for s in (81, 82, 84, 85))


def anchors(texts: Texts, powers: Powers, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position and q-gram identifier, first and last window start, of each run of windows."""
    n = len(texts.data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    at = np.arange(n - q + 1)
    gram = SpanHash(_GRAM, powers, texts.data).windows(q)
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - (at & 0xFFFFFFFF).astype(np.uint64))
    width, span = length - q + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    start = expand(texts.offsets[:-1], np.maximum(np.diff(texts.offsets) - length + 1, 0))
    low = 0xFFFFFFFF - (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = start + ((low - start) & 0xFFFFFFFF)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else none
    last = np.append(new[1:], len(start))[: len(new)] - 1
    return anchor[new], gram[anchor[new]], start[new], start[last]


def bucket_sizes(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(aid, n) of the q-gram buckets with more than one run of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for texts in slices(batches, limit=SLICE_BYTES):
            _, gram, first, last = anchors(texts, powers, length, q)
            # a run of several windows over one periodic text holds copies of itself only if its anchor comes again
            ids, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], names=["aid", "n"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(released(work), "aid long, n long").groupBy("aid").agg(F.sum("n").alias("n")).filter("n > 1")


def part_ids(span: SpanHash, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Run and identifier of the parts of each run of windows.

    A part holds the windows whose anchor lies in one stretch of places. All of
    them cover the q-gram at the anchor and what surrounds it as far as the
    stretch allows; the identifier stands for those bytes. Equal windows have
    equal anchors at equal places, so they lie in parts with equal identifiers.
    """
    width = -(-(length - q + 1) // PARTS)
    runs, ids = [], []
    for p in range(PARTS):
        low, high = width * p, min(width * (p + 1) - 1, length - q)
        has = np.flatnonzero((anchor - first >= low) & (anchor - last <= high))
        runs.append(has)
        ids.append(mix(span(anchor[has] - low, anchor[has] + length - high) + np.uint64(p + 1)))
    return np.concatenate(runs), np.concatenate(ids)


def part_sizes(docs: DataFrame, member: np.ndarray, length: int, q: int) -> DataFrame:
    """(pid, n) of the parts that occur more than once, among the runs whose q-gram bucket may have several."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for texts in slices(batches, limit=SLICE_BYTES):
            anchor, gram, first, last = anchors(texts, powers, length, q)
            keep = filters.contains(member, gram)
            _, ids = part_ids(SpanHash(_PART, powers, texts.data), anchor[keep], first[keep], last[keep], length, q)
            ids, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], names=["pid", "n"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(released(work), "pid long, n long").groupBy("pid").agg(F.sum("n").alias("n")).filter("n > 1")


def _members(texts: Texts, powers: Powers, others: Powers, member: np.ndarray, parts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Bucket, first and last window, and identifier (of other bases than the bucket's) of what they span, of the runs that may have several."""
    anchor, gram, first, last = anchors(texts, powers, length, q)
    keep = filters.contains(member, gram)
    anchor, gram, first, last = anchor[keep], gram[keep], first[keep], last[keep]
    runs, ids = part_ids(SpanHash(_PART, powers, texts.data), anchor, first, last, length, q)
    keep = np.unique(runs[filters.contains(parts, ids)])
    gram, first, last = gram[keep], first[keep], last[keep]
    return gram, first, last, SpanHash(_ONE, others, texts.data)(first, last + length)


def window_runs(docs: DataFrame, member: np.ndarray, parts: np.ndarray, length: int, q: int) -> DataFrame:
    """Runs of windows whose bucket and one of whose parts may have several, by identifiers alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, others = Powers(), Powers(1)
        for texts in slices(batches, limit=SLICE_BYTES):
            gram, first, last, one = _members(texts, powers, others, member, parts, length, q)
            row = np.searchsorted(texts.offsets, first, "right") - 1
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(one.view(np.int64)), texts.rows.column(0).take(at), texts.rows.column(1).take(at),
                 pa.array((first - texts.offsets[row]).astype(np.int32)), pa.array((last - first + length).astype(np.int32))],
                names=["aid", "one", "doc_id", "tk", "first", "span"])

    return bounded_batches(docs.select("doc_id", text_key().alias("tk"), "text")).mapInArrow(
        released(work), "aid long, one long, doc_id long, tk long, first int, span int")


def surroundings(docs: DataFrame, parts: np.ndarray, mixed: np.ndarray, length: int, q: int) -> DataFrame:
    """(aid, one, around): the bytes each identifier of a ``mixed`` bucket stands for, about once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, others, seen = Powers(), Powers(1), set()
        for texts in slices(batches, limit=SLICE_BYTES):
            # buckets that are mixed are among those that may have several
            gram, first, last, one = _members(texts, powers, others, mixed, parts, length, q)
            if len(seen) > 1_000_000:
                seen.clear()
            new = []
            for i, k in enumerate(zip(gram.tolist(), one.tolist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            body = texts.data.tobytes()
            around = [body[a:b] for a, b in zip(first[new].tolist(), (last[new] + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[new].view(np.int64)) for c in (gram, one)), pa.array(around, pa.binary())], names=["aid", "one", "around"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(released(work), "aid long, one long, around binary")


def _dealt(rows: DataFrame, length: int) -> DataFrame:
    """Surroundings as they are; of buckets with ``ways``, their windows dealt to that many parts by identifier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, offsets, _ = buffers(batch.column(3))
            span = None
            out: list[list] = [[] for _ in range(6)]
            for i, (aid, one, n, around, ways) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if ways is None:
                    for column, x in zip(out, (aid, 0, one, n, around, None), strict=True):
                        column.append(x)
                    continue
                span = span or SpanHash(_WINDOW, powers, data)
                start = np.arange(offsets[i], offsets[i + 1] - length + 1)
                ids = span(start, start + length)
                part = (ids % np.uint64(ways)).astype(np.int64)
                for p in np.unique(part).tolist():
                    has = np.flatnonzero(part == p)
                    for column, x in zip(out, (aid, p, one, n, None, has.astype("<i4").tobytes() + ids[has].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary(), pa.binary()), strict=True)], names=["aid", "part", "one", "n", "around", "ids"])

    return bounded_batches(rows.select("aid", "one", "n", "around", "ways")).mapInArrow(released(work), "aid long, part long, one long, n long, around binary, ids binary")


def _refine(table: pd.DataFrame, powers: Powers, length: int) -> pa.RecordBatch:
    """Ranges of windows that occur again, for whole buckets: rows are distinct surroundings of an anchor."""
    whole = np.array([x is not None for x in table["around"]], bool)
    blobs = [x if x is not None else b"" for x in table["around"]]
    lengths = np.array([len(b) for b in blobs], np.int64)
    base = np.cumsum(lengths) - lengths
    count = np.where(whole, lengths - length + 1, 0)
    start = expand(base, count)
    owner, index = np.repeat(np.arange(len(table)), count), expand(np.zeros(len(table), np.int64), count)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    ids = SpanHash(_WINDOW, powers, data)(start, start + length)
    for i in np.flatnonzero(~whole).tolist():
        packed = table["ids"].iat[i]
        k = len(packed) // 12
        owner, index = np.append(owner, np.full(k, i)), np.append(index, np.frombuffer(packed, "<i4", k))
        ids = np.append(ids, np.frombuffer(packed, np.uint64, k, 4 * k))
    bucket = pd.factorize(pd.Series(list(zip(table["aid"], table["part"], strict=True))))[0].astype(np.uint64)
    codes, _ = pd.factorize(mix(ids + bucket[owner] * np.uint64(0x9FB21C651E98DF25)))
    # surroundings that occur whole a second time are resolved already and only lend their windows
    again = (np.bincount(codes)[codes] > 1) & (table["n"].to_numpy() == 1)[owner] if len(codes) else np.zeros(0, bool)
    owner, index = owner[again], index[again]
    order = np.lexsort((index, owner))
    owner, index = owner[order], index[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (index[1:] != index[:-1] + 1)]) if len(owner) else owner
    last = np.append(new[1:], len(owner))[: len(new)] - 1
    who = table.iloc[owner[new]]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(who[c].to_numpy(np.int64)) for c in ("aid", "one")), pa.array(index[new], pa.int32()), pa.array(index[last] + length, pa.int32())], names=["aid", "one", "low", "high"])


def repeated_ranges(distinct: DataFrame, length: int) -> DataFrame:
    """(aid, one, low, high): byte ranges, within what an identifier spans, covered by repeated windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size, last = Powers(), [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["aid"], row["part"])
                if size > WORK_BYTES and key != last:
                    yield _refine(pd.DataFrame(held), powers, length)
                    held, size = [], 0
                last = key
                held.append(row)
                size += len(row["around"] or row["ids"])
        if held:
            yield _refine(pd.DataFrame(held), powers, length)

    dealt = distinct.repartition("aid", "part").sortWithinPartitions("aid", "part")
    return bounded_batches(dealt).mapInArrow(released(work), "aid long, one long, low int, high int")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that starts anywhere else too.

    Adds kept (remaining bytes), n_bytes, n_removed and n_spans in place of
    text; other columns stay, those with an added name are replaced. Matches never cross rows and are judged on the
    texts as they came. Rows that repeat a doc_id and its text are copies of
    each other. Null texts have kept null and zero counts.
    """
    docs = docs.drop(*ADDED)
    buckets = stage(bucket_sizes(docs, length, q), "suffix-buckets")
    member = filters.build(buckets.select("aid"), buckets.count())
    again = stage(part_sizes(docs, member, length, q).select("pid"), "suffix-parts")
    parts = filters.build(again, again.count())
    runs = stage(window_runs(docs, member, parts, length, q), "suffix-runs")
    key = ["aid", "one"]
    named = stage(runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("span").alias("span")), "suffix-named")
    # what occurs whole a second time is resolved; the rest of its bucket is compared window by window
    whole = named.filter("n > 1").select(*key, F.lit(0).alias("low"), F.col("span").alias("high"))
    mixed = stage(named.groupBy("aid").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("aid"), "suffix-mixed")
    around = surroundings(docs, parts, filters.build(mixed, mixed.count()), length, q).groupBy(*key).agg(F.first("around").alias("around"))
    # few buckets are that large; written, their size decides how they are joined
    large = stage(buckets.filter(F.col("n") > hot).select("aid", F.ceil(F.col("n") / hot).alias("ways")), "suffix-large")
    rows = around.join(named.select(*key, "n"), key).join(large, "aid", "left")
    partly = repeated_ranges(_dealt(rows, length), length).select(*key, "low", "high")
    ranges = stage(whole.unionByName(partly), "suffix-ranges")
    spans = runs.select(*key, "doc_id", "tk", "first").join(ranges, key).select(
        "doc_id", "tk", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high")).alias("stop"))
    return cut(with_spans(docs, spans))
