"""Token-id files: Re-Pair grammars per shard.

A shard holds the ids of consecutive documents. Rounds replace frequent pairs of
neighbouring ids by new symbols (never across documents) until none occurs twice,
and store the rules with the length each one expands to. A document is decoded from its own stretch
of symbols; the lengths tell where any of its ids lies.

Shards are rows of a Parquet table, so writing is all or nothing per task and a
lost executor's shards are written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm.arrays import mix, released, slices
from seriesloom.llm.library_tokens import worker_encoder
from seriesloom.llm.tables import bounded_batches, bounds, bucket, partitions
from seriesloom.staging import stage

MAGIC = b"RPG1"
END_ID = 1
SHARD_IDS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _best(touch: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the ascending places beat those that overlap them (``touch``: with the place before); of a run of equal ones every second does."""
    left, right = np.zeros(len(weight), np.uint64), np.zeros(len(weight), np.uint64)
    np.multiply(weight[:-1], touch, out=left[1:])
    np.multiply(weight[1:], touch, out=right[:-1])
    same = weight == left
    if not same.any():
        return (weight > left) & (weight > right)
    # only places in runs of equal ones look beyond their neighbours
    end = np.append(same[1:], False)
    wins = (same | (weight > left)) & (end | (weight > right))
    head, tail = np.flatnonzero(~same & end), np.flatnonzero(same & ~end)
    good = wins[head] & wins[tail]
    size = tail - head + 1
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wins[np.repeat(head, size) + within] = np.repeat(good, size) & (within % 2 == 0)
    return wins


def compress(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, start of each document among them, rules (left, right), expansion lengths, first new symbol.

    Rounds go on until no pair occurs twice. In a round a place is replaced where
    its pair is more frequent than those that overlap it (equally frequent pairs
    by a hash, so that long copies shrink by a share in each round, not by one
    pair). A pair of old symbols never becomes more frequent, so a place whose
    pair occurs once is looked at again only when a new symbol comes beside it.
    Symbols stay where they are and know their neighbours, so that a round costs
    what its places cost, not the whole shard.
    """
    n = len(ids)
    base = free = int(ids.max(initial=0)) + 1
    symbols, starts = ids.astype(np.int64), starts.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    last, gone = np.zeros(n, bool), np.zeros(n, bool)
    last[starts[starts > 0] - 1] = last[n - 1 :] = True
    rules, at = [], np.flatnonzero(~last)
    while True:
        key = symbols[at] << 32 | symbols[after[at]]
        if rules and len(at) > 4096:
            # beside new symbols, most pairs that occur once are alone in their slot of a hashed count
            bits = min(22, len(at).bit_length() + 1)
            slot = (key.view(np.uint64) * _ODD >> np.uint64(64 - bits)).view(np.int64)
            # places are picked by number: faster than by flags that change often
            some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
            at, key = at[some], key[some]
        codes, pairs = pd.factorize(key, size_hint=len(key) // 4)
        counts = np.bincount(codes, minlength=len(pairs))
        again = np.flatnonzero(counts[codes] > 1)
        at, codes = at[again], codes[again]
        if not len(at):
            break
        weight = (counts.astype(np.uint64) << np.uint64(32) | mix(pairs.view(np.uint64)) >> np.uint64(32))[codes]
        wins = np.flatnonzero(_best(after[at[:-1]] == at[1:], weight))
        hit, won = at[wins], codes[wins]
        got = np.bincount(won, minlength=len(pairs))
        if got.max(initial=0) > 1:
            more = np.flatnonzero(got[won] > 1)
            hit, won, used = hit[more], won[more], np.flatnonzero(got > 1)
        else:
            # no pair won twice: take the most frequent one on its own
            best = int(np.argmax(counts))
            places = at[codes == best]
            hit = places[_best(after[places[:-1]] == places[1:], np.ones(len(places), np.uint64))]
            if len(hit) < 2:
                # it stands twice in a run of three and nowhere else; so do others, which go with it
                run = np.flatnonzero((after[at[:-1]] == at[1:]) & (codes[:-1] == codes[1:]))
                idle = np.zeros(len(pairs), bool)
                idle[codes[run]] = True
                at = at[np.flatnonzero(~(idle & (counts == 2))[codes])]
                continue
            won, used = np.full(len(hit), best), np.array([best])
        number = np.zeros(len(pairs), np.int64)
        number[used] = free + np.arange(len(used))
        free += len(used)
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1))
        out = after[hit]
        symbols[hit] = number[won]
        last[hit] = last[out]
        gone[out] = gone[hit] = True
        after[hit] = after[out]
        before[after[hit]] = hit
        # ascending runs, which a stable sort merges
        near = np.append(hit, before[hit[hit > 0]])
        at = np.concatenate([at[np.flatnonzero(~gone[at])], near[np.flatnonzero(~last[near])]])
        gone[hit] = False
        at.sort(kind="stable")
        at = at[np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])]
    kept = np.flatnonzero(~gone)
    sizes, done = np.ones(free, np.int64), base
    for made in rules:
        sizes[done : done + len(made)] = sizes[made].sum(1)
        done += len(made)
    return symbols[kept], np.searchsorted(kept, starts), np.concatenate(rules) if rules else np.empty((0, 2), np.int64), sizes[base:], base


def expand_symbols(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids of a stretch of symbols; the expansion lengths say where each side of a rule goes."""
    def size(x: np.ndarray) -> np.ndarray:
        sizes, new = np.ones(len(x), np.int64), np.flatnonzero(x >= base)
        sizes[new] = lengths[x[new] - base]
        return sizes

    sizes = size(symbols)
    ends = np.cumsum(sizes)
    out, at = np.empty(int(ends[-1]) if len(ends) else 0, np.int64), ends - sizes
    while len(symbols):
        plain, new = np.flatnonzero(symbols < base), np.flatnonzero(symbols >= base)
        out[at[plain]] = symbols[plain]
        rule, at = symbols[new] - base, at[new]
        left = rules[rule, 0]
        symbols, at = np.append(left, rules[rule, 1]), np.append(at, at + size(left))
    return out


def to_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard as a file body."""
    starts = np.cumsum(counts) - counts
    symbols, starts, rules, lengths, base = compress(ids, starts)
    head = np.array([len(doc_ids), len(symbols), len(rules), base], "<i8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), counts.astype("<u4").tobytes(),
                     starts.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes()])


class Shard:
    """Reader of a file body with access to single documents."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, symbols, rules, self.base = np.frombuffer(body, "<i8", 4, 4).tolist()
        at, parts = 36, []
        for dtype, n in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", docs), ("<u4", 2 * rules), ("<u4", rules), ("<u4", symbols)):
            parts.append(np.frombuffer(body, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
        known, ids, self.counts, self.starts, flat, self.lengths, self.symbols = parts
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.rules, self.lengths = flat.reshape(-1, 2).astype(np.int64), self.lengths.astype(np.int64)

    def all(self) -> np.ndarray:
        return expand_symbols(self.symbols.astype(np.int64), self.rules, self.lengths, self.base)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``, decoding only the symbols that cover them."""
        end = int(self.starts[i + 1]) if i + 1 < len(self.starts) else len(self.symbols)
        symbols = self.symbols[int(self.starts[i]) : end].astype(np.int64)
        sizes = np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(sizes)
        stop = int(self.counts[i]) if stop is None else stop
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        first = int(ends[a] - sizes[a]) if a < len(ends) else 0
        return expand_symbols(symbols[a:b], self.rules, self.lengths, self.base)[start - first : max(stop, start) - first]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending doc_id order to ``path``.

    Null and empty texts have the end id alone. Null doc_ids come first; rows
    that repeat a doc_id stand beside each other, ordered by their ids.
    """
    count = 2 * partitions(docs)
    cuts = bounds(docs, "doc_id", count)
    # ids travel to their shard in two bytes where the vocabulary allows
    dtype = "<u2" if max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) <= 1 << 16 else "<u4"
    width = int(dtype[2])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, "dropped")
        for texts in slices(batches):
            ids, at = encoder.encode(texts.data, texts.offsets)
            body = np.insert(ids, at[1:], end_id).astype(dtype).tobytes()
            ends = (width * (at + np.arange(len(at)))).tolist()
            yield pa.RecordBatch.from_arrays([texts.rows.column(0), pa.array([body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, names, held, size = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            body = to_bytes(names, np.array([len(x) // width for x in held], np.int64), np.frombuffer(b"".join(held), dtype))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([body], pa.large_binary())],
                                              names=["bucket", "part", "n_ids", "body"])

        for batch in batches:
            for b, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (b != now or size + len(ids) // width > SHARD_IDS):
                    yield done()
                    part = part + 1 if b == now else 0
                    names, held, size = [], [], 0
                now = b
                names.append(doc_id)
                held.append(ids)
                size += len(ids) // width
        if held:
            yield done()

    encoded = bounded_batches(docs.select("doc_id", "text")).mapInArrow(released(encode), "doc_id long, ids binary")
    ordered = encoded.select(bucket("doc_id", cuts).cast("int").alias("bucket"), "doc_id", "ids").repartition(partitions(docs), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    ordered.mapInArrow(released(shards), "bucket int, part int, n_ids long, body binary").write.parquet(path)


def _decoded(spark: SparkSession, path: str, last: str, kind: pa.DataType, made: Callable[[bytes], object]) -> DataFrame:
    """(doc_id, start, n_tokens, ``last``) of every document; ``made`` turns its little-endian unsigned 32-bit ids into the last column."""
    shards = spark.read.parquet(path)
    # a row a shard: one running total over a small table, written so that its size decides how it is joined
    before = W.orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)
    base = stage(shards.select("bucket", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "token-base")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(1)[i].as_py())
                body = memoryview(shard.all().astype("<u4")).cast("B")
                counts = shard.counts.astype(np.int64)
                local = np.cumsum(counts) - counts
                ends = (4 * np.append(local, counts.sum())).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(local + batch.column(0)[i].as_py()), pa.array(counts), pa.array([made(body[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], kind)],
                    names=["doc_id", "start", "n_tokens", last])

    placed = shards.select("bucket", "part", "body").join(base, ["bucket", "part"]).select("base", "body")
    return bounded_batches(placed).mapInArrow(released(work), f"doc_id long, start long, n_tokens long, {last} {'binary' if pa.types.is_binary(kind) else 'long'}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it."""
    return _decoded(spark, path, "ids", pa.binary(), bytes)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, taken where its shard is decoded."""
    return _decoded(spark, path, "ids_crc32", pa.int64(), zlib.crc32)
