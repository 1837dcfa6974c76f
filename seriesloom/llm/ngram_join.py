"""N-gram Jaccard join by PartEnum signatures.

Every document becomes its set of distinct word shingles. Equal sets are one
class. Signatures (see ``signatures``) of distinct sets meet in buckets; within
a bucket, pairs are screened by an exact bound and the survivors tie sets to
families. A family's sets are then compared exactly, in blocks of fixed size.

* Nothing is emitted per pair: tasks return spanning forests of what they found.
* The screen is a parity sketch. The Hamming distance of two sketches never
  exceeds the number of differing elements, so it drops no linked pair. Large
  bands are dealt by groups of cells (PartEnum's first level), and the sketch with
  them: a linked pair passes the screen of one group at least.
* Copies collapse before anything is shuffled per signature; a family larger
  than a block is compared block against block, in separate tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.arrays import Powers, mix, released, slices
from seriesloom.llm.cutting import text_key
from seriesloom.llm.shingles import SIZE, digest, shingle_sets
from seriesloom.llm.signatures import Bands, Signed, signatures
from seriesloom.llm.tables import bounded_batches, components, partitions
from seriesloom.staging import stage

THRESHOLD = Fraction(3, 4)
PART_SIGNATURES = 1_500_000
ALONE = 2  # the third space of signatures: single elements
FAMILY_BLOCK = 1000
_KEYS = "doc_id long, text_key long, n_shingles long, key string, hot array<long>, hot_rows array<long>"


def _frequent(sets: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Elements in at least ``share`` of a slice's sets, and in how many."""
    if len(sets) < 40:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found, rows = np.unique(np.concatenate(sets), return_counts=True)
    keep = rows >= max(8, share * len(sets))
    return found[keep], rows[keep]


def set_keys(docs: DataFrame, size: int, share: float) -> DataFrame:
    """One row per document: size and 128-bit digest of its shingle set, and what is frequent around it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for texts in slices(batches):
            sets = shingle_sets(texts, powers, size)
            hot, rows = _frequent(sets, share)
            none = [[] for _ in range(len(texts) - 1)]
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column(0).cast(pa.int64()), texts.rows.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s).hex() if len(s) else None for s in sets], pa.string()),
                 pa.array([hot.view(np.int64), *none], pa.list_(pa.int64())), pa.array([rows, *none], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "key", "hot", "hot_rows"])

    return bounded_batches(docs.select("doc_id", text_key().alias("text_key"), "text")).mapInArrow(released(work), _KEYS)


class Deal(NamedTuple):
    """How each instance is dealt into parts: by groups of cells, and each group by signature value.

    A set's sketch is dealt with its cells, so it travels once however many
    groups there are. A group keeps eight cells or more; only beyond that
    signature values divide the parts further.
    """

    groups: np.ndarray
    splits: np.ndarray
    base: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(bands: Bands, ways: np.ndarray) -> Deal:
        groups = np.minimum(ways, np.maximum(1, bands.cells // 8))
        splits = -(-ways // groups)
        # two bits for each element of the largest set, and some for uneven groups
        return Deal(groups, splits, np.cumsum(groups * splits) - groups * splits, 8 * ((2 * bands.ends // groups + 7) // 8 + 4))

    @property
    def parts(self) -> int:
        return int((self.groups * self.splits).sum())


def _sketches(values: np.ndarray, group: np.ndarray, groups: int, width: int) -> np.ndarray:
    """Parity of the number of elements in each of ``width`` cells, packed into bytes, for every group of a set."""
    cell = group * width + (mix(values ^ np.uint64(77)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=groups * width) & 1).astype(np.uint8)).reshape(groups, -1)


def _packed(signed: Signed, space: int, instance: np.ndarray, sizes: np.ndarray, names: np.ndarray, deal: Deal) -> Iterator[tuple[int, bytes]]:
    """Part and block of the signatures over one space. Single elements carry the sketch of the whole set."""
    whole = space == ALONE
    groups = np.ones(len(sizes), np.int64) if whole else deal.groups[instance]
    spread = (deal.groups * deal.splits if whole else deal.splits)[instance]
    bits = (deal.bits * deal.groups if whole else deal.bits)[instance]
    group = signed.cell % groups[signed.owner]
    way = group * spread[signed.owner] + (signed.ids % spread[signed.owner].astype(np.uint64)).astype(np.int64)
    part = 3 * (deal.base[instance[signed.owner]] + way) + space
    used = np.bincount(signed.owner, minlength=len(sizes))
    most = int(groups.max())
    of_group = np.bincount(signed.owner * most + group, minlength=len(sizes) * most)
    cut = np.searchsorted(signed.value_owner, np.arange(len(sizes) + 1))
    sketch = {o: _sketches(signed.values[cut[o] : cut[o + 1]], signed.value_cell[cut[o] : cut[o + 1]] % groups[o], int(groups[o]), int(bits[o]))
              for o in np.flatnonzero(used).tolist()}
    order = np.lexsort((signed.owner, part))
    ids, owner, group, part = signed.ids[order], signed.owner[order], group[order], part[order]
    cuts = np.append(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        who, many = np.unique(owner[a:b], return_counts=True)
        head = np.array([len(who), b - a, bits[who[0]] // 8], np.int64)
        # six bytes of a signature are enough: sets that meet by chance are screened like all others
        short = ids[a:b].view(np.uint8).reshape(-1, 8)[:, 2:]
        at = group[a]
        counts = (x.astype(np.int32).tobytes() for x in (sizes[who], many, of_group[who * most + at], used[who]))
        yield int(part[a]), b"".join([head.tobytes(), *counts, short.tobytes(), names[who].tobytes(), *(sketch[w][at].tobytes() for w in who.tolist())])


def signature_blocks(docs: DataFrame, size: int, bands: Bands, frequent: np.ndarray, deal: Deal) -> DataFrame:
    """Signatures packed by part; a part is a share of one space of an instance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for texts in slices(batches):
            sets, keys = [], []
            for values in shingle_sets(texts, powers, size):
                key = digest(values)
                if len(values) and key not in seen:
                    seen.add(key)
                    sets.append(values)
                    keys.append(key)
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            names = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
            packed = [block for step, spaces in enumerate(signatures(sets, bands, frequent)) for space, signed in enumerate(spaces)
                      for block in _packed(signed, space, bands.of(sizes) + step, sizes, names, deal)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], names=["part", "block"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(released(work), "part int, block binary")


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        top = self.up[nodes]
        while True:
            above = self.up[top]
            if (above == top).all():
                self.up[nodes] = top
                return top
            top = above

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Join pairs; the indices of those that tied two trees."""
        used = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            if x != y:
                self.up[max(x, y)] = min(x, y)
                used.append(i)
        return used


def _allowed(total: np.ndarray, here: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Most differing elements in a group of cells for sets that may differ in ``total``, judged by one set's cells.

    ``here`` of its ``used`` cells lie in the group. Shares of ``total + 1`` in
    proportion to the cells, rounded up, reach ``total + 1`` over all groups, so
    a linked pair stays below its share in one at least; it differs in fewer
    elements there than the set has cells, so it also shares one of them. A set
    with too few cells for this decides in a later space.
    """
    return np.where(used > total, -(-here * (total + 1) // np.maximum(used, 1)) - 1, -1)


def _meet(blocks: list[bytes], share: Fraction, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest of the screened pairs of one part: names of the sets, and the tied indices."""
    sizes, many, here, used, ids, names, sketches = [], [], [], [], [], [], []
    for blob in blocks:
        n, total, width = np.frombuffer(blob, np.int64, 3).tolist()
        at = 24
        for out, dtype, count in ((sizes, np.int32, n), (many, np.int32, n), (here, np.int32, n), (used, np.int32, n), (ids, np.uint8, 6 * total), (names, np.uint8, 16 * n), (sketches, np.uint8, width * n)):
            out.append(np.frombuffer(blob, dtype, count, at))
            at += count * np.dtype(dtype).itemsize
    sketch = np.concatenate([s.reshape(-1, len(s) // len(z)) for s, z in zip(sketches, sizes, strict=True)])
    names = np.concatenate(names).reshape(-1, 16)
    size, here, used = (np.concatenate(x).astype(np.int64) for x in (sizes, here, used))
    owner = np.repeat(np.arange(len(names)), np.concatenate(many))
    short, ids = np.concatenate(ids).reshape(-1, 6), np.zeros(len(owner), np.uint64)
    ids.view(np.uint8).reshape(-1, 8)[:, 2:] = short
    # the same set can come from several tasks
    _, first, same = np.unique(names.view("V16").ravel(), return_index=True, return_inverse=True)
    owner = first[same[owner]]
    order = np.lexsort((owner, ids))
    ids, owner = ids[order], owner[order]
    keep = np.r_[True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])]
    ids, owner = ids[keep], owner[keep]
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    count = np.diff(np.append(start, len(ids)))
    start, count = start[count > 1], count[count > 1]
    forest, ties_a, ties_b, turn = Forest(len(names)), [], [], 0
    while len(start):
        # compare member ``turn`` of every open bucket with the members after it that aren't yet in its tree
        hub = np.repeat(owner[start + turn], count - turn - 1)
        other = owner[np.repeat(start + turn + 1 - (np.cumsum(count - turn - 1) - (count - turn - 1)), count - turn - 1) + np.arange(int((count - turn - 1).sum()))]
        apart = forest.roots(hub) != forest.roots(other)
        pairs = np.unique(np.stack([np.minimum(hub, other)[apart], np.maximum(hub, other)[apart]], 1), axis=0)
        for i in range(0, len(pairs), 20_000):
            a, b = pairs[i : i + 20_000].T
            differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
            most = (size[a] + size[b]) * share.numerator // share.denominator
            near = differ <= (most if whole else np.maximum(_allowed(most, here[a], used[a]), _allowed(most, here[b], used[b])))
            a, b = a[near], b[near]
            tied = forest.join(a, b)
            ties_a.append(a[tied])
            ties_b.append(b[tied])
        turn += 1
        open_ = count > turn + 1
        start, count = start[open_], count[open_]
        if len(start) and turn in (1, 2, 4, 8) or turn % 16 == 0 and len(start):
            members = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            root = forest.roots(owner[members])
            at = np.cumsum(count) - count
            split = np.maximum.reduceat(root, at) != np.minimum.reduceat(root, at)
            start, count = start[split], count[split]
    none = np.empty(0, np.int64)
    return names, np.concatenate(ties_a) if ties_a else none, np.concatenate(ties_b) if ties_b else none


def candidate_ties(blocks: DataFrame, parts: int, share: Fraction) -> DataFrame:
    """Spanning forest, part by part, of the pairs that share a signature and pass the screen."""

    def answer(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        names, a, b = _meet(blobs, share, part % 3 == ALONE)
        return pa.RecordBatch.from_arrays([pa.array([names[i].tobytes().hex() for i in side], pa.string()) for side in (a, b)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield answer(now, held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield answer(now, held)

    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(work), "a string, b string")


def _membership(keys: DataFrame, count: int) -> np.ndarray:
    """Bit array that holds every key (and a few others): a fixed ten bits a key, at most 64 MB.

    It only saves work; a full array would let all rows through.
    """
    bits = 8 * min(max(1024, 10 * count // 8), 64 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, bool)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                have[[int(key[i : i + 16], 16) % bits for i in (0, 16)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(have).tobytes()], pa.binary())], names=["have"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.select("key").coalesce(4).mapInArrow(released(work), "have binary").toLocalIterator():
        out |= np.frombuffer(row["have"], np.uint8)
    return out


def family_sets(docs: DataFrame, size: int, member: np.ndarray) -> DataFrame:
    """(key, elements) of the sets whose key may be in a family, once per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, bits = Powers(), set(), 8 * len(member)
        for texts in slices(batches):
            keys, values = [], []
            for elements in shingle_sets(texts, powers, size):
                key = digest(elements).hex()
                if key in seen or not len(elements):
                    continue
                at = [int(key[i : i + 16], 16) % bits for i in (0, 16)]
                if all(member[x >> 3] & (128 >> (x & 7)) for x in at):
                    seen.add(key)
                    keys.append(key)
                    values.append(elements.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], names=["key", "elements"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(released(work), "key string, elements binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of two blocks: a matrix product for common elements, counting for rare ones."""
    count = np.zeros((len(left), len(right)), np.int64)
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(map(len, left))
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    cols = [codes[:split], codes[split:]]
    often = [np.bincount(c, minlength=len(values)) for c in cols]
    both = (often[0] > 0) & (often[1] > 0)
    dense = np.flatnonzero(both & (often[0] * often[1] > 256))
    for at in range(0, len(dense), 2048):
        some = dense[at : at + 2048]
        place = np.full(len(values), -1)
        place[some] = np.arange(len(some))
        sides = []
        for r, c, n in zip(rows, cols, (len(left), len(right)), strict=True):
            m = np.zeros((n, len(some)), np.float32)
            has = place[c] >= 0
            m[r[has], place[c[has]]] = 1
            sides.append(m)
        count += (sides[0] @ sides[1].T).astype(np.int64)
    rare = both & (often[0] * often[1] <= 256)
    keep = [rare[c] for c in cols]
    order = [np.argsort(c[k], kind="stable") for c, k in zip(cols, keep, strict=True)]
    r0, c0 = rows[0][keep[0]][order[0]], cols[0][keep[0]][order[0]]
    r1, c1 = rows[1][keep[1]][order[1]], cols[1][keep[1]][order[1]]
    low, high = np.searchsorted(c1, c0, "left"), np.searchsorted(c1, c0, "right")
    times = high - low
    pick = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    np.add.at(count, (np.repeat(r0, times), r1[pick]), 1)
    return count


def _exact(threshold: Fraction) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("elements").to_pylist()]
        block, one, two = table.column("block").to_numpy(), int(table.column("one")[0].as_py()), int(table.column("two")[0].as_py())
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        both = overlaps([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(s) for s in sets], np.int64)
        total = size[left][:, None] + size[right][None, :] - both
        a, b = np.nonzero(both * threshold.denominator >= total * threshold.numerator)
        a, b = left[a], right[b]
        a, b = a[a != b], b[a != b]
        used = Forest(len(sets)).join(a, b)
        return pa.table({"a": pa.array([keys[a[i]] for i in used], pa.string()), "b": pa.array([keys[b[i]] for i in used], pa.string())})

    return work


def exact_ties(sets: DataFrame, threshold: Fraction, block: int = FAMILY_BLOCK) -> DataFrame:
    """Spanning forest, block pair by block pair, of the exact links. ``sets``: root, key, elements, members."""
    numbered = sets.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn(
        "block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).otherwise(0))
    dealt = numbered.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", "key", "elements", "block", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("two"))
    return dealt.groupBy("root", "one", "two").applyInArrow(_exact(threshold), "a string, b string")


def jaccard_classes(docs: DataFrame, size: int = SIZE, threshold: Fraction = THRESHOLD, frequent_share: float = 0.05) -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of ``threshold`` or more.

    Returns doc_id, n_shingles, class_id (key of the document's equal-set class,
    null without words), component_id: the smallest doc_id reachable by links,
    group_id (names the component also where doc_id is null or repeated; null
    without words) and text_key, which with doc_id tells the row's text. Null or
    empty texts link with nothing and are their own component.
    Repeated rows stay repeated. Rows with a null doc_id take part in links and
    get the smallest non-null doc_id of their component, if it has one. Columns
    besides doc_id and text are ignored.
    """
    keys = stage(set_keys(docs, size, frequent_share), "ngram-keys")
    seen = keys.filter("n_shingles > 0").groupBy("n_shingles").agg(F.count(F.lit(1)).alias("n"))
    top = seen.agg(F.max("n_shingles").alias("m"), F.sum("n").alias("n")).first()
    if not top["m"]:
        return keys.select("doc_id", "n_shingles", F.col("key").alias("class_id"), F.col("doc_id").alias("component_id"),
                           F.col("key").alias("group_id"), "text_key")
    bands = Bands(threshold, top["m"])
    # signatures per instance decide into how many parts it is dealt; sizes are summed by band on the cluster
    at = F.size(F.filter(F.array(*(F.lit(int(e)) for e in bands.ends)), lambda e: e < F.col("n_shingles")))
    by_band = {r["band"]: r["total"] for r in seen.groupBy(at.alias("band")).agg(F.sum("n").alias("total")).collect()}
    load = np.array([bands.cells[i] * (by_band.get(i, 0) + by_band.get(i - 1, 0)) for i in range(len(bands.ends))], np.float64)
    ways = np.maximum(1, np.ceil(load / PART_SIGNATURES)).astype(np.int64)
    # elements in a twentieth of the documents: there are at most twenty times the mean set size of them
    hot = keys.filter(F.size("hot") > 0).select(F.explode(F.arrays_zip("hot", "hot_rows")).alias("h")).groupBy("h.hot").agg(
        F.sum("h.hot_rows").alias("rows")).filter(F.col("rows") >= 0.5 * frequent_share * top["n"])
    frequent = np.sort(np.array([r["hot"] for r in hot.collect()], np.int64).view(np.uint64))
    deal = Deal.of(bands, ways)
    blocks = signature_blocks(docs, size, bands, frequent, deal)
    ties = stage(candidate_ties(blocks, max(partitions(docs), deal.parts), bands.share), "ngram-ties")
    family = stage(components(ties, "ngram-families"), "ngram-family")
    member = family.select(F.col("node").alias("key"), "root").union(family.select(F.col("root").alias("key"), "root").distinct())
    count = family.agg(F.count(F.lit(1)), F.countDistinct("root")).first()
    linked = None
    if count[0]:
        held = family_sets(docs, size, _membership(member, count[0] + count[1]))
        sets = held.groupBy("key").agg(F.first("elements").alias("elements")).join(member, "key")
        large = member.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        links = stage(exact_ties(sets.join(large, "root"), threshold), "ngram-links")
        linked = stage(components(links, "ngram-components"), "ngram-component")
    named = keys.select("doc_id", "text_key", "n_shingles", F.col("key").alias("class_id"))
    if linked is None:
        named = named.withColumn("root", F.col("class_id"))
    else:
        named = named.join(linked, F.col("class_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class_id")).drop("node")
    smallest = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "root", "left").select(
        "doc_id", "n_shingles", "class_id",
        F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
        F.col("root").alias("group_id"), "text_key")
