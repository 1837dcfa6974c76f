"""Repair of conversation structure: cheapest edits by iterative-deepening A*.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Its rows
are kept, deleted or given another role, and empty turns are inserted. The
search goes depth first in ASCII order of the edits' initials (D, I, K, R) under
a cost bound that grows by one. A state is (row, what came last); the least cost
of the remaining rows on their own is the estimate, and states that failed are
remembered with the budget they failed under. The first path found is the
cheapest and, among equals, the least as text.

Long conversations are searched in stretches of ``STRETCH`` rows, from every
state to every state. Two neighbouring stretches compose: costs add up, and of
equal costs the one with the lesser first text wins. This product is
associative, so the rows are sorted by range and a conversation may lie in any
number of partitions; each partition sends on one product, whatever its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.arrays import released
from seriesloom.llm.tables import bounded_batches, partitions
from seriesloom.staging import stage

STRETCH = 64
SPACES = r"\x20\x09-\x0D"
# what came last: nothing, system, user, assistant
STATES = 4
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
# the turn that may be put after each state, and what a kept role leads to
NEXT = (2, 2, 3, 2)
KEPT = {SYSTEM: (1, None, None, None), USER: (2, 2, None, 2), ASSISTANT: (None, None, 3, None), OTHER: (None,) * 4}
DELETE, RENAME, INSERT, SPOILT = 3, 2, 2, 1
# edits after the last row that end each state properly
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MEMORY = 100_000
_NONE = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by crc32 of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats
    it, 4 makes its role user. Nulls read as one space; null ids and turns stay.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    some = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = some.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"))
    return twice.drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """A small row (conv_id, turn, role, key, code) for each row; ``key`` stands for the text, ``code`` for initial and first fault.

    Null texts and roles read as empty. Duplicates are rows whose role and text
    came earlier in the order of turn (nulls first); equal rows stand together.
    """
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = F.col("text").rlike(rf"[^{SPACES}.!?][{SPACES}]*\z")
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    small = plain.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("key"), who.alias("who"), F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(FINE).alias("fault"))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "key").orderBy(F.asc_nulls_first("turn"))) > 1
    return small.select("conv_id", "turn", "role", "key", (4 * F.col("who") + F.when(again & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))).cast("int").alias("code"))


def first_path(codes: bytes, entry: int, leave: int | None) -> tuple[int, str] | None:
    """Cost and edits of the best path over all rows from state ``entry``.

    It ends in state ``leave`` right after the last row; with None, in a proper
    end, closing turns included. None when there is no such path.
    """
    n = len(codes)
    if leave is not None and leave != entry and (leave == 0 or n == 0 or leave == 1 and (entry != 0 or not any(c >> 2 == SYSTEM and c & 3 < BLANK for c in codes))):
        return None
    floor = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + (0, SPOILT, DELETE, DELETE)[codes[i] & 3]
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def search(i: int, state: int, budget: int) -> bool:
        if floor[i] > budget:
            return False
        if i == n and (state in (0, 3) if leave is None else state == leave):
            return True
        if failed.get((i, state), -1) >= budget:
            return False
        path.append("D")
        if i < n and search(i + 1, state, budget - DELETE):
            return True
        path[-1] = "I"
        if (i < n or leave is None) and search(i, NEXT[state], budget - INSERT):
            return True
        if i < n:
            who, fault = codes[i] >> 2, codes[i] & 3
            if fault < BLANK:
                kept = KEPT[who][state]
                path[-1] = "K"
                if kept is not None and search(i + 1, kept, budget - fault):
                    return True
                path[-1] = "R"
                if kept != NEXT[state] and search(i + 1, NEXT[state], budget - fault - RENAME):
                    return True
        path.pop()
        failed[i, state] = budget
        return False

    bound = floor[0]
    while not search(0, entry, bound):
        bound += 1
    return bound, "".join(path)


class Searches:
    """Results of ``first_path`` met before in this task; many conversations look alike."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, codes: bytes, entry: int, leave: int | None) -> tuple[int, str] | None:
        key = (codes, entry, leave)
        if key not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[key] = first_path(codes, entry, leave)
        return self.known[key]


class Product:
    """Best paths over a run of rows from every state to every state.

    ``rank`` orders the paths out of one state by their text. No path is the
    beginning of another, so the order survives whatever follows.
    """

    def __init__(self, cost: np.ndarray, rank: np.ndarray, text: list[list]):
        self.cost, self.rank, self.text = cost, rank, text

    @classmethod
    def of(cls, codes: bytes, search: Searches) -> Product:
        cost, rank = (np.full((STATES, STATES), _NONE) for _ in range(2))
        text: list[list] = [[None] * STATES for _ in range(STATES)]
        for g in range(STATES):
            found = {e: p for e in range(STATES) if (p := search(codes, g, e)) is not None}
            for k, e in enumerate(sorted(found, key=lambda e: found[e][1])):
                cost[g, e], rank[g, e], text[g][e] = found[e][0], k, found[e][1]
        return cls(cost, rank, text)

    def then(self, other: Product) -> Product:
        cost, rank = (np.full((STATES, STATES), _NONE) for _ in range(2))
        text: list[list] = [[None] * STATES for _ in range(STATES)]
        for g in range(STATES):
            via = {}
            for e in range(STATES):
                ways = [(self.cost[g, m] + other.cost[m, e], self.rank[g, m], m) for m in range(STATES) if self.text[g][m] is not None and other.text[m][e] is not None]
                if ways:
                    cost[g, e], _, via[e] = min(ways)
                    text[g][e] = (self.text[g][via[e]], other.text[via[e]][e])
            for k, e in enumerate(sorted(via, key=lambda e: (self.rank[g, via[e]], other.rank[via[e], e]))):
                rank[g, e] = k
        return Product(cost, rank, text)

    def written(self, g: int, e: int) -> str:
        """The text of a path; pieces are pairs of pairs."""
        out, todo = [], [self.text[g][e]]
        while todo:
            now = todo.pop()
            if isinstance(now, tuple):
                todo += [now[1], now[0]]
            else:
                out.append(now)
        return "".join(out)


def chosen(costs: list[np.ndarray], ranks: list[np.ndarray]) -> tuple[int, list[tuple[int, int]]]:
    """Total cost and (from, to) of each of the products that follow each other, closing included."""
    togo = [np.array([c for c, _ in CLOSING])]
    for cost in reversed(costs):
        togo.append((cost + togo[-1][None, :]).min(1))
    togo.reverse()
    state, picks = 0, []
    for cost, rank, after in zip(costs, ranks, togo[1:], strict=True):
        total = cost[state] + after
        to = min((int(rank[state, e]), e) for e in range(STATES) if total[e] == total.min() and cost[state, e] < _NONE)[1]
        picks.append((state, to))
        state = to
    return int(togo[0][0]), picks


class Run:
    """Rows of one conversation in order, and the counts of what they are."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.product = conv_id, bytearray(), None
        self.low = self.high = self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, code: int, search: Searches) -> None:
        if len(self.codes) == STRETCH:
            self.fold(search)
        self.codes.append(code)
        self.faults[code & 3] += 1
        who = code >> 2
        if self.first is None:
            self.first = who
        elif (self.last, who) not in LEGAL:
            self.illegal += 1
        self.last = who
        if turn is not None:
            self.turns += turn != self.high or self.low is None
            self.low = turn if self.low is None else self.low
            self.high = turn

    def fold(self, search: Searches) -> None:
        new = Product.of(bytes(self.codes), search)
        self.product = new if self.product is None else self.product.then(new)
        self.codes = bytearray()

    def row(self, whole: bool, seq: int, search: Searches) -> dict:
        out = {"conv_id": self.conv_id, "seq": None if whole else seq, "low": self.low, "high": self.high, "turns": self.turns, "blank": self.faults[BLANK],
               "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "first": self.first, "last": self.last,
               "cost": None, "audit": None, "costs": None, "ranks": None, "audits": None}
        if whole and self.product is None:
            out["cost"], out["audit"] = search(bytes(self.codes), 0, None)
            return out
        if self.codes:
            self.fold(search)
        p = self.product
        if whole:
            out["cost"], [(g, e)] = chosen([p.cost], [p.rank])
            out["audit"] = p.written(g, e) + CLOSING[e][1]
        else:
            out["costs"], out["ranks"] = p.cost.ravel().tolist(), p.rank.ravel().tolist()
            out["audits"] = [None if p.text[g][e] is None else p.written(g, e) for g in range(STATES) for e in range(STATES)]
        return out


_COUNTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")


def audits(small: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in ``small`` (see ``faults``).

    Rows of equal turn follow each other by role and text key. A conversation
    with a null id is one like the others. No rows give no row. ``gaps`` is null
    where the span of turns leaves 64 bits.
    """
    kind = small.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, seq long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, costs array<long>, ranks array<long>, audits array<string>"
    names = [x.split()[0] for x in fields.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, now, seq, out = Searches(), None, TaskContext.get().partitionId() * 2, []
        types = None

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types, strict=True))))

        for batch in batches:
            # ids that Arrow gives back as they came
            types = types or [batch.column(0).type, *[pa.int64()] * (len(_COUNTS) + 2), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            for conv_id, turn, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        # the first conversation of a partition may have begun in the one before
                        out.append(now.row(seq % 2 == 1, seq, search))
                        seq |= 1
                    now = Run(conv_id)
                now.add(turn, code, search)
            if len(out) > 2000:
                yield packed(out)
                out = []
        if now is not None:
            out.append(now.row(False, seq, search))
        if out:
            yield packed(out)

    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "key"]
    ranged = small.repartitionByRange(partitions(small), *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "code")
    found = stage(bounded_batches(ranged).mapInArrow(released(work), fields), "repair-runs")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        cost, picks = chosen(*([np.array(list(x), np.int64).reshape(STATES, STATES) for x in rows[c]] for c in ("costs", "ranks")))
        turns, illegal, high, last = 0, 0, None, None
        for r in rows.itertuples():
            turns += r.turns - (isinstance(r.low, str) and r.low == high)
            illegal += r.illegal + (last is not None and (last, r.first) not in LEGAL)
            high, last = r.high if isinstance(r.high, str) else high, r.last
        rows = rows.assign(place=[STATES * g + e + 1 for g, e in picks], all_cost=cost, all_turns=turns, all_illegal=illegal,
                           closing=[""] * (len(rows) - 1) + [CLOSING[picks[-1][1]][1]])
        return rows[["conv_id", "seq", "place", "all_cost", "all_turns", "all_illegal", "closing"]]

    # at most two rows a partition; their texts are joined back, so only the chosen ones move
    parts = found.filter("seq is not null")
    picked = parts.select("conv_id", "seq", "costs", "ranks", *(F.col(c).cast("string") if c in ("low", "high") else F.col(c) for c in _COUNTS)).groupBy("conv_id").applyInPandas(
        pick, f"conv_id {kind}, seq long, place int, all_cost long, all_turns long, all_illegal long, closing string")
    joined = parts.drop("cost", "audit").join(picked.drop("conv_id"), "seq")
    merged = joined.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.first("all_turns").alias("turns"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.first("all_illegal").alias("illegal"), F.first("all_cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.expr("element_at(audits, place)"), "closing").alias("t")))), lambda x: x["t"]), "").alias("audit"))
    every = found.filter("seq is null").select(*merged.columns).unionByName(merged)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.try_add(F.try_subtract("high", "low"), 1 - F.col("turns")))
    return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _replayed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one partition."""
    text = rows.select("conv_id", F.lit(1).alias("part"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = plans.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")).unionByName(text)
    keyed = both.withColumn("key", F.when(F.col("part") == 1, F.unhex(F.md5("text"))))
    return bounded_batches(keyed.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "key").select("conv_id", "part", "role", "text"))


def _turns(batches: Iterator[pa.RecordBatch], kind: list[pa.DataType]) -> Iterator[tuple]:
    """(conversation, position, role, text) of the repaired turns; position -1 announces a conversation, -2 ends it."""
    conv, audit, at, place, state = None, None, 0, 0, 0

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state, at, place = NEXT[state], at + 1, place + 1
            yield conv, place - 1, "user" if state == 2 else "assistant", ""

    for batch in batches:
        kind[:] = [batch.column(0).type]
        for conv_id, part, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part == 0:
                if audit is not None:
                    yield from inserted()
                    yield conv, -2, None, None
                conv, audit, at, place, state = conv_id, text, 0, 0, 0
                yield conv, -1, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = NEXT[state]
                role = "user" if state == 2 else "assistant"
            else:
                state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            yield conv, place, role, text
            place += 1
    if audit is not None:
        yield from inserted()
        yield conv, -2, None, None


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, position, role, text); a conversation without turns has no row.

    ``plans`` are the ``audits`` of these rows. A conversation's rows pass one
    task in order, as a stream: only its audit is held.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind[0], pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "position", "role", "text"])

        for r in _turns(batches, kind):
            if r[1] >= 0:
                held.append(r)
                size += len(r[3])
            if size > 1 << 20 or len(held) >= 10_000:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return _replayed(rows, plans).mapInArrow(released(work), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, role string, text string")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, n_repaired, repaired_sha256): turns and digest of each repaired conversation's ``role:text`` lines.

    One digest of a conversation takes its turns one after the other, so they pass one task, as a stream.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, kind, body, n = [], [], None, 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind[0], pa.int64(), pa.string()), strict=True)], names=["conv_id", "n_repaired", "repaired_sha256"])

        for conv, position, role, text in _turns(batches, kind):
            if position == -1:
                body, n = hashlib.sha256(), 0
            elif position >= 0:
                body.update((("\n" if position else "") + f"{role}:{text}").encode())
                n += 1
            else:
                done.append((conv, n, body.hexdigest()))
            if len(done) >= 10_000:
                yield packed()
                done = []
        if done:
            yield packed()

    return _replayed(rows, plans).mapInArrow(released(work), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_repaired long, repaired_sha256 string")
