"""Chat formatting in windows of a token budget.

Every turn is written between the marks of its role; control strings inside a
text get a backslash after their first character, one more if they have some, so
the text can be had back. Tokens are counted for each written turn where its row
lies. Then a conversation's turns pass one task in order, as a stream, and the
prefix sums of their tokens choose the windows:

* a window begins with the conversation's system turn, if it opens with one, and
  with the turns before it, as far back as ``history`` tokens reach;
* its new turns are the most whole turns that fit into what is left of ``budget``;
* the loss mask covers the texts of new assistant turns; repeated ones are masked.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.arrays import released, slices
from seriesloom.llm.library_tokens import worker_encoder
from seriesloom.llm.tables import bounded_batches, partitions

BUDGET = 1024
HISTORY = 256
# fixed values: the marks of the template
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
_AFTER = r"(\\*(?:</?SYS>>|</?ROLE>>|/?s>|/?INST\]))"
_ESCAPED = re.compile(r"([<\[])\\" + _AFTER)


def escaped(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    return F.regexp_replace(text, r"([<\[])" + _AFTER, r"$1\\$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def written(role: Column, text: Column) -> Column:
    """A turn between its marks; other roles stand on a line of their own, backslash and line end escaped."""
    name = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    out = F.concat(F.lit(OTHER[0]), escaped(name), F.lit("\n"), escaped(text), F.lit(OTHER[1]))
    for known, (a, b) in MARKS.items():
        out = F.when(role == known, F.concat(F.lit(a), escaped(text), F.lit(b))).otherwise(out)
    return out


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        role, (a, b) = next(((r, m) for r, m in (*MARKS.items(), (None, OTHER)) if formatted.startswith(m[0], at)))
        end = formatted.index(b, at + len(a))
        text = formatted[at + len(a) : end]
        if role is None:
            name, text = text.split("\n", 1)
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(name))
        out.append((role, unescaped(text)))
        at = end + len(b)
    return out


class Conversation:
    """Turns that arrive in order, given out as windows; holds one window and its history."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.turns: list[str] = []
        self.sums = [0]
        self.system: tuple[str, int] | None = None
        self.new = self.window = self.base = 0

    def add(self, turn: str, tokens: int) -> None:
        if not self.turns and not self.base and turn.startswith(MARKS["system"][0]) and 2 * tokens <= self.budget:
            self.system = turn, tokens
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def windows(self, last: bool) -> Iterator[dict]:
        """Windows that no further turn can change."""
        sums = self.sums
        while self.new < len(self.turns):
            new = self.new
            lead = self.system if self.window else None
            room = self.budget - (lead[1] if lead else 0)
            # the system turn is no history: it leads anyway
            least = 1 if lead and not self.base else 0
            start = min(new, max(least, bisect_left(sums, sums[new] - min(self.history, room))))
            end = bisect_right(sums, sums[start] + room) - 1
            if end <= new:
                # the next turn takes the room of the history, all of it if it must
                start, end = min(new, max(least, bisect_left(sums, sums[new + 1] - room))), new + 1
            if end >= len(self.turns) and not last:
                return
            yield self._window(lead, start, new, end)
            self.new, self.window = end, self.window + 1
        if last or self.new < 256:
            return
        drop = max(0, min(self.new, bisect_left(sums, sums[self.new] - self.history)) - 1)
        del self.turns[:drop], self.sums[:drop]
        self.new, self.base = self.new - drop, self.base + drop

    def _window(self, lead: tuple[str, int] | None, start: int, new: int, end: int) -> dict:
        pieces = [lead[0]] if lead else []
        pieces += self.turns[start:end]
        repeated = len(pieces) - (end - new)
        low, high, at = [], [], 0
        a, b = MARKS["assistant"]
        for i, piece in enumerate(pieces):
            if i >= repeated and piece.startswith(a):
                low.append(at + len(a))
                high.append(at + len(piece) - len(b))
            at += len(piece)
        tokens = self.sums[end] - self.sums[start] + (lead[1] if lead else 0)
        return {"conv_id": self.conv_id, "window": self.window, "n_repeated": repeated, "n_new": end - new, "formatted": "".join(pieces),
                "loss_start": low, "loss_stop": high, "n_tokens": tokens, "over": tokens > self.budget}


def counted(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, written, tokens): each turn in its marks, and its number of tokens."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), written(role, text).alias("written"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, "kept")
        for texts in slices(batches, "written"):
            _, at = encoder.encode(texts.data, texts.offsets)
            yield pa.RecordBatch.from_arrays([*texts.rows.columns, pa.array(at[1:] - at[:-1], pa.int64())], names=[*texts.rows.schema.names, "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return bounded_batches(rows).mapInArrow(released(work), f"{kinds}, tokens long")


def windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows of all conversations.

    Returns conv_id, window (from 0), n_repeated and n_new turns, formatted,
    loss_start and loss_stop (code point spans of ``formatted`` under the loss
    mask), n_tokens, over. Turns are never cut: one that is longer than the room
    has a window without history, marked ``over`` where it exceeds the budget. A
    system turn over half of the budget is not repeated. Rows are ordered by
    turn (null first), then role and text; repeated rows are turns like others.
    Null roles and texts are empty, a null conv_id is a conversation, other
    columns are ignored. Rows come partitioned by conversation, windows in order.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size, types = None, [], 0, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, types)

        for batch in batches:
            types = types or pa.schema([("conv_id", batch.column(0).type), ("window", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("formatted", pa.string()),
                                        ("loss_start", pa.list_(pa.int64())), ("loss_stop", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("over", pa.bool_())])
            for conv_id, turn, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    out += now.windows(True) if now else []
                    now = Conversation(conv_id, budget, history)
                now.add(turn, tokens)
                size += len(turn)
                if now.sums[-1] - now.sums[now.new] > budget:
                    out += now.windows(False)
                if size > 1 << 20:
                    if out:
                        yield packed()
                    out, size = [], 0
        if now:
            out += now.windows(True)
            yield packed()

    ordered = counted(conversations, tokenizer).repartition(partitions(conversations), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "written")
    return bounded_batches(ordered.select("conv_id", "written", "tokens")).mapInArrow(
        released(work), f"conv_id {kind}, window long, n_repeated long, n_new long, formatted string, loss_start array<long>, loss_stop array<long>, n_tokens long, over boolean")


def read_back(found: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, each turn once.

    (conv_id, n_turns, turns_sha256 of role, line end, text, line end; loss_chars
    and loss_sha256 of the unescaped text under the loss mask; formatted_chars,
    n_windows). ``found`` has a conversation's windows in order in one partition,
    as ``windows`` gives them.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, types, began = [], None, None, False
        turns = loss = None
        n = [0, 0, 0, 0]

        def packed() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def closed() -> tuple:
            return now, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]

        for batch in batches:
            types = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for conv_id, repeated, formatted, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or now != conv_id:
                    if began:
                        done.append(closed())
                    if len(done) >= 10_000:
                        yield packed()
                        done = []
                    began, now, turns, loss, n = True, conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                new = turns_of(formatted)[repeated:]
                for role, text in new:
                    turns.update(f"{role}\n{text}\n".encode())
                for a, b in zip(low, high, strict=True):
                    text = unescaped(formatted[a:b])
                    loss.update(text.encode())
                    n[1] += len(text)
                n[0], n[2], n[3] = n[0] + len(new), n[2] + len(formatted), n[3] + 1
        if began:
            done.append(closed())
            yield packed()

    return bounded_batches(found.select("conv_id", "n_repeated", "formatted", "loss_start", "loss_stop")).mapInArrow(
        released(work), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
