"""Conversation repair against a shortest-path search over whole conversations that knows nothing of stretches."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seriesloom.llm import conversation_repair as repair
from seriesloom.llm import queries

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))


def brute_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = NOT_SPACE.findall(text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif solid[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def cheapest(initials, kinds):
    """(cost, audit) by Dijkstra over (cost, audit text); grammar states 0, s, u, a."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(initials) and state in ("", "a"):
            return cost, audit
        for turn in "ua":
            if (state, turn) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, turn))
                if i < len(initials) and kinds[i] not in ("blank", "duplicate") and initials[i] != turn:
                    heapq.heappush(heap, (cost + 2 + (kinds[i] == "truncated"), audit + "R", i + 1, turn))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if kinds[i] not in ("blank", "duplicate") and (state, initials[i]) in step:
                heapq.heappush(heap, (cost + (kinds[i] == "truncated"), audit + "K", i + 1, initials[i]))
    raise AssertionError


def brute(rows):
    """The contract's row of each conversation, from undamaged rows."""
    of = defaultdict(list)
    for r in brute_damage(rows):
        of[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = in_order(of[conv])
        kinds = brute_faults(mine)
        first = [r[2][:1] for r in mine]
        turns = {r[1] for r in mine} - {None}
        cost, audit = cheapest(first, kinds)
        lines, i, state = [], 0, ""
        for edit in audit:
            turn = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[turn]
            if edit == "I":
                lines.append(f"{role}:")
                state = turn
                continue
            if edit == "K":
                role, turn = mine[i][2], mine[i][2][0]
            if edit != "D":
                lines.append(f"{role}:{mine[i][3]}")
                state = turn
            i += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def query(spark, folder):
    return {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in queries.op11_conversation_repair(spark, str(folder)).collect()}


def test_paths():
    rng = random.Random(3)
    for _ in range(1500):
        codes = bytes(rng.choice([0, 4, 8, 4, 8, 5, 9, 6, 11, 12, 1]) for _ in range(rng.randrange(0, 9)))
        initials = ["suax"[c >> 2] for c in codes]
        kinds = [("", "truncated", "blank", "duplicate")[c & 3] for c in codes]
        assert repair.first_path(codes, 0, None) == cheapest(initials, kinds)


@pytest.mark.parametrize("stretch", [1, 3, 7])
def test_products(stretch):
    """Stretches multiplied in any grouping give the path of the whole."""
    rng = random.Random(stretch)
    search = repair.Searches()
    for _ in range(400):
        codes = bytes(rng.choice([0, 4, 8, 4, 8, 5, 9, 6, 11, 12]) for _ in range(rng.randrange(1, 12)))
        parts = [repair.Product.of(codes[i : i + stretch], search) for i in range(0, len(codes), stretch)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1])]
        cost, [(g, e)] = repair.chosen([parts[0].cost], [parts[0].rank])
        assert (cost, parts[0].written(g, e) + repair.CLOSING[e][1]) == repair.first_path(codes, 0, None)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query(spark, sf_dir) == brute(rows)


def test_odd_rows(spark, tmp_path):
    """Nulls, ties, repeats, odd roles, blanks, one very long conversation, one long text, clashing columns."""
    rng = random.Random(9)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Yes.", "no", "", " \n", "Why?", None, "a.  ", "é!", "x. y"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(99)}.") for c in range(150) for _ in range(rng.randrange(0, 12))]
    rows += [(None, i, rng.choice(roles), f"n{i}.") for i in range(10)]
    rows += [(900, i // 2, "user" if i % 2 else "assistant", f"long {i}" + "." * (i % 3 > 0)) for i in range(1500)]
    rows += [(901, 1, "user", "spread " * 200_000 + "."), (902, None, None, None)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "conv_id long, turn long, role string, text string, audit int, key string, part int")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert query(spark, tmp_path) == brute(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert query(spark, tmp_path) == {}


def test_repaired_turns(spark, sf_dir):
    rows = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans = repair.audits(repair.faults(rows))
    lines = defaultdict(list)
    for r in repair.repaired(rows, plans).orderBy("conv_id", "position").collect():
        assert r["position"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    found = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(rows, plans).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: h for c, h in found.items() if h != none}
    assert np.sum([h == none for h in found.values()]) < 3
