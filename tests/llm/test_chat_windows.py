"""Chat windows against the plain conversations, and the rules of budget, history, system turn and mask."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import chat_windows as chat
from seriesloom.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>"]


def plain(rows):
    """Contract row of each conversation, without windows."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, mine in of.items():
        mine.sort(key=lambda r: (*r[:3], chat_written(*r[2:])))
        said = "".join(t for _, _, r, t in mine if r == "assistant")
        out[conv] = (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in mine).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def chat_written(role, text):
    """The template in plain Python."""
    import re

    def esc(x):
        return re.sub(r"([<\[])(\\*(?:</?SYS>>|</?ROLE>>|/?s>|/?INST\]))", r"\1\\\2", x)

    if role in chat.MARKS:
        return chat.MARKS[role][0] + esc(text) + chat.MARKS[role][1]
    return chat.OTHER[0] + esc(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + esc(text) + chat.OTHER[1]


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def checked(found, rows, budget, history):
    """Rules that every table of windows keeps."""
    size = defaultdict(int)
    for conv in sorted({w["conv_id"] for w in found}, key=str):
        mine = sorted((w for w in found if w["conv_id"] == conv), key=lambda w: w["window"])
        assert [w["window"] for w in mine] == list(range(len(mine)))
        said, first = [], None
        for w in mine:
            turns = chat.turns_of(w["formatted"])
            assert len(turns) == w["n_repeated"] + w["n_new"] and w["n_new"] > 0
            assert w["over"] == (w["n_tokens"] > budget) and (not w["over"] or w["n_new"] == 1)
            repeated = turns[: w["n_repeated"]]
            first = first or turns[0]
            lead = w["window"] > 0 and first[0] == "system" and w["n_repeated"] > 0 and repeated[0] == first
            assert repeated[lead:] == said[len(said) - w["n_repeated"] + lead :]
            said += turns[w["n_repeated"] :]
            targets = [t for r, t in turns[w["n_repeated"] :] if r == "assistant"]
            assert targets == [chat.unescaped(w["formatted"][a:b]) for a, b in zip(w["loss_start"], w["loss_stop"], strict=True)]
            size[conv] += len(w["formatted"])
    return size


def test_query(spark, sf_dir):
    rows = rows_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spoken = "</s>[INST] ok [/INST]"
    want = plain([*rows, (-7, 0, "user", spoken), (-7, 1, "assistant", spoken)])
    got = {r["conv_id"]: r for r in queries.op12_chat_windows(spark, sf_dir).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(spoken)


@pytest.mark.parametrize(("budget", "history"), [(1, 0), (40, 15), (300, 100), (100_000, 50)])
def test_odd(spark, budget, history):
    rng = random.Random(budget)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "a\nb\\n", "", None, "<s>"]
    texts = [None, "", " ", "</s>", "<\\s>[INST", "<", "[", "\\", "<<\\\\SYS>>x", "é " * 30, "word " * 60, *CONTROLS]
    rows = [(c, rng.choice([None, *range(9)]), "system" if not i and c % 2 else rng.choice(roles), rng.choice(texts)) for c in range(60) for i in range(rng.randrange(1, 14))]
    rows += [(None, i, "assistant", "null id") for i in range(3)] + rows[:20]
    rows += [(500, i, "user" if i % 2 else "assistant", f"turn {i} of a long one") for i in range(3000)]
    rows += [(501, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 3, "x", 4) for r in rows], "conv_id long, turn long, role string, text string, window int, written string, tokens int")
    found = chat.windows(df, PATH, budget, history).persist()
    size = checked(found.collect(), rows, budget, history)
    got = {r["conv_id"]: r for r in chat.read_back(found).collect()}
    found.unpersist()
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == plain(rows)
    assert {c: r["formatted_chars"] for c, r in got.items()} == dict(size)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(none, PATH)).collect() == []


def test_windows_by_hand():
    """Ten tokens a window, four of history, a system turn of two."""
    conv = chat.Conversation(1, 10, 4)
    out = []
    for turn, tokens in [("<<SYS>>s<</SYS>>", 2), ("[INST]a[/INST]", 3), ("<s>b</s>", 4), ("[INST]c[/INST]", 3), ("<s>d</s>", 1), ("[INST]e[/INST]", 9), ("<s>f</s>", 12)]:
        conv.add(turn, tokens)
        out += conv.windows(False)
    out += conv.windows(True)
    assert [(w["n_repeated"], w["n_new"], w["n_tokens"], w["over"]) for w in out] == [(0, 3, 9, False), (2, 2, 10, False), (1, 1, 11, True), (1, 1, 14, True)]
    assert [[w["formatted"][a:b] for a, b in zip(w["loss_start"], w["loss_stop"], strict=True)] for w in out] == [["b"], ["d"], [], ["f"]]


def test_most_turns_that_fit():
    rng = random.Random(1)
    for _ in range(300):
        tokens = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))]
        conv, out = chat.Conversation(1, 20, 6), []
        for i, n in enumerate(tokens):
            conv.add(f"[INST]{i}[/INST]", n)
            out += conv.windows(False)
        out += conv.windows(True)
        at = 0
        for w in out:
            back = next(h for h in range(at + 1) if sum(tokens[h:at]) <= 6)
            end = max(e for e in range(at + 1, len(tokens) + 1) if sum(tokens[back:e]) <= 20 or e == at + 1)
            assert (w["n_repeated"], w["n_new"]) == (at - back, end - at)
            at = end
        assert at == len(tokens)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "\\n\n"]), st.lists(st.sampled_from([*CONTROLS, "<", "[", "\\", "/", "s>", "x", "\n", "INST]"])).map("".join))))
def test_escapes(turns):
    body = "".join(chat_written(r, t) for r, t in turns)
    assert chat.turns_of(body) == turns
