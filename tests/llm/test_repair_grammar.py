"""The grammar of token shards: exact expansion, random access, and no pair left that occurs twice."""

from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import token_files


def left_over(symbols, starts):
    """Most occurrences of a pair without overlap, inside documents."""
    most = Counter()
    edge = set(starts.tolist())
    last = {}
    for i in range(len(symbols) - 1):
        if i + 1 in edge:
            continue
        pair = (int(symbols[i]), int(symbols[i + 1]))
        if last.get(pair, -2) < i - 1:
            most[pair] += 1
            last[pair] = i
    return max(most.values(), default=0)


CASES = {
    "copies": (np.tile(np.r_[np.arange(2, 257), 1], 400), np.arange(400) * 256),
    "one symbol": (np.full(1000, 5), np.array([0, 7, 400])),
    "two symbols": (np.random.default_rng(1).integers(0, 2, 5000), np.array([0, 1, 2, 2500])),
    "many symbols": (np.random.default_rng(2).zipf(1.3, 20_000) % 5000, np.arange(0, 20_000, 50)),
    "nothing": (np.empty(0, np.int64), np.empty(0, np.int64)),
    "single": (np.array([3]), np.array([0])),
}


@pytest.mark.parametrize("name", CASES)
def test_compress(name):
    ids, starts = CASES[name]
    symbols, at, rules, lengths, base = token_files.compress(ids, starts)
    assert (token_files.expand_symbols(symbols, rules, lengths, base) == ids).all()
    ends, until = np.append(starts, len(ids))[1:], np.append(at, len(symbols))[1:]
    for a, b, c, d in zip(starts, ends, at, until, strict=True):
        assert (token_files.expand_symbols(symbols[c:d], rules, lengths, base) == ids[a:b]).all()
    assert left_over(symbols, at) < 2
    for (left, right), size in zip(rules, lengths, strict=True):
        assert size == sum(1 if s < base else lengths[s - base] for s in (left, right))


def test_copies_shrink_to_a_symbol_each():
    symbols, _, rules, _, _ = token_files.compress(*CASES["copies"])
    assert len(symbols) == 400 and len(rules) == 255


def test_random_access():
    ids, starts = CASES["many symbols"]
    counts = np.diff(np.append(starts, len(ids)))
    shard = token_files.Shard(token_files.to_bytes(list(range(len(starts))), counts, ids))
    rng = np.random.default_rng(3)
    for i in rng.integers(0, len(starts), 200):
        a, b = sorted(rng.integers(0, counts[i] + 1, 2))
        assert (shard.document(int(i), int(a), int(b)) == ids[starts[i] + a : starts[i] + b]).all()


def test_rounds_cost_their_places(monkeypatch):
    """A few places that need many rounds among single pairs: the shard is not looked through in each of them."""
    class Counted:
        seen = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def flatnonzero(self, x):
            Counted.seen += len(x)
            return np.flatnonzero(x)

    once = np.random.default_rng(4).permutation(50_000) + 1000
    threes = np.stack([np.arange(500) + 100_000] * 3 + [np.arange(500) + 200_000], 1).ravel()
    nested = np.concatenate([np.r_[np.full(k, 2), k + 300_000] for k in range(2, 60)])
    ids = np.concatenate([once, threes, nested])
    starts = np.array([0, len(once), len(once) + len(threes)])
    monkeypatch.setattr(token_files, "np", Counted())
    symbols, at, rules, lengths, base = token_files.compress(ids, starts)
    assert Counted.seen < 15 * len(ids)
    assert (token_files.expand_symbols(symbols, rules, lengths, base) == ids).all() and left_over(symbols, at) < 2
