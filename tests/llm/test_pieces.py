"""Encoded pieces of text: exact whatever their hashes do, and equal to the whole tokenizer."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesloom.llm import pieces
from seriesloom.llm.library_tokens import LibraryEncoder
from seriesloom.llm.pieces import PieceStore


def spans(parts):
    length = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(length)
    return np.frombuffer(b"".join(parts), np.uint8), end - length, end


def as_bytes(some):
    """A piece's own bytes as its ids."""
    return np.frombuffer(b"".join(some), np.uint8).astype(np.int64), np.array([len(p) for p in some], np.int64)


SLICES = [
    [b"one", b"two", b"one", b"x" * 64, b"y" * 65, b"x" * 64, b"one" * 40, b"\0", b"\0\0", b"two"],
    [b"two", b"three", b"z" * 65, b"y" * 65, b"one" * 40, b"", b"eightyes", b"eightyes\0", b"x" * 63 + b"y"],
    [b"a%d" % i for i in range(500)] + [b"long piece %d " % i * 9 for i in range(50)],
    [],
]


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("limit", [300_000, 3])
def test_store_is_exact(monkeypatch, collide, limit):
    if collide:
        monkeypatch.setattr(pieces, "mix", lambda x: x * np.uint64(0))
    monkeypatch.setattr(PieceStore, "LIMIT", limit)
    asked = []
    store = PieceStore(lambda some: (asked.extend(some), as_bytes(some))[1])
    for parts in SLICES * 2:
        ids, counts = store.ids(*spans(parts))
        assert counts.tolist() == [len(p) for p in parts] and ids.astype(np.uint8).tobytes() == b"".join(parts)
    if not collide and limit > 1000:
        assert len(asked) == len(set(asked)) == len({p for parts in SLICES for p in parts})


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(PieceStore, "BODY_BYTES", 1000)
    store = PieceStore(as_bytes)
    for i in range(50):
        store.ids(*spans([b"%d" % i * 100]))
    assert len(store.body) < 2000


WORDS = ["word", "Größe", "ÀÉÎ", "ªµº", "a×b", "a÷b", "ÿ", "Ÿ", "šč", "don't", "x1", "Σίσυφος", "漢字", "é", "…", "Ǆ", "İ", "ß", "<|endoftext|>", "c-d"]


@pytest.mark.parametrize("name, blank", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_pieces_equal_the_tokenizer(name, blank):
    encoder = LibraryEncoder(public_tokenizers.path(name), blank)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    given = WORDS if blank == "dropped" else [*WORDS, *(" " + w for w in WORDS), " ", "\n", " \n x", "  two"]
    given = [w.encode() for w in given]
    for some in (given, given[:1], [w for w in given if w.isalpha()], [w for w in given if not w.isalpha()], []):
        ids, counts = encoder._encode(some)
        parts = np.split(ids, np.cumsum(counts)[:-1]) if some else []
        assert [p.tolist() for p in parts] == [library.encode(w.decode(), add_special_tokens=False).ids for w in some]
    texts = [" ".join(WORDS), "", "A", " ", "Größe,Über;x'y\tz\nÀ-é \x0b", "a  b"]
    data, start, _ = spans([t.encode() for t in texts])
    ids, at = encoder.encode(data, np.append(start, len(data)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
