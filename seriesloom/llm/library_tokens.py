"""Ids of a tokenizer file through the tokenizers library, each distinct stretch of text encoded once per worker.

A worker process keeps one encoder and its bounded store from task to task, so
the file is parsed once and no second copy grows beside the first.
"""

from __future__ import annotations

import os
import sys
from itertools import chain
from types import ModuleType

import numpy as np

from seriesloom.llm.arrays import LOWER, SPACE, expand
from seriesloom.llm.pieces import PieceStore

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True
_MARK = _PRINTED & ~_LETTER
_MARK[ord("0") : ord("9") + 1] = _MARK[ord("'")] = False
# byte-level models write a byte as a character: printed Latin-1 as it is, the others as U+0100 onwards
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_KIND = (_LETTER + 2 * _MARK + 4 * SPACE).astype(np.uint8).tobytes()
_POINTS = np.arange(256, dtype="<u4")
_POINTS[_OTHERS] = 256 + np.arange(len(_OTHERS))
# parts words that travel together; none holds it
_POINTS[ord("\n")] = ord("\n")


class LibraryEncoder:
    """Encodes slices of texts with a tokenizer file.

    Texts are cut only where both kinds of file always split: between a letter
    of Latin-1 and an ASCII mark (not the apostrophe), and at white space. ``blank``
    says what happens to that. "dropped": stretches lie between ASCII white space,
    in lower case. "kept": a stretch starts at a blank between two printed
    characters of ASCII or U+00C0 to U+00FF. What follows a cut does not depend
    on what came before it.
    """

    CHUNK = 4096

    def __init__(self, path: str, blank: str):
        # a task has one core; more threads of the library would only hold more memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dropped = blank == "dropped"
        self.store = PieceStore(self._encode)

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
        letter, mark, high = (kind & 1).view(bool), kind & 2 != 0, data == 0xC3
        # U+00C0 to U+00FF are 0xC3 and one more byte; two of them are no letters
        pair = high.copy()
        pair[:-1] &= (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter |= pair
        letter[1:] |= pair[:-1]
        cut[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        if not self.dropped:
            printed = _PRINTED[data] | high
            printed[1:] |= high[:-1]
            cut[1 : max(n - 1, 1)] |= (data[1:-1] == 32) & printed[:-2] & printed[2:] if n > 2 else False
            cut[offsets] = True
            start = np.flatnonzero(cut[:-1])
            return start, np.append(start[1:], n)[: len(start)]
        cut[offsets] = True
        first = kind & 4 == 0
        last = first.copy()
        first[1:] &= cut[1:n] | ~last[:-1]
        last[:-1] &= cut[1:n] | (kind[1:] & 4 != 0)
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin-1 letters go straight to the file's model; for others the whole tokenizer runs."""
        word = self._words(pieces)
        plain, rest = np.flatnonzero(word), np.flatnonzero(~word)
        counts, flat = np.zeros(len(pieces), np.int64), []
        tokenize = self.tokenizer.model.tokenize
        for a in range(0, len(plain), self.CHUNK):
            some = plain[a : a + self.CHUNK]
            text = b"\n".join([pieces[i] for i in some.tolist()]).decode()
            shown = _POINTS[np.frombuffer((text.lower() if self.dropped else text).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            found = [[t.id for t in tokenize(x)] for x in shown]
            counts[some] = [len(x) for x in found]
            flat.append(np.fromiter(chain.from_iterable(found), np.int32, int(counts[some].sum())))
        for a in range(0, len(rest), self.CHUNK):
            where = rest[a : a + self.CHUNK]
            some = [pieces[i].decode() for i in where.tolist()]
            if not self.dropped:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                counts[where] = [len(x) for x in found]
                flat.append(np.fromiter(chain.from_iterable(found), np.int32, int(counts[where].sum())))
            else:
                found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                of = np.searchsorted(np.cumsum([len(p) + 1 for p in some]), np.array([x for x, _ in found.offsets], np.int64), "right")
                counts[where] = np.bincount(of, minlength=len(some))
                flat.append(np.array(found.ids, np.int32))
        ids = np.concatenate(flat) if flat else np.empty(0, np.int32)
        if len(plain) and len(rest):
            made = np.append(plain, rest)
            begin = np.empty(len(pieces), np.int64)
            begin[made] = np.cumsum(counts[made]) - counts[made]
            ids = ids[expand(begin, counts)]
        return ids, counts

    def _words(self, pieces: list[bytes]) -> np.ndarray:
        """Which pieces are words of Latin-1 letters (kept blanks: after one blank or none)."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        starts = np.append(0, ends)[:-1]
        after = np.append(data, np.uint8(0))[1:]
        # the first byte of a letter decides
        fits = _LETTER[data] | (data & 0xC0 == 0x80) | (data == 0xC3) & (after != 0x97) & (after != 0xB7) | (data == 0xC2) & ((after == 0xAA) | (after == 0xB5) | (after == 0xBA))
        if not self.dropped:
            longer = starts[ends - starts > 1]
            fits[longer] |= data[longer] == 32
        bad = np.append(0, np.cumsum(~fits))
        return (bad[ends] == bad[starts]) & (ends > starts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offset of each text among them."""
        if self.dropped:
            data = np.frombuffer(data.tobytes().translate(LOWER.tobytes()), np.uint8)
        start, end = self.stretches(data, offsets)
        ids, counts = self.store.ids(data, start, end)
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(start, offsets, "left")]


def worker_encoder(path: str, blank: str) -> LibraryEncoder:
    """The encoder of this worker process; another file or kind replaces it.

    Task code comes anew with every task, so the process holds the encoder in a
    module made here, not in one of this package (which workers need not have).
    """
    held = sys.modules.setdefault("_worker_encoder", ModuleType("_worker_encoder"))
    if getattr(held, "key", None) != (path, blank):
        held.encoder, held.key = LibraryEncoder(path, blank), (path, blank)
    return held.encoder
