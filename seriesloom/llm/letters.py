"""Letter words of text slices and their counts per language."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.arrays import Powers, SpanHash, Texts, released, runs, seeded, slices
from seriesloom.llm.tables import bounded_batches

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[128:] = True
FLUSH = 200_000
_BYTES = seeded(256, 31)


def letter_words(texts: Texts, powers: Powers) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and word number of each letter word, and the distinct words in lower case.

    A word is a run of ASCII letters and characters beyond ASCII that holds a letter.
    """
    start, end, row = runs(LETTER[texts.data], texts.offsets)
    codes, _ = pd.factorize(SpanHash(_BYTES, powers, texts.data)(start, end))
    first = np.zeros(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    body = texts.data.tobytes()
    found = [body[a:b].decode().lower() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    if not body.isascii():
        keep = np.array([w.isascii() or any(c.isalpha() for c in w) for w in found], bool)
        if not keep.all():
            has = keep[codes]
            renumber = np.cumsum(keep) - 1
            row, codes, found = row[has], renumber[codes[has]], [w for w, k in zip(found, keep, strict=True) if k]
    return row, codes, found


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows with a language; tasks add up before the shuffle."""

    def rows(held: dict) -> pa.RecordBatch:
        flat = [(lang, w, n) for lang, words in held.items() for w, n in words.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), defaultdict(Counter)
        for texts in slices(batches):
            row, codes, found = letter_words(texts, powers)
            langs = texts.rows.column(texts.rows.schema.get_field_index("lang")).to_pylist()
            names = sorted({x for x in langs if x is not None})
            where = np.array([names.index(x) if x is not None else -1 for x in langs], np.int64)[row]
            for i, name in enumerate(names):
                n = np.bincount(codes[where == i], minlength=len(found))
                has = np.flatnonzero(n)
                for j, k in zip(has.tolist(), n[has].tolist(), strict=True):
                    held[name][found[j]] += k
            if sum(map(len, held.values())) > FLUSH:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    with_lang = docs.filter("lang is not null").select(F.col("lang").cast(T.StringType()), "text")
    return bounded_batches(with_lang).mapInArrow(released(work), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
