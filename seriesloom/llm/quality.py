"""Quality rules: how far a document's histograms are from those of the languages.

Two histograms describe a document: character classes, and the most common
words of a language with everything else in one bin. Each is compared with
every language's reference by Jensen-Shannon distance; the nearest language
counts. Documents under the minimum lengths are not judged by a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.arrays import SPACE, Powers, SpanHash, Texts, mix, released, runs, seeded, slices
from seriesloom.llm.letters import letter_words, word_counts
from seriesloom.llm.tables import bounded_batches
from seriesloom.staging import stage

COMMON_WORDS = 50
MIN_CHARS = 200
MIN_WORDS = 50
# from the labelled documents of sf0.1 that pass the base rules: these keep 99.7 % of the
# good ones (one of them is farther than 0.30, none has words farther than 0.41) and 3 % of the bad ones
MAX_CHAR_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.41
# fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20

CLASSES = 10
_CLASS = np.full(256, 4, np.uint8)  # other printable ASCII
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[SPACE] = 3
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[128:192] = 255  # continuation bytes belong to the character before
_CLASS[192:] = 6
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 7
_CLASS[list(b"|\t")] = 8  # columns of tables and word lists
_CLASS[list(b"\n\r")] = 9
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BYTES = seeded(256, 41)
_PLACE = seeded(WINDOW, 42) | np.uint64(1)
_ROW = np.uint64(0xA24BAED4963EE407)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of times each value occurs in its row."""
    codes, _ = pd.factorize(mix(values + rows.astype(np.uint64) * _ROW))
    return np.bincount(codes)[codes] if len(codes) else codes


def base_counts(texts: Texts, powers: Powers) -> dict[str, np.ndarray]:
    """Counts behind the base rules, for every row."""
    n = len(texts)
    space = SPACE[texts.data]
    lead = (texts.data & 0xC0) != 0x80
    span = SpanHash(_BYTES, powers, texts.data)
    start, end, row = runs(~space, texts.offsets)
    word = span(start, end)
    full = np.flatnonzero(row[: max(len(row) - WINDOW + 1, 0)] == row[WINDOW - 1 :]) if len(row) >= WINDOW else np.empty(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for j in range(WINDOW):
        value += word[full + j] * _PLACE[j]
    often = full[_again(mix(value), row[full]) >= 2]
    step = np.zeros(len(row) + 1, np.int64)
    np.add.at(step, often, 1)
    np.add.at(step, often + WINDOW, -1)
    repeated = np.cumsum(step[:-1]) > 0
    at, to, line_row = runs(texts.data != 10, texts.offsets)
    has_word = np.searchsorted(start, to, "left") > np.searchsorted(end, at, "right")
    at, to, line_row = at[has_word], to[has_word], line_row[has_word]
    key = mix(span(at, to) + line_row.astype(np.uint64) * _ROW)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": _per_row(lead & ~space, texts.offsets),
        "n_symbols": _per_row(_SYMBOL[texts.data], texts.offsets),
        "n_dup_lines": np.bincount(line_row[~first], minlength=n),
        "n_repeat_words": np.bincount(row[repeated], minlength=n),
    }


def class_histogram(texts: Texts) -> np.ndarray:
    """Characters of each class, a row per text."""
    row = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    kind = _CLASS[texts.data]
    own = kind != 255
    return np.bincount(row[own] * CLASSES + kind[own], minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts ``p`` and the counts ``q``."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def references(docs: DataFrame, common: int = COMMON_WORDS) -> tuple[dict[str, np.ndarray], dict[str, dict[str, int]]]:
    """Character-class counts and common-word counts of every language over all labelled rows.

    Counts are added up on the cluster; the driver gets a row a language and ``common`` words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for texts in slices(batches):
            frame = pd.DataFrame(class_histogram(texts)).groupby(np.array(texts.rows.column(0).to_pylist(), object)).sum()
            for lang, counts in zip(frame.index, frame.to_numpy(), strict=True):
                held[lang] = held.get(lang, 0) + counts
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([int(c[i]) for c in held.values()], pa.int64()) for i in range(CLASSES))],
                                         names=["lang", *(f"c{i}" for i in range(CLASSES))])

    labelled = docs.filter("lang is not null").select(F.col("lang").cast("string"), "text")
    fields = ", ".join(f"c{i} long" for i in range(CLASSES))
    chars = bounded_batches(labelled).mapInArrow(released(work), f"lang string, {fields}").groupBy("lang").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(CLASSES)))
    counts = stage(word_counts(labelled), "quality-words")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("r", rank).filter(F.col("r") <= common)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known: dict[str, dict[str, int]] = {}
    for r in top.join(total, "lang").select("lang", "word", "n", "total").collect():
        words = known.setdefault(r["lang"], {"": r["total"]})
        words[r["word"]] = r["n"]
        words[""] -= r["n"]
    return {r["lang"]: np.array(r[1:], np.int64) for r in chars.collect()}, known


def judge(docs: DataFrame, refs: tuple[dict[str, np.ndarray], dict[str, dict[str, int]]]) -> DataFrame:
    """``docs`` with the base counts, both distances, base_failed and kept.

    Null and empty texts have no words and fail the base rules. A distance is 0
    for a document under its minimum length and when there is no reference.
    Other columns of ``docs`` are kept; columns with the added names are replaced.
    """
    added = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
             "char_distance": "double", "word_distance": "double", "base_failed": "boolean", "kept": "boolean"}
    rest = docs.drop(*added)
    chars, common = refs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        tables = []
        for words in common.values():
            place = {w: i + 1 for i, w in enumerate(w for w in words if w)}
            tables.append((place, np.array([words[""], *(words[w] for w in place)], np.float64)))
        for texts in slices(batches):
            out = base_counts(texts, powers)
            n = out["n_words"]
            hist = class_histogram(texts)
            near = np.min([distance(hist, q) for q in chars.values()], 0) if chars else np.zeros(len(texts))
            out["char_distance"] = np.where(hist.sum(1) >= MIN_CHARS, near, 0.0)
            row, codes, found = letter_words(texts, powers)
            each = []
            for place, q in tables:
                bins = np.array([place.get(w, 0) for w in found], np.int64)[codes] if len(found) else codes
                p = np.bincount(row * len(q) + bins, minlength=len(texts) * len(q)).reshape(len(texts), len(q))
                each.append(distance(p, q))
            near = np.min(each, 0) if each else np.zeros(len(texts))
            out["word_distance"] = np.where(np.bincount(row, minlength=len(texts)) >= MIN_WORDS, near, 0.0)
            out["base_failed"] = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > 30 * n)
            out["kept"] = ~out["base_failed"] & (out["char_distance"] <= MAX_CHAR_DISTANCE) & (out["word_distance"] <= MAX_WORD_DISTANCE)
            yield pa.RecordBatch.from_arrays([*texts.rows.columns, *(pa.array(out[k]) for k in added)], names=[*texts.rows.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return bounded_batches(rest).mapInArrow(released(work), f"{fields}, " + ", ".join(f"{k} {v}" for k, v in added.items()))
