"""Language identification by known words, backing off to character n-grams.

A known word scores by its log frequency in each language. A word that no
language knows scores by its character n-grams: each position uses the longest
n-gram (down to one character) that some language has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.arrays import Powers, released, slices
from seriesloom.llm.letters import FLUSH, letter_words, word_counts
from seriesloom.llm.tables import bounded_batches
from seriesloom.staging import stage

KNOWN_WORDS = 20_000
LONGEST = 4
# held-out documents have 0.63 or more (4,000 of sf0.1; 0.75 on sf0.01), sentences in other languages 0.1 or less
LEAST_LIKENESS = 0.25
UNKNOWN = "und"


class Model:
    """Log frequencies of words and n-grams: rows of one matrix, a column per language."""

    def __init__(self, counts: dict[str, dict[str, int]], totals: dict[str, int]):
        self.langs = sorted(counts)
        blocks: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.words = self._rows([counts[x] for x in self.langs], [totals[x] for x in self.langs], blocks, 1)
        self.grams = []
        for n in range(1, LONGEST + 1):
            seen = []
            for lang in self.langs:
                c: Counter = Counter()
                for word, k in counts[lang].items():
                    padded = f"^{word}$"
                    for i in range(len(padded) - n + 1):
                        c[padded[i : i + n]] += k
                seen.append(c)
            self.grams.append(self._rows(seen, [sum(c.values()) for c in seen], blocks, LONGEST))
        self.matrix = np.concatenate([*blocks, np.zeros((1, len(self.langs)))])
        self.seen = np.concatenate(self.seen)

    def _rows(self, counts: list, totals: list[int], blocks: list[np.ndarray], weight: int) -> dict[str, int]:
        keys = sorted(set().union(*counts)) if counts else []
        first = sum(map(len, blocks))
        table = np.array([[c.get(k, 0) + 0.5 for c in counts] for k in keys], np.float64).reshape(len(keys), len(counts))
        self.seen.append(table > 0.5)
        blocks.append((np.log(table) - np.log([t + len(keys) + 1 for t in totals])) / weight)
        return {k: first + i for i, k in enumerate(keys)}

    def rows(self, word: str) -> list[int]:
        """Rows whose sum is the score of a word; the last row of the matrix is zero."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        padded, out = f"^{word}$", []
        longest, *shorter = reversed(self.grams)
        for i in range(len(padded)):
            found = longest.get(padded[i : i + LONGEST]) if i + LONGEST <= len(padded) else None
            if found is None:
                for n, table in zip(range(LONGEST - 1, 0, -1), shorter, strict=True):
                    found = table.get(padded[i : i + n]) if i + n <= len(padded) else None
                    if found is not None:
                        break
                else:
                    continue
            out.append(found)
        return out or [len(self.matrix) - 1]

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        rows = [self.rows(w) for w in words]
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(counts.sum()))
        return np.add.reduceat(self.matrix[flat], np.cumsum(counts) - counts)

    def likeness(self, words: list[str]) -> np.ndarray:
        """Share of each word that each language has: all or none of a known word, else its longest n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        for i, word in enumerate(words):
            known = self.words.get(word)
            if known is not None:
                out[i] = self.seen[known]
                continue
            padded = f"^{word}$"
            n = min(LONGEST, len(padded))
            found = [self.grams[n - 1].get(padded[j : j + n]) for j in range(len(padded) - n + 1)]
            has = [x for x in found if x is not None]
            if has:
                out[i] = self.seen[has].sum(0) / len(found)
        return out


def fit(labelled: DataFrame, known_words: int = KNOWN_WORDS) -> Model:
    """Count words of all labelled rows on the cluster; at most ``known_words`` a language come to the driver."""
    counts = stage(word_counts(labelled), "language-words")
    down = W.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    cut = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).withColumn(
        "upto", F.sum("words").over(down)).groupBy("lang").agg(
        F.coalesce(F.min(F.when(F.col("upto") <= known_words, F.col("n"))), F.max("n")).alias("least"), F.sum("tokens").alias("tokens"))
    kept: dict[str, dict[str, int]] = {}
    totals: dict[str, int] = {}
    for r in counts.join(cut, "lang").filter("n >= least").toLocalIterator():
        kept.setdefault(r["lang"], {})[r["word"]] = r["n"]
        totals[r["lang"]] = r["tokens"]
    return Model(kept, totals)


def predict(docs: DataFrame, model: Model, likeness: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (share of the best language, 0 to 1).

    Texts that are null or hold no letter get ``und`` and 0, as does everything
    when no labelled row was there to learn from. Equal scores go to the
    alphabetically first language. Only the text is an input; other columns are
    kept (columns named lang_pred or score are replaced).

    The score compares the learned languages with each other and is no evidence
    that a text is in one of them. With ``likeness`` a column says so: the mean
    share of a word that the predicted language has (``Model.likeness``), 0 to 1;
    0 for ``und``.
    """
    added = ["lang_pred", "score", *(["likeness"] if likeness else [])]
    kept = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # plain values are shared, and the class comes with the task: workers need no installed copy
        model, powers = Model.__new__(Model), Powers()
        vars(model).update(shared.value)
        width = len(model.langs)
        number, table = {}, np.zeros((0, width * (1 + likeness)))
        for texts in slices(batches):
            row, codes, found = letter_words(texts, powers)
            n = np.bincount(row, minlength=len(texts))
            names, best, like = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            if model.langs and len(found):
                if len(number) > FLUSH:
                    number, table = {}, table[:0]
                new = [w for w in found if w not in number]
                number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                table = np.concatenate([table, np.concatenate([model.scores(new), model.likeness(new)], 1) if likeness else model.scores(new)])
                mine = table[[number[w] for w in found]]
                total = np.stack([np.bincount(row, mine[codes, i], len(texts)) for i in range(width)], 1)
                total = total / np.sqrt(np.maximum(n, 1))[:, None]
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                names[n > 0] = np.array(model.langs, object)[total.argmax(1)][n > 0]
                best[n > 0] = share.max(1)[n > 0]
                if likeness:
                    like = np.bincount(row, mine[codes, width + total.argmax(1)[row]], len(texts)) / np.maximum(n, 1)
            results = [pa.array(names.tolist(), pa.string()), pa.array(best, pa.float64()), pa.array(like, pa.float64())]
            yield pa.RecordBatch.from_arrays([*texts.rows.columns, *results[: len(added)]], names=[*texts.rows.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return bounded_batches(kept).mapInArrow(released(work), f"{fields}, lang_pred string, score double" + ", likeness double" * likeness)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
