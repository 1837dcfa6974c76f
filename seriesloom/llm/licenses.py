"""License scans by patience alignment.

A text and a license template are aligned on words that occur once in each,
kept in order by a longest increasing subsequence, and the gaps between them
are aligned in the same way. Coverage is the share of template words aligned.
Stretches worth aligning are those with two neighbouring words of a template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.arrays import LOWER, Powers, SpanHash, released, runs, seeded, slices
from seriesloom.llm.tables import bounded_batches

LEAST_COVERAGE = 0.8
# fixed values: wording of common notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
}
_TOKEN = np.zeros(256, bool)
_TOKEN[ord("0") : ord("9") + 1] = _TOKEN[ord("a") : ord("z") + 1] = _TOKEN[ord("A") : ord("Z") + 1] = _TOKEN[128:] = True
_BYTES = seeded(256, 91)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of letters and digits, A-Z in lower case."""
    data = LOWER[data]
    start, end, row = runs(_TOKEN[data], offsets)
    return SpanHash(_BYTES, powers, data)(start, end), row


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (text, template), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {x: c + j for j, x in enumerate(template[c:d]) if there[x] == 1 and here[x] == 1}
        pairs = [(i, place[text[i]]) for i in range(a, b) if text[i] in place]
        chain = increasing(pairs)
        if not chain:
            continue
        out += chain
        at = (a, c)
        for i, j in [*chain, (b, d)]:
            todo.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, whose second values ascend."""
    tops: list[int] = []
    who: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(who[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            who.append(n)
        else:
            tops[k], who[k] = j, n
    out, n = [], who[-1] if who else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """The best notice in every text.

    Returns doc_id, n_words, license (null if no template reaches ``least``),
    coverage (of the best template, 0 if no two neighbouring words of one
    occur), first_word and last_word of the best alignment (null without
    one), n_notices (places that reach ``least``). Ties go to the template with more words, then to the
    earlier place. Null and empty texts have no words. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, forms = Powers(), {}
        for name, body in templates.items():
            raw = np.frombuffer(body.encode(), np.uint8)
            forms[name] = tokens(raw, np.array([0, len(raw)]), powers)[0]
        pairs = [(int(x), name, j) for name, h in forms.items() for j, x in enumerate((h[:-1] * _NEXT + h[1:]).tolist())]
        table = np.unique(np.array([p[0] for p in pairs], np.uint64))
        where: dict[int, list[tuple[str, int]]] = {}
        for x, name, j in pairs:
            where.setdefault(x, []).append((name, j))
        for texts in slices(batches):
            word, row = tokens(texts.data, texts.offsets, powers)
            count = np.bincount(row, minlength=len(texts))
            first = np.cumsum(count) - count
            best: dict[int, tuple] = {}
            notices = np.zeros(len(texts), np.int64)
            if len(word) > 1 and len(table):
                two = word[:-1] * _NEXT + word[1:]
                hit = np.flatnonzero((table[np.minimum(np.searchsorted(table, two), len(table) - 1)] == two) & (row[:-1] == row[1:]))
                spots: dict[tuple[int, str], list[int]] = {}
                for i, x, r in zip(hit.tolist(), two[hit].tolist(), row[hit].tolist(), strict=True):
                    for name, j in where[x]:
                        spots.setdefault((r, name), []).append(i - j)
                for (r, name), starts in spots.items():
                    form = forms[name].tolist()
                    low, high, slack = int(first[r]), int(first[r] + count[r]), max(2, len(form) // 2)
                    last = None
                    for s in sorted(set(starts)):
                        if last is not None and s <= last + slack:
                            continue
                        last = s
                        a, b = max(low, s - slack), min(high, s + len(form) + 2 * slack)
                        found = align(word[a:b].tolist(), form)
                        if not found:
                            continue
                        share = len(found) / len(form)
                        notices[r] += share >= least
                        rank = (share >= least, len(form) if share >= least else share, share, -(a + found[0][0] - low), name)
                        if r not in best or rank > best[r][0]:
                            best[r] = (rank, name if share >= least else None, share, a + found[0][0] - low, a + found[-1][0] - low)
            some = [best.get(i, (None, None, 0.0, None, None)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column(0), pa.array(count, pa.int64()), pa.array([x[1] for x in some], pa.string()), pa.array([x[2] for x in some], pa.float64()),
                 pa.array([x[3] for x in some], pa.int64()), pa.array([x[4] for x in some], pa.int64()), pa.array(notices)],
                names=["doc_id", "n_words", "license", "coverage", "first_word", "last_word", "n_notices"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(
        released(work), "doc_id long, n_words long, license string, coverage double, first_word long, last_word long, n_notices long")
