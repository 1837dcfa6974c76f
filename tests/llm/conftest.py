"""Fixtures of the text operator tests; the session is the one of the other tests."""

import pytest

ODD = [
    None, "", "   ", "\n\n", "a", "The cat sat.", "one two three four five six seven",
    "word " * 3000, "x" * 5000, "ab" * 700, "ÉTÉ déjà vu " * 30, "'s don't  stop \n\n now 'll", "中文 テスト ٣٤ 😀 ",
    "the quick brown fox jumps over the lazy dog again and again until the night comes and all is quiet in the wood " * 3,
    "Released under the MIT License.\n" * 2,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, each twice under different ids, one row repeated, a null id, and columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, "s", 1, 0.5, "zz") for i, t in enumerate([*ODD, *ODD])]
    rows += [rows[13], (None, "one two three four five six eight", "de", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
