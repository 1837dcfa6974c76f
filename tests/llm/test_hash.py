"""Texts built by doubling with a swap, which collide under hashes modulo a power of two, and workers without the package."""

import hashlib
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken.load
from tokenizers import Tokenizer

from seriesloom.llm import bpe, chunk_dedup, licenses, ngram_join, packing, quality, suffix_dedup, token_files
from seriesloom.llm.arrays import Powers, SpanHash, seeded


def doubled(n=2048, letters="ab"):
    text = letters[0]
    while len(text) < n:
        text += text.translate(str.maketrans(letters, letters[::-1]))
    return text


ONE = doubled()
TWO = ONE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{ONE}\n{TWO}"), (4, f"{ONE} {TWO}")], "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("kind", [0, 1])
def test_spans(kind):
    body = np.frombuffer((ONE + TWO + ONE).encode(), np.uint8)
    for seed in range(20):
        found = SpanHash(seeded(256, seed), Powers(kind), body)(np.array([0, 2048, 4096]), np.array([2048, 4096, 6144]))
        assert found[0] == found[2] != found[1]


def test_spans_agree_wherever_they_lie():
    rng = np.random.default_rng(5)
    body = rng.integers(97, 100, 5000).astype(np.uint8)
    start = rng.integers(0, 4900, 3000)
    end = start + rng.integers(0, 12, 3000)
    found = SpanHash(seeded(256, 3), Powers(), body)(start, end)
    texts = [body[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert len(set(found.tolist())) == len(set(texts)) == len(set(zip(found.tolist(), texts, strict=True)))


def test_byte_bpe(pair):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={})
    for r in bpe.encode_decode(pair, path).join(pair, "doc_id").collect():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode_ordinary(r["text"]))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_library_ids(spark, pair, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write(pair, path, f"{tmp_path}/files")
    for r in token_files.read(spark, f"{tmp_path}/files").join(pair, "doc_id").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*library.encode(r["text"], add_special_tokens=False).ids, 1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {}
    for r in packing.pack_documents(pair, path).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    for r in pair.collect():
        assert got[r["doc_id"]] == [*library.encode(r["text"], add_special_tokens=False).ids, 1]


def test_lines_words_and_chunks(pair):
    assert [r["n_dup_lines"] for r in quality.judge(pair, quality.references(pair.selectExpr("*", "cast(null as string) lang"))).orderBy("doc_id").collect()] == [0] * 4
    classes = ngram_join.jaccard_classes(pair.filter("doc_id < 3"))
    assert sorted(r["component_id"] for r in classes.collect()) == [1, 2]
    assert licenses.scan(pair).count() == 4


def test_removed_bytes_have_a_copy(pair):
    """Either text alone repeats 200 bytes of itself; the brute force of both is what counts."""
    bodies = {r["doc_id"]: r["text"].encode() for r in pair.collect()}
    seen: dict[bytes, int] = {}
    for b in bodies.values():
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for r in suffix_dedup.repeated_bytes(pair).collect():
        b = bodies[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert r["n_removed"] == gone.sum()
    for r in chunk_dedup.substring_dedup(pair.filter("doc_id < 3")).collect():
        kept = bytes(r["kept"])
        assert len(kept) + r["n_removed"] == len(bodies[r["doc_id"]])


def test_columns_with_added_names_are_replaced(pair):
    clashing = pair.selectExpr("*", "1 AS kept", "2 AS spans", "3 AS n_bytes", "4 AS n_removed", "5 AS n_spans", "6 AS extra")
    for cut in (suffix_dedup.repeated_bytes, chunk_dedup.substring_dedup):
        rows = cut(clashing).collect()
        assert len(rows) == 4 and {r["extra"] for r in rows} == {6}
        assert sorted(r["n_bytes"] for r in rows) == [2048, 2048, 4097, 4097]


WORKERS = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {shared!r}).getOrCreate()
from seriesloom.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
import corpus_pipeline
print("pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package(tmp_path):
    """Driver code reaches the package by its own path; the workers' path does not have it."""
    repo = os.path.abspath(os.path.join(os.path.dirname(__file__), "..", ".."))
    names = ["op3_token_files", "op6_language_id", "op8_packing"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", WORKERS.format(repo=repo, shared=str(tmp_path / "shared"), names=names)],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()][-4:] == [*names, "pipeline"]
