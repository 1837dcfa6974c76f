"""Operators against brute force, on odd inputs and on the small documents table."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import bpe, chunk_dedup, fingerprints, language_id, licenses, ngram_join, packing, quality, queries, suffix_dedup, token_files
from seriesloom.llm.arrays import Texts
from seriesloom.llm.shingles import digest
from seriesloom.llm.signatures import Bands, signatures

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}


def rows(df):
    return df.toPandas()


def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(None if i != i or i is None else int(i), t) for i, t in df.select("doc_id", "text").toPandas().itertuples(index=False)]


def shingles(text):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


@pytest.mark.parametrize("which", ["small", "odd", "empty"])
def test_ngram_join(spark, odd, empty, which):
    docs = {"small": small(spark), "odd": odd, "empty": empty}[which]
    got = ngram_join.jaccard_classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(pairs(docs))


@pytest.mark.parametrize("ways", [1, 5, 300])
@pytest.mark.parametrize("common", [0, 30])
def test_linked_sets_meet(ways, common):
    rng = np.random.default_rng(ways + common)
    frequent = np.sort(rng.integers(0, 1 << 63, common).astype(np.uint64))
    sets, linked = [], []
    for _ in range(400):
        n = int(rng.choice([rng.integers(1, 30), rng.integers(30, 600)]))
        a = np.unique(np.r_[frequent[: rng.integers(0, common + 1)], rng.integers(0, 1 << 63, n).astype(np.uint64)])
        gone, new = int(rng.integers(0, len(a) // 4 + 1)), int(rng.integers(0, len(a) // 3 + 1))
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)])
        if not np.array_equal(a, b) and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            linked.append((len(sets), len(sets) + 1))
        sets += [a, b]
    bands = Bands(ngram_join.THRESHOLD, max(map(len, sets)))
    deal = ngram_join.Deal.of(bands, np.full(len(bands.ends), ways))
    sizes = np.array([len(s) for s in sets], np.int64)
    names = np.frombuffer(b"".join(digest(s) for s in sets), np.uint8).reshape(-1, 16)
    parts = collections.defaultdict(list)
    for step, spaces in enumerate(signatures(sets, bands, frequent)):
        for space, signed in enumerate(spaces):
            for part, blob in ngram_join._packed(signed, space, bands.of(sizes) + step, sizes, names, deal):
                parts[part].append(blob)
    forest, place = ngram_join.Forest(len(sets)), {n.tobytes(): i for i, n in enumerate(names)}
    for part, blobs in parts.items():
        found, a, b = ngram_join._meet(blobs, bands.share, part % 3 == ngram_join.ALONE)
        at = np.array([place[n.tobytes()] for n in found])
        forest.join(at[a], at[b])
    top = forest.roots(np.arange(len(sets)))
    assert len(linked) > 60 and max(parts) < 3 * deal.parts
    assert all(top[a] == top[b] for a, b in linked)
    assert len(np.unique(top)) > 300


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeated_bytes(spark, hot):
    texts = ["a" * 600, "ab" * 300, "x" * 199, "y" * 200, "z" * 201, None, "", "é" * 200, "q" * 150 + "w" * 150, "q" * 150 + "w" * 150 + "e", "abc" * 70 + "Z" * 250, "q" * 150 + "w" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"] or b"").hexdigest()) for r in suffix_dedup.repeated_bytes(docs.drop("kept"), hot=hot).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))


def test_repeated_bytes_odd(odd, empty):
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    docs = pairs(odd)
    assert suffix_dedup.repeated_bytes(odd.select("doc_id", "text")).count() == len(docs)


def test_chunks(spark, odd, empty):
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(4000)]
    passage = " ".join(words[:70])
    texts = [" ".join(words[100:400]), " ".join(words[400:700]) + " " + passage + " " + " ".join(words[700:800]), " ".join(words[800:1000]) + "! " + passage + " " + " ".join(words[1000:1300])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.substring_dedup(docs).collect()}
    assert got[0]["n_removed"] == got[1]["n_removed"] == 0
    assert 0.5 * len(passage) < got[2]["n_removed"] <= len(passage) + 2
    assert len(got[2]["kept"]) == got[2]["n_bytes"] - got[2]["n_removed"]
    assert chunk_dedup.substring_dedup(empty).count() == 0
    kept = chunk_dedup.substring_dedup(odd).collect()
    assert len(kept) == odd.count() and all(r["kept"] is None or r["kept"].decode() is not None for r in kept)


@pytest.mark.parametrize("letters, size", [("abcdefghijklmnopqrstuvwxyz", 3), ("abcdefghijklmnopqrstuvwxyz", 5), ("äöüßéàñóabcdefgh", 3), ("中文字一二三四五六七八九十百千万", 1)])
def test_chunks_of_short_passages(spark, letters, size):
    """Passages of 51 to 60 words never stay whole, however short the words; nothing else goes."""
    rng = np.random.default_rng(size)

    def words(n):
        return " ".join("".join(letters[c] for c in rng.integers(0, len(letters), rng.integers(1, 2 * size + 1))) for _ in range(n))

    passages = [words(51 + i % 10) for i in range(300)]
    texts = [f"{words(60)} {p} {words(60)}" for _ in range(2) for p in passages]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.substring_dedup(docs).collect()}
    assert not any(got[i]["n_removed"] for i in range(300))
    assert all(0 < got[300 + i]["n_removed"] <= len(p.encode()) + 8 for i, p in enumerate(passages))


def test_chance_repeats_stay(spark):
    """Lone short chunks that two texts share stay; short texts that are copies as a whole go, all but the first."""
    rng = np.random.default_rng(9)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))

    phrases = [words(6) for _ in range(200)]
    texts = [f"{words(60)} {p} {words(60)}" for _ in range(2) for p in phrases] + ["short exact copy"] * 3 + ["short exact", "copy", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.substring_dedup(docs).collect()}
    assert not any(got[i]["n_removed"] for i in range(400))
    assert [got[i]["n_removed"] for i in range(400, 406)] == [0, 16, 16, 0, 0, 0]
    longer = {r["doc_id"]: r["n_removed"] for r in chunk_dedup.substring_dedup(docs, 64).collect()}
    assert longer == {i: r["n_removed"] for i, r in got.items()}


def test_moved_chunks_count():
    """Between two ends no chunk is too short to count, also where an end moves out of a character."""
    rng = np.random.default_rng(6)
    body = "".join("ab é中😀"[c] for c in rng.integers(0, 6, 60_000)).encode()
    start = chunk_dedup.chunk_starts(Texts(np.frombuffer(body, np.uint8), np.array([0, len(body)]), None, np.zeros(1, bool)))
    least = np.diff(start[1:]).min()
    assert chunk_dedup.LEAST_CHUNK <= least < chunk_dedup.REACH


def test_byte_bpe(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(odd.filter("doc_id is not null"), path).collect()
    texts = dict(pairs(odd))
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_token_files(spark, odd, tmp_path):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = True
    for n, docs in enumerate((odd, odd.filter("false"))):
        token_files.write(docs, tokenizer, str(tmp_path / str(n)))
        got = token_files.read(spark, str(tmp_path / str(n))).orderBy("start").collect()
        assert len(got) == docs.count()
        at, seen = 0, []
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
            seen.append((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()))
        assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(d for d, _ in pairs(docs) if d is not None)
        assert sorted(seen) == sorted((str(d), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in pairs(docs))


def test_grammar():
    ids = np.random.default_rng(2).integers(0, 20, 6000)
    shard = token_files.Shard(token_files.to_bytes([4, None, 9], np.array([0, 2500, 3500]), ids))
    assert len(shard.rules) and (shard.all() == ids).all() and shard.doc_ids == [4, None, 9]
    assert (shard.document(1) == ids[:2500]).all() and (shard.document(2, 1000, 1100) == ids[3500:3600]).all() and not len(shard.document(0))


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    got = rows(packing.pack_documents(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), path))
    for doc, text in dict(pairs(odd.filter("doc_id is not null"))).items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == doc].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids and (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 4, 10), (32, 1, 32)])
def test_pack_limits(limits):
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 150, 80)
    loss = np.minimum(tokens, rng.integers(0, 60, 80))
    pieces = packing.pack(tokens, loss, *limits)
    taken, by = np.zeros(80, int), collections.defaultdict(lambda: [0, 0, 0])
    for i, start, size, sequence, offset in pieces:
        assert start == taken[i] and offset == by[sequence][0]
        taken[i] += size
        bearing = max(0, start + size - max(start, tokens[i] - loss[i]))
        by[sequence] = [by[sequence][0] + size, by[sequence][1] + 1, by[sequence][2] + bearing]
    assert (taken == tokens).all() and all(all(a <= b for a, b in zip(v, limits, strict=True)) for v in by.values())


def test_fingerprints(spark, odd, empty):
    docs = sorted(((d, t or "") for d, t in pairs(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]))), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    words = {}
    for i, (d, text) in enumerate(docs):
        after, k = docs[(i + 1) % len(docs)][1], len(text) // 3
        assert got[d]["n_chars"] == len(text) and got[d]["edited"] == text[: len(text) - k] + after[:k]
        assert words.setdefault(text, got[d]["fp"]) == got[d]["fp"]
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert fingerprints.edited_fingerprints(empty).count() == 0
    plan = fingerprints.edited_fingerprints(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_fingerprint_merge(spark):
    docs = fingerprints.add_fingerprint(spark.range(6).select((F.col("id") % 2).alias("g"), F.expr("array_join(transform(sequence(id * 40, id * 40 + 90), x -> cast(x as string)), ' ')").alias("text")), "text", "fp", 16)
    whole = {r["g"]: r["fp"] for r in fingerprints.merged(docs, "g", "fp", 16).collect()}
    for g in (0, 1):
        parts = [r["fp"] for r in docs.filter(F.col("g") == g).collect()]
        assert whole[g] == sorted({h for p in parts for h in p})[:16]


def test_language_held_out(spark, odd, empty):
    got = rows(queries.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"))
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    own = got[got.held_out & (got.lang_pred != "und")]
    assert (own.lang == own.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    model = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, model).collect()} == {"und"}
    model = language_id.fit(odd)
    named = language_id.predict(odd, model)
    assert named.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "lang_pred", "score"]
    for r in named.collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))


def test_backoff():
    model = language_id.Model({"de": {"haus": 5, "und": 9}, "en": {"house": 5, "and": 9}}, {"de": 14, "en": 14})
    scores = model.scores(["haus", "hausen", "andes"])
    assert scores[0, 0] > scores[0, 1] and scores[1, 0] > scores[1, 1] and scores[2, 1] > scores[2, 0]


def brute_quality(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


@pytest.mark.parametrize("which", ["small", "odd", "empty"])
def test_quality(spark, odd, empty, which):
    docs = {"small": small(spark), "odd": odd, "empty": empty}[which]
    got = quality.judge(docs, quality.references(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(r["text"])
        assert not (r["kept"] and r["base_failed"])
    if which == "small":
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        good = spark.createDataFrame([(r["doc_id"], r["kept"], r["base_failed"]) for r in got], "doc_id long, kept boolean, base_failed boolean").join(labels, "doc_id").filter("quality = 1 and not base_failed")
        assert good.filter("kept").count() >= 0.97 * good.count()


def test_quality_rejects(spark):
    """Of the labelled documents that pass the base rules, nearly all bad ones go and nearly all good ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs.select("doc_id", "text"), quality.references(docs)).filter("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    share = {r["quality"]: (r["n"], r["kept"]) for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[0][0] > 20 and share[0][1] < 0.1 and share[1][0] > 300 and share[1][1] > 0.99


def test_distance():
    p = np.array([[1, 1, 0], [0, 0, 4]])
    assert np.allclose(quality.distance(p, np.array([2, 2, 0])), [0, 1])


def test_licenses(spark, odd, empty):
    body = "zeta " * 50
    texts = [body + "Licensed under the Apache License, Version 2.0. " + body, body, licenses.TEMPLATES["MIT-notice"].replace("hereby", "here by").upper(), "licensed under water", None, "", "Released under the MIT License.\n" * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["license"] for i in range(7)] == ["Apache-2.0", None, "MIT-notice", None, None, None, "MIT"]
    assert got[0]["first_word"] == 50 and got[0]["coverage"] == 1 and got[1]["coverage"] == 0 and got[6]["n_notices"] == 2
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == odd.count()
    assert licenses.align([9, 1, 2, 3, 8, 4], [1, 2, 7, 3, 4]) == [(1, 0), (2, 1), (3, 3), (5, 4)]


def test_pipeline(spark):
    """Each stage against plain Python on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in P.STAGES:
        out = step(spark, docs, SF).toPandas()
        before = docs.toPandas()
        if name == "quality rules":
            failed = {r.doc_id for r in before.itertuples() if brute_quality(r.text)[5]}
            assert not failed & set(out.doc_id) and len(out) >= 0.9 * (len(before) - len(failed))
        elif name == "language ID":
            assert set(out.doc_id) == {r.doc_id for r in before.itertuples() if any(c.isalpha() for c in r.text or "")}
        elif name == "n-gram Jaccard join":
            assert set(out.doc_id) == {c for _, _, c in brute_components(pairs(docs))}
        elif name == "substring dedup":
            assert (out.n_chars == out.text.str.len()).all() and set(out.doc_id) <= set(before.doc_id)
        else:
            assert set(out.doc_id) == set(before.doc_id) and out.groupby("sequence_id").length.sum().max() <= 2048
            break
        assert list(out.columns) == P.COLUMNS
        docs = spark.createDataFrame(out, docs.schema)


def test_pipeline_language(spark, empty):
    """Texts unlike every learnt language go, whatever their letters; without labels all texts with letters stay."""
    import corpus_pipeline as P

    docs = small(spark).select(*P.COLUMNS)
    foreign = ["Это обычный русский текст, который здесь не встречается", "中文 テスト 日本語の文章です", "Kochamy długie spacery po lesie, gdzie szumią wysokie drzewa", "qwx zzkj pqrtv xkcd wvvb", "12 34"]
    more = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}

    def stay(rows):
        return {r["doc_id"] for r in P.language(spark, rows, SF).collect()}

    assert stay(docs.unionByName(more)) == letters
    bare = docs.unionByName(more).withColumn("lang", F.lit(None).cast("string"))
    assert stay(bare) == letters | {10**6 + i for i in range(4)}
    # all labels in the quarter that op6 keeps from learning
    some = docs.withColumn("lang", F.when(language_id.held_out(), F.col("lang")))
    assert letters == stay(some.unionByName(more))
    assert P.language(spark, empty, SF).count() == 0
    model = language_id.fit(docs)
    assert language_id.predict(docs, model, likeness=True).columns == [*P.COLUMNS, "lang_pred", "score", "likeness"]


def test_pipeline_near_duplicates_of_odd_rows(spark, odd, empty):
    """Null and repeated doc_ids: one row of each group of linked texts stays, and no unlinked text is lost."""
    import corpus_pipeline as P

    one, two = "the first of two quite different texts under one id", "another text that shares nothing with its neighbour in the table"
    extra = [(100, one), (100, two), (None, "a row that has no id but words of its own here"), (None, "and yet one more row without any id at all"), (101, two), (None, one)]
    docs = odd.unionByName(spark.createDataFrame([(d, t, "en", "s", 1, None, None) for d, t in extra], odd.schema))
    got = pairs(P.near_duplicates(spark, docs, SF))
    groups = {}
    for d, t in pairs(docs):
        s = frozenset(shingles(t))
        groups.setdefault(s or (d, t), []).append((d is None, d or 0, t))
    want = [min(g, key=lambda r: r[:2]) for g in groups.values()]
    assert sorted((d is None, d or 0, sorted(shingles(t))) for d, t in got) == sorted((n, d, sorted(shingles(t))) for n, d, t in want)
    assert P.near_duplicates(spark, empty, SF).count() == 0
