"""Repeated bytes over a whole table against brute force."""

import collections
import hashlib

import numpy as np

from seriesloom.llm import queries


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_suffix_dedup(spark, sf_dir).collect()}
    bodies = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    seen = collections.Counter(b[i : i + 200] for b in bodies.values() for i in range(len(b) - 199))
    for doc_id, b in bodies.items():
        step = np.zeros(len(b) + 201, np.int64)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                step[i] += 1
                step[i + 200] -= 1
        gone = np.cumsum(step)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert got[doc_id] == (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
