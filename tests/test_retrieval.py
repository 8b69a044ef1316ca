"""Exact top-k: both execution paths against a numpy brute force; edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators.retrieve import KnnConfig, knn


def _brute(q, c, k, exclude_self=False):
    out = {}
    for qid, qc, qv in q:
        cands = []
        for cid, cc, t1, t2, cv in c:
            if cc != qc or qv is None or cv is None or (exclude_self and cid == qid) or not any(cv):
                continue
            a, b = np.asarray(qv, float), np.asarray(cv, float)
            d = 1 - a.dot(b) / (np.linalg.norm(a) * np.linalg.norm(b))
            cands.append((np.floor(d * 1e9 + 0.5) / 1e9, t1, t2, cid))
        out[qid] = [x[3] for x in sorted(cands)[:k]]
    return out


@pytest.mark.parametrize("path", ["broadcast", "block"])
def test_knn_matches_brute_force(spark, path):
    rng = np.random.default_rng(3)
    colls = ["a", "b", "c"]
    q = [(i, colls[i % 3], rng.standard_normal(8).astype(np.float32).tolist()) for i in range(40)]
    c = [(100 + j, colls[j % 3], j % 5, j, rng.standard_normal(8).astype(np.float32).tolist()) for j in range(300)]
    c.append((999, "a", 0, 999, [0.0] * 8))           # zero vector: no distance, excluded
    qdf = spark.createDataFrame(q, "qid long, collection string, vec array<float>")
    cdf = spark.createDataFrame(c, "cid long, collection string, tie1 int, tie2 long, vec array<float>")
    cfg = KnnConfig(k=4, force_path=path, query_block=7, corpus_block=23)
    got = {}
    for r in knn(qdf, cdf, cfg).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.cid)
    assert got == _brute(q, c, 4)


def test_knn_edges(spark):
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "nope", [1.0, 0.0]), (3, "x", [0.0, 0.0])],
                              "qid long, collection string, vec array<float>")
    # two chunks with the same direction: equal distances are ordered by page number
    c = spark.createDataFrame([("p9", "x", 9, 0, [2.0, 0.0]), ("p6", "x", 6, 0, [1.0, 0.0])],
                              "cid string, collection string, tie1 int, tie2 long, vec array<float>")
    r = knn(q, c, KnnConfig(k=3)).orderBy("qid", "rank").collect()
    assert [(x.qid, x.rank, x.cid, x.confidence) for x in r] == [(1, 1, "p6", 1.0), (1, 2, "p9", 1.0)]


def test_context_lines(spark):
    from folio.operators.chat import chat_context
    df = spark.createDataFrame([("q", 2, "B", 9), ("q", 1, "A", 6)],
                               "qid string, rank int, document string, page_number int")
    assert chat_context(df).first().context == "A Page number: 6\nB Page number: 9\n"


def test_knn_many_queries_per_collection(spark):
    """A collection with more queries than the pair path takes uses the blocked matrix branch."""
    rng = np.random.default_rng(5)
    q = [(i, "a" if i < 70 else "b", rng.standard_normal(6).astype(np.float32).tolist()) for i in range(80)]
    c = [(i, "a" if i % 4 else "b", 0, i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(120)]
    qdf = spark.createDataFrame(q, "qid long, collection string, vec array<float>")
    cdf = spark.createDataFrame(c, "cid long, collection string, tie1 int, tie2 long, vec array<float>")
    got = {}
    for r in knn(qdf, cdf, KnnConfig(k=3, exclude_self=True, force_path="broadcast")).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.cid)
    assert got == _brute(q, c, 3, exclude_self=True)
