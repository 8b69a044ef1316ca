"""What tables of many files, long texts and many equal distances must not change or make large."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators import questions as qn
from folio.operators import topics as tp


def _tables(spark, path, files):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"alpha beta gamma {c}") for c in range(6) for t in range(4)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(i, f"alpha beta page {i}\nsecond gamma line", "en", f"src{i % 6}", 30) for i in range(18)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    c.repartition(files).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_chat", "stream_chat_log"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    from folio.plans.queries import QUERIES
    got = QUERIES[name](spark, _tables(spark, str(tmp_path), 3)).collect()
    assert len(got) == {"stream_chat": 36, "stream_chat_log": 12}[name]


def _chunks(spark, pages):
    rows = [("c", i, f"alpha{i % 7} beta{i % 5} gamma delta epsilon. word{i} alpha{i % 7}!") for i in range(1, pages + 1)]
    return spark.createDataFrame(rows, "collection string, page_number int, document string")


def test_topics_of_a_collection_of_many_pages_are_those_of_one_task(spark, monkeypatch):
    c = _chunks(spark, 40)
    whole = sorted(tp.extract_topics(c).collect(), key=str)
    monkeypatch.setattr(tp, "WHOLE_PAGES", 10)
    assert whole and sorted(tp.extract_topics(c).collect(), key=str) == whole


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_do_not_go_through_the_questions(spark):
    """Without their sources level 2 questions carry no page, and level 1's window no words."""
    c = _chunks(spark, 12)
    t = spark.createDataFrame([("c", i + 1, w) for i, w in enumerate(["gamma", "delta", "epsilon", "alpha1"])], "collection string, topic_rank int, topic string")
    pages = c.where("page_number = 1").crossJoin(t.select("topic")).withColumn("confidence", F.lit(1.0))
    q, _ = qn.generate_level_2(pages, t, c)
    assert {r["topic"] for r in q.collect()} == {"gamma", "delta", "epsilon", "alpha1"}
    joined = _plan(q.groupBy("collection").count()).split("Join ")[1].split("\n")[1]
    assert "hits" in joined and "document#" not in joined.split("slice(")[0]
    one, _ = qn.generate_level_1(c, t)
    window = _plan(one).split("Window ")[1].split("Generate")[0]
    assert "cores" not in window.split("\n", 1)[1]


def test_spoilt_questions_are_parsed_from_stored_answers(spark, tmp_path):
    from folio.plans.queries import QUERIES
    df = QUERIES["parse_quarantine"](spark, _tables(spark, str(tmp_path), 1))
    assert "Window" not in _plan(df)


def test_equal_distances_are_ranked_tile_by_tile(monkeypatch):
    """Copies are all equally near: what is ranked at once stays bounded."""
    from folio.operators import retrieve
    seen, rank = [], retrieve._topk_index
    monkeypatch.setattr(retrieve, "_topk_index", lambda q, *a: seen.append(len(q)) or rank(q, *a))
    ids = np.arange(8192)
    got = retrieve._block_candidates(np.arange(300), np.ones((300, 4)), ids, ids, ids, np.ones((8192, 4)), retrieve.KnnConfig(k=3))
    assert max(seen) <= 1 << 20 and sum(seen) == 300 * 8192
    assert len(got[0]) == 900 and set(got[1]) == {0, 1, 2}


def test_hits_of_a_group_are_the_nearest_of_the_asked_cells(monkeypatch):
    from folio.operators import cells
    from folio.operators.retrieve import KnnConfig
    monkeypatch.setattr(cells, "MERGE_AT", 50)
    monkeypatch.setattr(cells, "TILE_CELLS", 64)
    rng = np.random.default_rng(5)
    v = np.repeat(rng.standard_normal((60, 8)), 3, axis=0).astype(np.float32)        # three copies of each
    c = pd.DataFrame({"collection": ["a", "b"] * 90, "cell": rng.integers(0, 6, 180), "cid": rng.permutation(180), "tie1": 0, "tie2": rng.integers(0, 9, 180), "vec": list(v)})
    q = pd.DataFrame({"collection": ["a", "b", "a", "gone"] * 10, "qid": np.arange(40), "cells": [rng.permutation(6)[:3] for _ in range(40)], "vec": list(rng.standard_normal((40, 8)).astype(np.float32))})
    got = cells._group_hits(q, c, KnnConfig(k=4, exclude_self=True))
    for _, x in q.iterrows():
        own = c[(c["collection"] == x["collection"]) & c["cell"].isin(x["cells"]) & (c["cid"] != x["qid"])].copy()
        own["d"] = [round(1 - float(np.dot(r.astype(float), x["vec"].astype(float)) / np.linalg.norm(r.astype(float)) / np.linalg.norm(x["vec"].astype(float))), 9) for r in own["vec"]]
        best = own.sort_values(["d", "tie1", "tie2", "cid"])["cid"].tolist()[:4]
        assert sorted(got[got["qid"] == x["qid"]]["cid"]) == sorted(best)


def test_a_query_gets_its_hits_once_a_group_not_once_a_cell(spark, tmp_path, monkeypatch):
    from folio.operators import cells
    from folio.operators.retrieve import KnnConfig, knn
    monkeypatch.setattr(cells, "GROUP_ROWS", 150)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(6)
    rows = [("abc"[i % 3] if i % 9 else "a", i, 0, i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)]
    c = spark.createDataFrame(rows, "collection string, cid long, tie1 int, tie2 long, vec array<float>")
    q = c.select("collection", F.col("cid").alias("qid"), "vec")
    path = f"{tmp_path}/index"
    cells.build(c, path, cells=12)
    asked = cells._plan(q, path, 3, 12, "first").select("collection", "qid", "vec", F.col("first").alias("cells"))
    assert cells._in_cells(asked, path, "vec", "vec", KnnConfig(k=3)).groupBy("qid").count().agg(F.max("count")).first()[0] <= 3 * 2
    hits, visits = cells.search_exact(q, path, k=3, exclude_self=True)
    key = lambda df: sorted((r["qid"], r["rank"], r["cid"], round(r["distance"], 7)) for r in df.collect())
    assert key(hits) == key(knn(q, c, KnnConfig(k=3, exclude_self=True)))
    assert visits.count() == 600


def test_a_filter_on_links_does_not_multiply_their_steps(spark):
    from folio.llm import urls
    p = spark.createDataFrame([(1, "http://a.com/x/y.html", "<base href='/q/'><link rel=canonical href='./z/../k?x&amp;y'>"), (2, "http://b.com/", None)], "page_id long, url string, html string")
    found = urls.link_edges(p).where("a != b")
    assert _plan(found).count("regexp_extract") < 200
    assert {tuple(r) for r in found.collect()} == {("http://a.com/x/y.html", "a.com/x/y"), ("http://a.com/x/y.html", "a.com/q/k?x&y"), ("http://b.com/", "b.com")}


def test_an_encoder_that_forgets_gives_memory_back(monkeypatch):
    import pyarrow as pa
    import public_tokenizers
    from folio.llm import token_ids
    e = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), remember=2)
    calls, first = [], e.texts(pa.array(["one two three four", "one two"]), 0)[0].tolist()
    monkeypatch.setattr(token_ids, "release", lambda: calls.append(1))
    assert e.texts(pa.array(["one two three four", "one two"]), 0)[0].tolist() == first and calls == [1]


def _nearest(Q, C, t2, k, skip=None):
    with np.errstate(invalid="ignore", divide="ignore"):
        D = np.array([1 - (C @ q) / np.sqrt((q @ q) * (C * C).sum(1)) for q in Q])
    D[~np.isfinite(D)] = np.inf
    if skip is not None:
        D[skip[:, None] == t2[None, :]] = np.inf
    found = [sorted((round(float(d), 9), int(t)) for d, t in zip(row, t2) if np.isfinite(d))[:k] for row in D]
    return [[t for _, t in row] for row in found]


@pytest.mark.parametrize("kind", ["words", "signed", "copies", "zero", "small", "self"])
def test_few_distances_of_a_block_are_made_in_double_precision(monkeypatch, kind):
    """what grows with questions times pages is one product in single precision."""
    from folio.operators import retrieve
    rng = np.random.default_rng(5)
    n, nq = (700 if kind == "small" else 9000), 150
    C, Q = ((rng.standard_normal((m, 64)) if kind == "signed" else rng.poisson(1.5, (m, 64)).astype(float)) for m in (n, nq))
    if kind == "copies":
        C[3000:3040] = C[7]
        C[5000] = C[7] * 3
        Q[:20] = C[7]
    if kind == "zero":
        C[11], Q[3], C[12, 5] = 0, 0, np.nan
    if kind == "self":
        C[:nq] = Q
    ids = rng.permutation(n)
    exact, cells = [], []
    dist, pair = retrieve._dist, retrieve._pair_dist
    monkeypatch.setattr(retrieve, "_dist", lambda Q, C, m: cells.append(len(Q) * len(C)) or dist(Q, C, m))
    monkeypatch.setattr(retrieve, "_pair_dist", lambda Q, *a: exact.append(len(Q)) or pair(Q, *a))
    own = ids[:nq] if kind == "self" else None
    with np.errstate(invalid="ignore", divide="ignore"):
        got = retrieve._block_candidates(np.arange(nq), Q, ids, np.ones(n, int), ids, C, retrieve.KnnConfig(k=3, exclude_self=kind == "self"), self_ids=own)
    order = np.lexsort((got[3], got[5], got[0]))
    rows = [[int(t) for q, t in zip(got[0][order], got[3][order]) if q == i] for i in range(nq)]
    assert rows == _nearest(Q, C, ids, 3, own)
    if kind != "zero":   # a vector without direction sends its block through all distances
        assert not cells and 3 * nq <= sum(exact) < n * nq // 20


def test_equal_distances_and_places_are_ordered_by_id():
    from folio.operators import retrieve
    q, one = np.zeros(4, int), np.ones(4)
    ids = np.array(["d", "b", "c", "a"], dtype=object)
    assert list(ids[retrieve._topk_index(q, ids, one, one, one, 2)]) == ["a", "b"]
    assert list(ids[retrieve._topk_index(q, ids, one, np.array([3, 1, 2, 1]), one, 3)]) == ["a", "b", "c"]


@pytest.mark.parametrize("dim", [64, 7, 200])
def test_slots_of_a_text_are_counted_by_the_byte(spark, dim):
    """counting slots does not copy the slots of a page once a slot."""
    import hashlib
    import re
    from folio.functions.vector import MARKS, with_hashed_embedding, with_slot_counts
    texts = ["", "Alpha beta, beta! Éa 12 x_y", " ".join(f"w{i % 90}" for i in range(700)), None, "\x00 0~o", "日本 語 ß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = with_slot_counts(df, "text", "counts", dim)
    assert ("array_remove" in _plan(out)) == (dim > len(MARKS))
    for r in out.collect():
        want = [0] * dim
        for w in re.findall(r"[^\W_]+", (r["text"] or "").lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
        assert r["counts"] == (want if r["text"] is not None else [None] * dim)
    vec = {r["i"]: r["embedding"] for r in with_hashed_embedding(df, "text", "embedding", dim).collect()}
    assert vec[0] is None and vec[3] is None and abs(sum(v * v for v in vec[2]) - 1) < 1e-6
