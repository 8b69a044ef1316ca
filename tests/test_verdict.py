"""Nothing is dropped in silence: every row comes back as a result or as a reject with its reason."""

import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import api
from folio.operators import chunks, generate, instruct, pages, retrieve
from folio.session import scratch_path


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


TEXT = "Alpha title\nThe rivers carry water. Mountains hold snow.\nForests shelter animals. Deserts stay dry."


def _embedder(dim=16):
    def fn(texts):
        import zlib
        if any("poison" in t for t in texts):
            raise ValueError("poison")
        return [[1.0 + (zlib.crc32(t.encode()) >> i) % 7 for i in range(dim)] for t in texts]
    return chunks.model_embedder(fn, dim)


def _store(spark, docs, embedder=None):
    path = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    return path, api.ingest(spark, docs, path, embedder)


def test_null_text_and_failed_embeddings_are_counted(spark):
    docs = _docs(spark, [(1, TEXT), (2, None), (3, "a poison page"), (4, TEXT)])
    path, counts = _store(spark, docs, _embedder())
    assert counts == {"added": 2, "failed": 1, "rejected": 1}
    assert [r.doc_id for r in pages.rejected_documents(docs).collect()] == [2]
    again = api.ingest(spark, docs, path, _embedder())
    assert again["added"] == 0 and again["failed"] == 1


def test_nothing_is_embedded_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def fn(texts):
        seen.add(len(texts))
        return np.ones((len(texts), 4))
    docs = _docs(spark, [(i, TEXT) for i in range(20)])
    path, _ = _store(spark, docs, chunks.model_embedder(fn, 4))
    before = seen.value
    assert before >= 20
    assert api.ingest(spark, docs, path, chunks.model_embedder(fn, 4))["added"] == 0 and seen.value == before


def test_custom_embedder_and_generator_end_to_end(spark):
    docs = _docs(spark, [(i, TEXT + f" Number {i} closes.") for i in range(4)])
    path, _ = _store(spark, docs, _embedder())
    store = chunks.read_store(spark, path)
    qs = spark.createDataFrame([("a", "doc_1", "where is snow"), ("b", "doc_1", "break it"), ("c", "", "x"), ("d", "doc_2", " "), ("e", "doc_2", "Hello!")],
                               "my_id string, collection string, question string")

    def factory():
        def fn(prompts):
            if any("break it" in p for p in prompts):
                raise RuntimeError("model down")
            return [json.dumps({"question": "q", "answer": "A!"}) for _ in prompts]
        return fn
    out = {r.my_id: r for r in api.chat(spark, qs, store, qid="my_id", embedder=_embedder(), generator=factory).collect()}
    assert set(out) == set("abcde")
    assert out["a"].answer == "A!" and out["a"].error is None and len(out["a"].documents) == 1
    assert "model down" in out["b"].error and out["b"].answer is None
    assert out["c"].error == "Collection name is required." and out["d"].error == "Question cannot be empty."
    assert out["e"].answer.endswith("What can I do for you?") and out["e"].documents == []
    with pytest.raises(ValueError, match="dimensions"):
        api.retrieve(qs, store, qid="my_id", embedder=_embedder(8)).collect()

    def quiz():
        def fn(prompts):
            out = []
            for p in prompts:
                topic = p.split('topic "', 1)[1].split('"', 1)[0]
                if topic == "water":
                    raise RuntimeError("no water")
                q = {"topic": topic, "type": "MCQ", "question": "q?", "options": ["a", "b", "c", "d"], "correct_answer": "A", "page_number": 1, "explanation": "e"}
                out.append(json.dumps({"questions": [q]}))
            return out
        return fn
    q1, meta, bad = api.generate_level_1(store, generator=quiz, topics_from="terms")
    assert q1.count() == meta.agg(F.sum("total_questions")).first()[0] > 0
    assert all("no water" in r.reason for r in bad.collect())
    q2, _, _ = api.generate_level_2(store, generator=quiz, topics_from="terms", embedder=_embedder())
    first = q2.first()
    assert len(first.source) == 1 and first.source[0].document.startswith("Alpha title")


def test_topics_follow_the_files(spark, tmp_path):
    from folio.operators.topics import extract_topics
    path = str(tmp_path / "docs")
    spark.createDataFrame([("c", 1, "first subject words")], "collection string, page_number int, document string").write.parquet(path)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert "subject" in {r.topic for r in extract_topics(spark.read.parquet(path)).collect()}
    spark.createDataFrame([("c", 1, "other matter words")], "collection string, page_number int, document string").write.mode("overwrite").parquet(path)
    assert "matter" in {r.topic for r in extract_topics(spark.read.parquet(path)).collect()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_collections_without_topics_are_in_quarantine(spark):
    ch = spark.createDataFrame([("none", 1, "a b c d"), ("few", 1, "alpha beta")], "collection string, page_number int, document string")
    q, meta, bad = api.generate_level_1(ch)
    assert {(r.collection, r.reason) for r in bad.collect()} == {("none", "no topics"), ("few", "fewer than 4 topics")}
    assert {r.collection: r.total_questions for r in meta.collect()} == {"none": 0, "few": 0}


def test_rows_without_an_answer(spark):
    rows = spark.createDataFrame([("1", "T", "c", "q", (["a"],)), ("2", "T", "c", "q", None), ("3", "T", "c", "q", (None,)), ("4", "T", "c", "q", ([None],))],
                                 "id string, title string, context string, question string, answers struct<text:array<string>>")
    good, bad = instruct.instruct_open(rows)
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.id for r in bad.collect()) == ["2", "3", "4"]


def test_repeated_requests(spark):
    p = spark.createDataFrame([("c", n, t) for n, t in ((1, "A"), (2, "B"), (3, "C"))], "collection string, page_number int, text string")
    counts = spark.createDataFrame([("c", 3)], "collection string, n_pages int")
    req = spark.createDataFrame([("c", 2), ("c", 2), ("x", 1), (None, 1)], "collection string, page_number int")
    got = sorted(((r.collection, r.text) for r in pages.page_interval(req, p, counts).collect()), key=str)
    assert got == [(None, None), ("c", "ABC"), ("c", "ABC"), ("x", None)] or got == [("c", "ABC"), ("c", "ABC"), ("x", None), (None, None)]


def test_window_over_range_borders(spark):
    p = spark.createDataFrame([("c", n, f"<{n}>") for n in range(1, 12)], "collection string, page_number int, text string")
    got = {r.page_number: r.window_text for r in pages.page_window(p, k=2, range_pages=3).collect()}
    assert got == {n: "".join(f"<{m}>" for m in range(max(1, n - 2), min(11, n + 2) + 1)) for n in range(1, 12)}


def test_strict_parsing(spark):
    base = {"id": "x", "topic": "t", "type": "MCQ", "question": "q", "options": ["a"], "correct_answer": "A", "page_number": 7, "explanation": "e"}
    spoilt = [{"options": "abc"}, {"options": None}, {"question": None}, {"topic": 5}, {"correct_answer": ["A"]}, {"page_number": 7.5}]
    raw = spark.createDataFrame([(str(k), json.dumps({"questions": [base | s]})) for k, s in enumerate([{}, *spoilt])], "k string, json string")
    good, bad = generate.parse_questions(raw, keys=("k",))
    assert [(r.k, r.page_number, r.options) for r in good.collect()] == [("0", 7, ["a"])]
    assert good.first().id != "x" and len(good.first().id) == 64
    assert sorted(r.k for r in bad.collect()) == ["1", "2", "3", "4", "5", "6"]
    topics = spark.createDataFrame([("1", '{"book_title":"b","total_topics":1,"main_topics":["a"]}'), ("2", '{"book_title":1,"total_topics":1,"main_topics":["a"]}'), ("3", "{")], "k string, json string")
    ok, no = generate.parse_topics(topics, keys=("k",))
    assert [r.k for r in ok.collect()] == ["1"] and sorted(r.k for r in no.collect()) == ["2", "3"]
    chat = spark.createDataFrame([("1", '{"question":null,"answer":"a"}'), ("2", '{"question":"q","answer":null}')], "k string, json string")
    ok, no = generate.parse_chat(chat, keys=("k",))
    assert [r.k for r in ok.collect()] == ["1"] and [r.k for r in no.collect()] == ["2"]


def test_one_bad_prompt_costs_one_row(spark):
    def factory():
        def fn(prompts):
            if "bad" in prompts:
                raise ValueError("bad prompt")
            return ["ok"] * len(prompts)
        return fn
    p = spark.createDataFrame([(str(i), "bad" if i == 3 else "good") for i in range(10)], "prompt_id string, prompt string").coalesce(1)
    out = {r.prompt_id: r for r in generate.batch_generate(p, factory).collect()}
    assert sum(r.error is not None for r in out.values()) == 1 and out["3"].response is None


def test_forced_broadcast_does_not_cut(spark):
    q = spark.createDataFrame([(i, "c", [1.0, float(i)]) for i in range(50)], "qid long, collection string, vec array<double>")
    c = spark.createDataFrame([(i, "c", 0, i, [1.0, float(i)]) for i in range(9)], "cid long, collection string, tie1 int, tie2 long, vec array<double>")
    with pytest.raises(ValueError):
        retrieve.knn(q, c, retrieve.KnnConfig(k=2, force_path="broadcast", max_broadcast_bytes=800))
    assert retrieve.knn(q, c, retrieve.KnnConfig(k=2, max_broadcast_bytes=800)).count() == 100


def test_equal_ids_in_two_collections(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "qid long, collection string, vec array<double>")
    c = spark.createDataFrame([(i, coll, 0, i, [1.0, float(i)]) for coll in "ab" for i in range(4)], "cid long, collection string, tie1 int, tie2 long, vec array<double>")
    for path in ("broadcast", "block"):
        got = sorted((r.collection, r["rank"], r.cid) for r in retrieve.knn(q, c, retrieve.KnnConfig(k=2, force_path=path)).collect())
        assert got == [("a", 1, 0), ("a", 2, 1), ("b", 1, 3), ("b", 2, 2)]


def test_lsh_with_real_buckets(spark):
    from folio.operators.lsh import lsh_knn
    r = np.random.default_rng(4)
    centres = r.standard_normal((150, 64))
    rows = [(int(i), "c", (centres[i % 150] + 0.15 * r.standard_normal(64)).astype(np.float32).tolist()) for i in range(1800)]
    q = spark.createDataFrame(rows[::20], "qid long, collection string, vec array<float>")
    c = spark.createDataFrame(rows, "cid long, collection string, vec array<float>").select("cid", "collection", F.lit(0).alias("tie1"), F.col("cid").alias("tie2"), "vec")
    cfg = retrieve.KnnConfig(k=5, exclude_self=True)
    near = {(x.qid, x.cid) for x in lsh_knn(q, c, cfg, bucket_rows=64).collect()}
    exact = {(x.qid, x.cid) for x in retrieve.knn(q, c, cfg).collect()}
    assert len(near) == 5 * 90 and len(near & exact) >= 0.9 * len(exact)


def test_lsh_recall_with_many_bits(spark):
    from folio.operators import lsh
    r = np.random.default_rng(9)

    def recall(points, bucket_rows, every):
        rows = [(i, "c", v.tolist()) for i, v in enumerate(points.astype(np.float32))]
        q = spark.createDataFrame(rows[::every], "qid long, collection string, vec array<float>")
        c = spark.createDataFrame(rows, "cid long, collection string, vec array<float>").select("cid", "collection", F.lit(0).alias("tie1"), F.col("cid").alias("tie2"), "vec")
        cfg = retrieve.KnnConfig(k=5, exclude_self=True)
        near = {(x.qid, x.cid) for x in lsh.lsh_knn(q, c, cfg, bucket_rows=bucket_rows).collect()}
        exact = {(x.qid, x.cid) for x in retrieve.knn(q, c, cfg).collect()}
        return len(near & exact) / len(exact), lsh.chosen(q, c, cfg, 64, 8, bucket_rows, lsh.RECALL).first()["__bits"]

    # neighbours no nearer than chance puts them
    assert recall(r.standard_normal((3000, 64)), 8, 4)[0] >= 0.9
    centres = r.standard_normal((60, 64))
    found, bits = recall(centres[np.arange(6000) % 60] + 0.3 * r.standard_normal((6000, 64)), 64, 8)
    assert found >= 0.9 and bits >= 6, (found, bits)


def test_scan_of_one_collection_prunes(spark):
    docs = _docs(spark, [(i, TEXT) for i in range(30)])
    path, _ = _store(spark, docs)
    one = chunks.scan_collection(spark, path, "doc_7")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:120]


def test_cluster_without_a_shared_folder_is_an_error():
    from folio import session

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_block_path_gives_the_same(spark):
    from folio.plans.queries import QUERIES
    a, b = (sorted(map(tuple, QUERIES[k](spark, "/root/testdata/sf0.001").collect())) for k in ("retrieve_topk", "retrieve_topk_blocks"))
    assert a == b


def test_exports_keep_topic_order(spark, tmp_path):
    from folio.sinks import export_topics
    from folio.operators.topics import extract_topics, topic_lists
    ch = spark.createDataFrame([("c", 1, TEXT)], "collection string, page_number int, document string")
    lists = topic_lists(extract_topics(ch))
    export_topics(lists, str(tmp_path / "t"))
    back = json.loads(spark.read.text(str(tmp_path / "t")).first().value)
    assert back["main_topics"] == lists.first().main_topics and back["extraction_timestamp"]
