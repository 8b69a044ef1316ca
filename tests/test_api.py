"""End-to-end calls on the smallest driver tables: ingest twice, chat, retrieve, quizzes, reset."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_end_to_end(spark):
    from folio import api
    from folio.operators import chunks
    from folio.session import scratch_path
    path = scratch_path(spark, f"api-store-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = api.ingest(spark, docs, path)
    assert first["added"] > 0 and api.ingest(spark, docs, path)["added"] == 0
    store = chunks.read_store(spark, path)
    assert store.count() == first["added"]
    conv = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'")
    qs = conv.select(F.concat_ws(":", "conv_id", "turn").alias("qid"),
                     F.concat(F.lit("doc_"), F.col("conv_id").cast("string")).alias("collection"),
                     F.col("text").alias("question"))
    answers = api.chat(spark, qs, store)
    assert answers.count() == qs.count()
    assert answers.where(F.size("documents") > 3).count() == 0
    hits = api.retrieve(qs, store, k=5)
    assert hits.groupBy("qid").count().where(F.col("count") > 5).count() == 0
    q1, meta1, _ = api.generate_level_1(store)
    assert meta1.agg(F.sum("total_questions")).first()[0] == q1.count()
    q2, meta2, _ = api.generate_level_2(store)
    assert meta2.agg(F.sum("total_questions")).first()[0] == q2.count()
    api.reset(spark, path)
    assert chunks.read_store(spark, path).count() == 0
