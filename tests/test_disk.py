"""What intermediates leave on disk: no shuffle files, no page once a topic, no wave's texts but its own."""

import os
import random

from pyspark.sql import functions as F

from folio import api, sinks
from folio.operators import journal
from folio.operators.chunks import to_chunks
from folio.session import checkpoint_dir, stored
from test_generator_path import calls, counting, model, tables


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def kept(spark):
    top = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    t = stored(spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.md5(F.col("id").cast("string")).alias("v")).groupBy("k").agg(F.max("v").alias("v")))
    assert t.count() == 5000 and not [f for f in shuffle_files(spark) - before if f.endswith(".data") and os.path.getsize(f) > 50_000]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_wave_reads_its_own_texts(spark, tmp_path):
    seen = str(tmp_path / "seen")
    os.makedirs(seen)

    @F.udf("string")
    def look(text):
        import uuid
        open(os.path.join(seen, uuid.uuid4().hex), "w").close()
        return text

    texts, asks = tables(spark, [(str(i), f"text {i}") for i in range(60)], [(str(i), f"{i}:{t}", f"{t}: ", ".") for i in range(60) for t in "xy"])
    folder, path = str(tmp_path / "calls"), str(tmp_path / "journal")
    got = journal.ask(texts.withColumn("context", look.asNondeterministic()("context")), asks, counting(folder), path, wave=10, per_task=4)
    assert got.where("response IS NOT NULL").count() == 120 and len(calls(folder)) == 120
    assert len(os.listdir(seen)) <= 60       # not once a wave


def test_pages_are_not_kept_once_a_topic(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join([f"topic{i:02}" for i in range(10)] + [f"{r.getrandbits(64):016x}" for _ in range(800)] + [str(n)])
    pages = [(f"c{c}", p, text(p)) for c in range(4) for p in range(1, 4)]
    store = to_chunks(spark.createDataFrame(pages, "collection string, page_number int, text string"))
    before = kept(spark)
    q, meta, bad = api.generate_level_2(store, n=3, generator=model(), journal=str(tmp_path / "j"), k=3, max_chars=60_000)
    got = q.select("collection", "topic", "question_pos", "source").collect()
    assert kept(spark) - before < 4 * sum(len(t) for _, _, t in pages)       # ten topics of three pages are ten times the text
    assert len(got) == 4 * 10 * 3 and {len(x["source"]) for x in got} == {3}
    texts = {(c, str(p)): t for c, p, t in pages}
    assert all(s["document"] == texts[x["collection"], s["metadata"]["page_number"]] for x in got for s in x["source"])
    assert meta.agg(F.sum("total_questions")).first()[0] == 120 and bad.where("reason = 'more than 3 questions'").count() == 4 * 10 * 6


def test_level_2_pages_are_joined_last(spark):
    from folio.plans.queries import QUERIES
    plan = QUERIES["question_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.split("\n") if "Join " in line)
    assert "chunk_id" in last or "cid" in last


def test_an_export_may_be_packed(spark, tmp_path):
    q = spark.createDataFrame([("c", "t", 1, k, str(k), "MCQ", "what? " * 50, ["a"], "A", 1, "why " * 50) for k in range(200)],
                              "collection string, topic string, topic_rank int, question_pos int, id string, type string, question string, options array<string>, correct_answer string, page_number int, explanation string")
    meta = spark.createDataFrame([("c", 200, "T", "x")], "collection string, total_questions int, book_title string, tool_used string")
    size, rows = {}, {}
    for how in ("none", "gzip"):
        path = str(tmp_path / how)
        sinks.export_questions(q, meta, path, compression=how)
        size[how] = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("part-"))
        rows[how] = [r.asDict(True) for r in spark.read.schema(sinks.RESULT_SCHEMA).json(path).drop("metadata").collect()]
    assert rows["none"] == rows["gzip"] and size["gzip"] * 10 < size["none"]
