"""Laws over the smallest driver tables: orderings, counts, containment, recall."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_confidence_never_rises_with_rank(spark):
    from folio.plans.queries import QUERIES
    r = QUERIES["chat_retrieve"](spark, SF)
    w = Window.partitionBy("conv_id", "turn").orderBy("rank")
    bad = (r.withColumn("prev", F.lag("confidence").over(w))
           .where((F.col("prev") < F.col("confidence")) | (F.col("confidence") < 0) | (F.col("confidence") > 1)))
    assert bad.count() == 0
    assert r.groupBy("conv_id", "turn").count().where(F.col("count") > 3).count() == 0


def test_question_pages_exist(spark):
    from folio.plans.queries import QUERIES
    q = QUERIES["generate_level_1"](spark, SF)
    p = QUERIES["nonblank_pages"](spark, SF)
    assert q.join(p, ["collection", "page_number"], "left_anti").count() == 0
    per_topic = q.groupBy("collection", "topic").count()
    assert per_topic.where(F.col("count") > 5).count() == 0


def test_union_keeps_every_row(spark):
    from folio.plans.queries import QUERIES
    merged = QUERIES["merge_instruct"](spark, SF).count()
    assert merged == QUERIES["instruct_open"](spark, SF).count() + QUERIES["instruct_mcq"](spark, SF).count()


def test_metadata_counts_questions(spark):
    from folio.plans.queries import QUERIES
    m = QUERIES["quiz_metadata_l1"](spark, SF)
    q = QUERIES["generate_level_1"](spark, SF).groupBy("collection").count()
    j = m.join(q, "collection", "left").where(F.col("total_questions") != F.coalesce(F.col("count"), F.lit(0)))
    assert j.count() == 0


def test_lsh_recall_floor(spark):
    from folio.plans.queries import QUERIES
    rows = QUERIES["retrieve_lsh"](spark, SF)
    per = rows.groupBy("query_id").count()
    assert per.where("count != 5").count() == 0
    r = rows.select("query_id", "recall").distinct()
    mean = r.agg(F.avg("recall")).first()[0]
    assert mean is not None and mean >= 0.9, mean
