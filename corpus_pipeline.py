"""Training corpus: documents through five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes as
Parquet into the shared checkpoint folder and reads again as the next stage's documents. All but
the last return the columns of documents. Null and empty texts, repeated rows and empty tables go
through every stage as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontam, mixing, quality, simhash, token_ids
from folio.llm.common import table, written
from folio.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from these documents and the learnable labels, accepts."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id. Rows of one id are one document, of
    which one row stays; rows without an id cannot be told apart and stay."""
    ship_package(spark)
    found = written(simhash.near_duplicates(docs, shingle=4, radius=4), "components")
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("other_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["other_id"], "left_anti")
    again = written(found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("other_id")).count().where("count > 1").select("other_id"), "repeated")
    if again.isEmpty():
        return kept
    same = kept["doc_id"] == again["other_id"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item."""
    ship_package(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), width=10, shingle=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: each at least once, no source more than twice as
    often as the least repeated one."""
    ship_package(spark)
    return mixing.mixed(docs, repeats=2.0)


def token_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mixture, read back: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)
    return token_ids.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token-id output", token_id_stage),
]

# The classifier and the tokenizer have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
