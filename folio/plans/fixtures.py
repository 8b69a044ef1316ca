"""How the driver tables feed the operators (fixture mapping).

* Per-document work (pages, topics, quizzes): ``collection = 'doc_' || doc_id``.
* Retrieval and chat: ``collection = source``; a stored chunk is
  ``'doc_' || doc_id || '_page_' || page_number`` with the page's own number; ties order by
  page number, then document id.
* Questions: user turns of ``conversations``; a question asks collection
  ``'src' || (conv_id mod 20)``, so the similarity join has an equi key.
* ``pages.url`` are file names (collection names, extension test); ``pages.html`` raw files.
* ``embeddings``: ready vectors; ``collection = 'label_' || label``; every vector is a query.
* Open-QA rows: a user turn and the assistant turn that follows it; multiple-choice rows: ``benchmark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.vector import with_hashed_embedding
from folio.operators.chunks import to_chunks
from folio.operators.pages import split_pages
from folio.sources.tables import read_table

N_QUESTION_SOURCES = 20


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id", "text", "source")


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``collection='doc_<id>', doc_id, source, page_number, text`` (all pages, blanks too)."""
    return split_pages(documents(spark, sf))


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The per-document chunk store as ingest writes it (non-blank pages, ids ``page_<n>``)."""
    return to_chunks(doc_pages(spark, sf), keep=("doc_id",))


def source_pages(spark: SparkSession, sf: str) -> DataFrame:
    return split_pages(documents(spark, sf), collection=F.col("source"))


def source_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval corpus: ``collection=source, chunk_id, doc_id, page_number, document, embedding``."""
    p = source_pages(spark, sf)
    return to_chunks(p, keep=("doc_id",)).withColumn(
        "chunk_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_page_"),
                             F.col("page_number").cast("string")))


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, turn, question, collection`` for every user turn."""
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"),
        F.concat(F.lit("src"), F.pmod(F.col("conv_id"), F.lit(N_QUESTION_SOURCES)).cast("string")).alias("collection"))


def open_qa_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SQuAD-shaped rows: a user turn and the next turn when it is the assistant's.

    ``id = conv_id:turn``, ``title = conv_id``, ``context`` = user text, ``question`` = user text,
    ``answers.text`` = [assistant text]; a user turn with no answer gets an empty list.
    """
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    # next turn by an equi join on the unique (conv_id, turn): no window over a conversation
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"),
                   F.col("text").alias("next_text"))
    users = c.where(F.col("role") == "user").join(nxt, ["conv_id", "turn"], "left")
    return users.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("title"),
        F.col("text").alias("context"),
        F.col("text").alias("question"),
        F.struct(F.when(F.col("next_role") == "assistant", F.array(F.col("next_text")))
                 .otherwise(F.array().cast("array<string>")).alias("text")).alias("answers"),
    )


def question_vectors(questions: DataFrame, text_col: str = "question") -> DataFrame:
    return with_hashed_embedding(questions, text_col, "vec")


def mcq_rows(spark: SparkSession, sf: str) -> DataFrame:
    """QASC-shaped rows from ``benchmark``: the text is the fact and the question; the key letter
    is ``A``..``H`` by item id."""
    b = read_table(spark, sf, "benchmark", "item_id", "text")
    return b.select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.array().cast("array<string>").alias("choices"),
        F.substring(F.lit("ABCDEFGH"), (F.pmod("item_id", F.lit(8)) + 1).cast("int"), 1).alias("answerKey"),
        F.col("text").alias("fact1"), F.lit("").alias("fact2"), F.col("text").alias("combinedfact"),
        F.col("text").alias("formatted_question"))
