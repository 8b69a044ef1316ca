"""Chat: request checks, greeting route, retrieval for questions, context, answer, log.

A chat turn is a row. Retrieval is the exact top-k join of :mod:`folio.operators.retrieve`
(k = 3); the context of a question is an ordered string aggregate over its k pages
(a group bounded by k). Greetings are answered from a fixed lookup table joined by
broadcast (its size is fixed by the code, six rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import normalize_text, not_blank, py_strip
from folio.functions.vector import with_hashed_embedding
from folio.operators.pages import ordered_concat
from folio.operators.retrieve import KnnConfig, knn

CHAT_K = 3
NO_ANSWER = "No answer provided."

# Canned replies for greetings, keyed by normalized text.
GREETINGS = [
    ("hi", "👋 Hello! How can I assist you today?"),
    ("hello", "👋 Hello! What can I do for you?"),
    ("hey", "👋 Hey there! How can I help?"),
    ("good morning", "🌅 Good morning! What can I assist you with?"),
    ("good afternoon", "☀️ Good afternoon! How can I help you today?"),
    ("good evening", "🌙 Good evening! How may I assist you?"),
]


def greetings_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GREETINGS, "greeting_key string, reply string")


def validate_requests(requests: DataFrame, collection_col: str = "collection",
                      question_col: str = "question") -> DataFrame:
    """Adds ``error``: collection name required, question not blank (null when accepted)."""
    c, q = F.col(collection_col), F.col(question_col)
    err = (F.when(c.isNull() | (c == ""), F.lit("Collection name is required."))
           .when(q.isNull() | ~not_blank(q), F.lit("Question cannot be empty.")))
    return requests.withColumn("error", err)


def route_greetings(spark: SparkSession, turns: DataFrame, text_col: str = "question") -> DataFrame:
    """Adds ``normalized``, ``is_greeting`` and ``reply`` (the canned text or null)."""
    g = F.broadcast(greetings_table(spark))
    t = turns.withColumn("normalized", normalize_text(F.col(text_col)))
    return (t.join(g, t["normalized"] == g["greeting_key"], "left")
            .withColumn("is_greeting", F.col("greeting_key").isNotNull())
            .drop("greeting_key"))


def hits_for_questions(questions: DataFrame, corpus: DataFrame, k: int = CHAT_K,
                       qid: Column | None = None, metric: str = "cosine",
                       text_col: str = "question", embedder=None, **cfg) -> DataFrame:
    """:func:`retrieve_for_questions` without the pages' texts."""
    qid = qid if qid is not None else F.col("qid")
    q = questions.select("collection", qid.alias("qid"), F.col(text_col).alias("__text"))
    if embedder is None:
        q = with_hashed_embedding(q, "__text", "vec").select("collection", "qid", "vec")
    else:
        q = q.select("collection", "qid", embedder(F.col("__text")).alias("vec"))
        widths = [next((r["n"] for r in df.select(F.size(v).alias("n")).limit(16).collect() if r["n"] and r["n"] > 0), None)
                  for df, v in ((q, "vec"), (corpus, "embedding"))]
        if None not in widths and widths[0] != widths[1]:
            raise ValueError(f"queries have {widths[0]} dimensions, the store {widths[1]}")
    c = corpus.select("collection", F.col("chunk_id").alias("cid"), F.col("page_number").alias("tie1"),
                      F.col("doc_id").cast("bigint").alias("tie2"), F.col("embedding").alias("vec"))
    return knn(q, c, KnnConfig(k=k, metric=metric, **cfg)).select(
        "qid", "collection", "rank", F.col("cid").alias("chunk_id"), F.col("tie2").alias("doc_id"),
        F.col("tie1").alias("page_number"), "distance", "confidence")


def with_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with the text of their page as ``document``; what else is known of a hit is best joined to it before."""
    return hits.join(corpus.select("collection", "chunk_id", "document"), ["collection", "chunk_id"])


def retrieve_for_questions(questions: DataFrame, corpus: DataFrame, k: int = CHAT_K,
                           qid: Column | None = None, metric: str = "cosine",
                           text_col: str = "question", embedder=None, **cfg) -> DataFrame:
    """Top-k pages of each question's collection.

    ``questions``: ``collection, <text_col>`` + key columns; ``corpus``: chunk rows with
    ``collection, chunk_id, page_number, doc_id, document, embedding``.
    ``embedder`` (as for :func:`folio.operators.chunks.to_chunks`; a model may use another mode for
    queries) embeds the questions; the default is the hashed one. Vectors of another width than
    the store's are an error before the search.
    Returns ``qid, collection, rank, chunk_id, doc_id, page_number, document, distance, confidence``.
    """
    hits = hits_for_questions(questions, corpus, k, qid, metric, text_col, embedder, **cfg)
    return with_documents(hits, corpus).select("qid", "collection", "rank", "chunk_id", "doc_id", "page_number", "document", "distance", "confidence")


def context_line(document: Column, page_number: Column) -> Column:
    return F.concat(document, F.lit(" Page number: "), page_number.cast("string"), F.lit("\n"))


def chat_context(retrieved: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``"{document} Page number: {n}\\n"`` per page, concatenated in rank order."""
    return retrieved.groupBy(*keys).agg(
        ordered_concat(F.col("rank"), context_line(F.col("document"), F.col("page_number"))).alias("context"),
        F.count(F.lit(1)).cast("int").alias("n_docs"),
    )


def answer_tokens(answers: DataFrame, text_col: str = "answer", keys: tuple[str, ...] = ()) -> DataFrame:
    """White-space tokens of an answer, each followed by one space, numbered from 0."""
    toks = F.filter(F.split(py_strip(F.col(text_col)), r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+", -1), lambda t: t != "")
    return answers.select(*keys, F.posexplode(toks).alias("pos", "token")).select(
        *keys, F.col("pos").cast("int").alias("pos"), F.concat(F.col("token"), F.lit(" ")).alias("token"))


def extractive_answer(retrieved: DataFrame, questions: DataFrame, key: str = "qid",
                      text_col: str = "question") -> DataFrame:
    """Default answer (a stand-in, not a model): the sentence of the retrieved pages that shares
    the most distinct tokens with the question; ties by (rank, sentence position); none ->
    null (the caller substitutes ``No answer provided.``). Also returns ``n_docs``, the number
    of retrieved pages, from the same pass. Work per question is bounded by its k pages."""
    from folio.functions.text import tokens
    from folio.operators.questions import SENTENCE_SPLIT
    qt = questions.select(key, F.array_distinct(tokens(F.col(text_col))).alias("qtokens"))
    s = retrieved.select(key, "rank",
                         F.posexplode_outer(F.split("document", SENTENCE_SPLIT, -1)).alias("pos", "sentence"))
    s = s.join(qt, key, "left")
    overlap = F.when(F.col("sentence").isNotNull() & not_blank("sentence"),
                     F.size(F.array_intersect(F.array_distinct(tokens(F.col("sentence"))),
                                              F.coalesce("qtokens", F.array().cast("array<string>"))))
                     ).otherwise(F.lit(-1))
    s = s.withColumn("overlap", overlap)
    best = s.groupBy(key).agg(
        F.min_by(F.struct(F.col("overlap"), F.col("sentence")),
                 F.struct((-F.col("overlap")).alias("o"), F.col("rank"), F.col("pos"))).alias("b"),
        F.size(F.collect_set("rank")).alias("n_docs"))
    return best.select(key, F.when(F.col("b.overlap") > 0, F.col("b.sentence")).alias("answer"),
                       F.col("n_docs").cast("int").alias("n_docs"))


def answer_questions(spark: SparkSession, questions: DataFrame, retrieved: DataFrame, key: str = "qid",
                     text_col: str = "question") -> DataFrame:
    """Greeting route, else the extractive answer; every question gets one row."""
    routed = route_greetings(spark, questions, text_col)
    ans = extractive_answer(retrieved, questions, key, text_col)
    return (routed.join(ans, key, "left")
            .select("*", F.when(F.col("is_greeting"), F.col("reply"))
                    .otherwise(F.coalesce(F.col("answer"), F.lit(NO_ANSWER))).alias("final_answer"),
                    F.when(F.col("is_greeting"), F.lit(0)).otherwise(F.coalesce(F.col("n_docs"), F.lit(0)))
                    .alias("n_segments")))


SEGMENTS = "array<struct<document:string,metadata:struct<page_number:string>,confidence:double>>"


def segments(retrieved: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Retrieved pages per question as one array, in rank order."""
    hits = F.array_sort(F.collect_list(F.struct("rank", "document", F.struct(F.col("page_number").cast("string").alias("page_number")).alias("metadata"), "confidence")))
    return retrieved.groupBy(*keys).agg(F.transform(hits, lambda x: F.struct(
        x["document"].alias("document"), x["metadata"].alias("metadata"), x["confidence"].alias("confidence"))).cast(SEGMENTS).alias("segments"))


def chat_log_rows(answers: DataFrame, retrieved: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``keys, input, output, segments, timestamp``: what the chat log keeps of answered questions
    (from :func:`answer_questions`); greetings have no segments."""
    found = F.when(F.col("is_greeting"), F.array().cast(SEGMENTS)).otherwise(F.coalesce("segments", F.array().cast(SEGMENTS)))
    return answers.join(segments(retrieved, keys), list(keys), "left").select(
        *keys, F.col("question").alias("input"), F.col("final_answer").alias("output"), found.alias("segments"),
        F.current_timestamp().alias("timestamp"))


def append_chat_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def export_chat_log(log: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``keys, json`` in the order of time, ties by the keys."""
    return log.orderBy("timestamp", *keys).select(*keys, F.to_json(F.struct(
        "input", "output", "segments", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))).alias("json"))
