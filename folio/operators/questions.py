"""Multiple-choice questions per topic (level 1: whole document; level 2: retrieved page).

Default generator (a stand-in, not a language model; deterministic so results can be checked):

* sentences: page text split on ``[.!?]`` + white space, or a new line; blank ones dropped;
* a sentence belongs to a topic when one of its space-separated words, lower-cased and
  stripped of non letters/digits, equals the topic;
* the first ``n`` sentences per topic by ``(page_number, sentence_pos)`` become questions: the
  matching words are blanked as ``____``; options are the topic and the first three other
  topics of the collection by ``md5(topic|other|sentence)``, shown in ``md5(option|sentence)``
  order; the answer is the letter of the topic; ``explanation = 'Page {n}: ' || sentence``.
* a collection with fewer than 4 topics gives no questions and a quarantine row.

Every step is a column expression over a sentence row; the topic list of a collection
(at most 10) is attached by an equi join on ``collection``, so there is no word explosion
and no pairing of sentences with anything but their own collection's short topic list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import not_blank

SENTENCE_SPLIT = r"[.!?][\t\n\f\r ]|\n"
N_LEVEL_1 = 5
N_LEVEL_2 = 10
TOOL = "extractive"
LETTERS = "ABCD"

QUESTION_FIELDS = ["id", "topic", "type", "question", "options", "correct_answer", "page_number", "explanation"]


def core(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def cores(sentence: Column) -> Column:
    """Cores of all space-separated words at once: one regex per sentence, not per word
    (same result as ``transform(split(s, ' '), core)``: spaces are kept, so words align)."""
    return F.split(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N} ]", ""), " ", -1)


def sentences(chunks: DataFrame, *keep: str) -> DataFrame:
    s = chunks.select("collection", "page_number", *keep,
                      F.posexplode(F.split("document", SENTENCE_SPLIT, -1)).alias("sentence_pos", "sentence"))
    return s.where(not_blank("sentence")).withColumn("sentence_pos", F.col("sentence_pos").cast("int"))


def _options(topic: Column, topics: Column, sentence: Column) -> Column:
    others = F.filter(topics, lambda t: t != topic)
    ranked = F.array_sort(F.transform(others, lambda o: F.struct(
        F.md5(F.concat_ws("|", topic, o, sentence)).alias("h"), o.alias("t"))))
    chosen = F.concat(F.array(topic), F.transform(F.slice(ranked, 1, 3), lambda x: x["t"]))
    shown = F.array_sort(F.transform(chosen, lambda o: F.struct(
        F.md5(F.concat_ws("|", o, sentence)).alias("h"), o.alias("t"))))
    return F.transform(shown, lambda x: x["t"])


def _question_columns(df: DataFrame) -> DataFrame:
    """Expects ``cores`` as a column of its own (computed once per sentence)."""
    words = F.split(F.col("sentence"), " ", -1)
    opts = _options(F.col("topic"), F.col("topics"), F.col("sentence"))
    return df.select(
        "*",
        F.sha2(F.concat_ws("|", "collection", "topic", F.col("page_number").cast("string"),
                           F.col("sentence_pos").cast("string")), 256).alias("id"),
        F.lit("MCQ").alias("type"),
        # words and cores zipped first: the lambda reads struct fields only, so an inlined
        # ``cores`` expression is still evaluated once per sentence, not once per word
        F.array_join(F.transform(F.arrays_zip(words.alias("w"), F.col("cores").alias("c")),
                                 lambda x: F.when(x["c"] == F.col("topic"), F.lit("____")).otherwise(x["w"])),
                     " ").alias("question"),
        opts.alias("options"),
        F.array_position("topics", F.col("topic")).cast("int").alias("topic_rank"),
    ).withColumn("correct_answer", F.substring(F.lit(LETTERS), F.array_position("options", F.col("topic")).cast("int"), 1)) \
     .withColumn("explanation", F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": "),
                                         F.col("sentence")))


def topic_arrays(topics: DataFrame) -> DataFrame:
    return topics.groupBy("collection").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("topic_rank", "topic"))), lambda x: x["topic"])
        .alias("topics"))


def with_topics(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """Hits of collections with enough topics, each with all of its collection's as ``topics``: small rows, joined before their pages are."""
    return hits.join(topic_arrays(topics).where(F.size("topics") >= 4), "collection")


def too_few_topics(chunks: DataFrame, arrays: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("topics"), F.lit(0))
    return chunks.select("collection").distinct().join(arrays, "collection", "left").where(n < 4).select(
        "collection", F.when(n == 0, F.lit("no topics")).otherwise(F.lit("fewer than 4 topics")).alias("reason"))


def generate_level_1(chunks: DataFrame, topics: DataFrame, n: int = N_LEVEL_1) -> tuple[DataFrame, DataFrame]:
    """Returns ``(questions, quarantine)``. Questions carry ``topic_rank`` and ``question_pos`` 1..n
    per topic; every collection of ``chunks`` without enough topics is in quarantine."""
    ta = topic_arrays(topics)
    ok = ta.where(F.size("topics") >= 4)
    quarantine = too_few_topics(chunks, ta)
    # pages meet their topics before they are cut, and only sentences go through the window
    s = sentences(chunks.select("collection", "page_number", "document").join(ok, "collection"), "topics").withColumn("cores", cores(F.col("sentence")))
    m = s.select("*", F.explode(F.array_intersect("topics", "cores")).alias("topic")).drop("cores")
    w = Window.partitionBy("collection", "topic").orderBy("page_number", "sentence_pos")
    top = m.withColumn("question_pos", F.row_number().over(w)).where(F.col("question_pos") <= n)
    return _question_columns(top.withColumn("cores", cores(F.col("sentence")))), quarantine


def source_array() -> Column:
    """``[{document, metadata, confidence}]`` of a retrieved row."""
    return F.array(F.struct("document", F.struct(F.col("page_number").cast("string").alias("page_number")).alias("metadata"), "confidence"))


def generate_level_2(retrieved: DataFrame, topics: DataFrame, chunks: DataFrame, n: int = N_LEVEL_2) -> tuple[DataFrame, DataFrame]:
    """``retrieved``: one row per ``(collection, topic)`` with its best page
    (``page_number, document, confidence``, and ``topics`` if they come :func:`with_topics`). Questions come from that page only and carry it as
    ``source``. Collections of ``chunks`` without enough topics are in quarantine."""
    ta = topic_arrays(topics)
    quarantine = too_few_topics(chunks, ta)
    sent = F.transform(F.split("document", SENTENCE_SPLIT, -1), lambda x, i: F.struct(i.alias("pos"), x.alias("s")))
    hit = F.filter(sent, lambda x: not_blank(x["s"]) & F.array_contains(cores(x["s"]), F.col("topic")))
    # the sentences are picked where the page is, so that without ``source`` no page goes on
    r = retrieved.withColumn("hits", F.slice(hit, 1, n)).where(F.size("hits") > 0).withColumn("source", source_array()).drop("document")
    r = r if "topics" in retrieved.columns else with_topics(r, topics)
    picked = r.select("*", F.posexplode("hits").alias("qp", "hit")).select(
        "collection", "topic", "topics", "page_number", F.col("confidence").alias("source_confidence"), "source",
        F.col("hit.pos").cast("int").alias("sentence_pos"), F.col("hit.s").alias("sentence"),
        (F.col("qp") + 1).cast("int").alias("question_pos")).withColumn("cores", cores(F.col("sentence")))
    return _question_columns(picked), quarantine


def flat_questions(q: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Scalar view of question rows (options as four columns)."""
    return q.select(
        "collection", "topic", F.col("question_pos").cast("int").alias("question_pos"), "id", "type", "question",
        *[F.col("options")[i].alias(f"option_{c.lower()}") for i, c in enumerate(LETTERS)],
        "correct_answer", F.col("page_number").cast("int").alias("page_number"), "explanation", *extra)


def question_quality(q: DataFrame) -> DataFrame:
    """Flags for the rules stated to the generator: type MCQ, 4 options, answer A-D."""
    bad = ~((F.col("type") == "MCQ") & (F.size("options") == 4) & F.col("correct_answer").isin(*LETTERS))
    return q.select("collection", "id", bad.alias("flagged"),
                    (F.col("type") == "MCQ").alias("type_ok"),
                    (F.size("options") == 4).alias("options_ok"),
                    F.col("correct_answer").isin(*LETTERS).alias("answer_ok"))


def quiz_metadata(questions: DataFrame, titles: DataFrame, tool: str = TOOL, rag: bool = False) -> DataFrame:
    """One row per collection of ``titles(collection, book_title)``: question count (0 allowed), title, tool."""
    counts = questions.groupBy("collection").agg(F.count(F.lit(1)).alias("total_questions"))
    m = titles.select("collection", "book_title").join(counts, "collection", "left").select(
        "collection", F.coalesce("total_questions", F.lit(0)).cast("int").alias("total_questions"),
        "book_title", F.lit(tool).alias("tool_used"))
    if rag:
        m = m.select("*", F.lit("retrieval").alias("generation_method"),
                     F.lit("hashed-bow-64").alias("embedding_model"), F.lit("parquet").alias("vectore_store"))
    return m
