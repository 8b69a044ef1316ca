"""Topic lists per collection (title + up to 10 topics) with the default extractive model.

Default (a stand-in, not a language model): TF-IDF over the collection's stored text.
Tokens of at least 4 characters; ``score = tf * ln((1 + N) / (1 + df))`` with ``N`` the number
of collections that have such a token; top 10 by ``(round(score, 6) desc, token)``. The title
is the first non-blank line of the collection's first stored page.

Scale: a collection's pages meet in one task before they are cut into tokens, so that texts are shuffled and
not a row a token; a store with a collection over ``WHOLE_PAGES`` pages counts by a partial + final
aggregate on ``(collection, token)`` instead. Document frequency is an aggregate of the counts; the top 10 per
collection is a ``row_number`` filter, planned as a partial top-k before the exchange. ``N`` is a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import TOKEN_SPLIT, not_blank, py_strip

MIN_TOKEN_CHARS = 4
MAX_TOPICS = 10
WHOLE_PAGES = 4096     # pages of a collection that one task may count


def term_frequencies(chunks: DataFrame, min_chars: int = MIN_TOKEN_CHARS) -> DataFrame:
    # no lambda in the explode, which would take it out of generated code; the empty pieces go with the short ones
    toks = chunks.select("collection", F.explode(F.split(F.lower("document"), TOKEN_SPLIT, -1)).alias("token"))
    return (toks.where(F.length("token") >= max(1, min_chars))
            .groupBy("collection", "token").agg(F.count(F.lit(1)).alias("tf")))


def titles(chunks: DataFrame, *more) -> DataFrame:
    """First non-blank line of the first stored page. The line is cut out per page before the
    aggregate, so only short strings (not page texts) are shuffled. ``more``: further aggregates."""
    line = F.get(F.filter(F.split("document", "\n", -1), lambda l: not_blank(l)), 0)
    firsts = chunks.select("collection", "page_number", py_strip(line).alias("line"))
    return firsts.groupBy("collection").agg(F.min_by("line", "page_number").alias("book_title"), *more)


def extract_topics(chunks: DataFrame, max_topics: int = MAX_TOPICS) -> DataFrame:
    """``collection, book_title, topic_rank, topic, tf, df, score, total_topics``."""
    from folio.session import discard, stored
    named = stored(titles(chunks, F.count(F.lit(1)).alias("n_pages")), "titles")
    texts = chunks.select("collection", "document")
    if (named.agg(F.max("n_pages")).first()[0] or 0) <= WHOLE_PAGES:
        texts = texts.repartition("collection")
    # term counts are read three times (scores, document frequencies, N); Catalyst plans
    # the three reads differently, so they would not share an exchange: computed once
    tf = stored(term_frequencies(texts), "tf")
    # one row a token, by its size broadcast to the counts; else read back it meets them behind an exchange
    # of its own, so that the skew join can split a token that very many documents hold
    dfs = stored(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "df")
    n = tf.select(F.count_distinct("collection")).scalar()
    scored = tf.join(dfs, "token").withColumn(
        "score", F.col("tf") * F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))))
    w = Window.partitionBy("collection").orderBy(F.round("score", 6).desc(), F.col("token"))
    top = scored.withColumn("topic_rank", F.row_number().over(w)).where(F.col("topic_rank") <= max_topics)
    top = top.withColumn("total_topics", F.count(F.lit(1)).over(Window.partitionBy("collection")))
    topics = stored(top.join(named.drop("n_pages"), "collection", "left").select(
        "collection", "book_title", F.col("topic_rank").cast("int").alias("topic_rank"),
        F.col("token").alias("topic"), "tf", "df", F.round("score", 6).alias("score"),
        F.col("total_topics").cast("int").alias("total_topics")), "topics")
    discard(named, tf, dfs)     # MAX_TOPICS rows a collection are all that goes on
    return topics


def topic_lists(topics: DataFrame) -> DataFrame:
    """One row per collection: ``book_title, total_topics, main_topics`` (topic order kept)."""
    return topics.groupBy("collection", "book_title", "total_topics").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("topic_rank", "topic"))), lambda x: x["topic"])
        .alias("main_topics"))


def topic_tasks(lists: DataFrame, n_questions: int) -> DataFrame:
    """Fan-out: one task row per topic (``posexplode``), numbered from 1."""
    return lists.select("collection", "book_title", F.posexplode("main_topics").alias("pos", "topic")).select(
        "collection", (F.col("pos") + 1).cast("int").alias("topic_pos"), "topic",
        F.lit(n_questions).alias("n_questions"))
