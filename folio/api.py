"""End-to-end functions (what a user calls), composed from the operators.

    ingest(spark, documents, store)            -> counts; pages appended to the store
    ingest_files(spark, files, store, registry)-> counts and rejects; files by name, through an extractor
    retrieve(questions, chunks, k, metric)     -> top-k pages per question with confidence
    generate_level_1(chunks)                   -> (questions, metadata, quarantine)
    generate_level_2(chunks)                   -> (questions with source, metadata, quarantine)
    chat(spark, questions, chunks)             -> answers with their documents, rejects with their error
    build_instruction_set(open_rows, mcq_rows) -> (instruction rows (optionally saved), quarantine)
    reset(spark, store)                        -> empty store

``embedder`` takes a text column to a vector column (:func:`folio.operators.chunks.model_embedder`);
``generator`` is a factory of ``prompts -> answers`` functions, called once per partition
(:func:`folio.operators.generate.batch_generate`). Without them the built-in stand-ins work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import prompts as _prompts
from folio.functions.text import collection_name
from folio.operators import chat as _chat
from folio.operators import chunks as _chunks
from folio.operators import generate as _generate
from folio.operators import ingest as _ingest
from folio.operators import instruct as _instruct
from folio.operators import journal as _ask
from folio.operators import questions as _questions
from folio.operators import topic_tree as _tree
from folio.operators import topics as _topics
from folio.operators.pages import ordered_concat, rejected_documents, split_pages


def ingest(spark: SparkSession, documents: DataFrame, store: str, embedder=None) -> dict:
    """``documents(doc_id, text)`` -> pages -> non-blank -> not yet stored -> embedded -> appended.
    Returns ``added`` and ``failed`` pages and ``rejected`` documents (without a text)."""
    counts = _chunks.ingest_pages(spark, split_pages(documents, keep=()), store, embedder)
    return counts | {"rejected": rejected_documents(documents).count()}


def ingest_files(spark: SparkSession, files: DataFrame, store: str, registry: str, ext: str = ".html",
                 extractor=None, embedder=None) -> tuple[dict, DataFrame]:
    """``files(name, content)`` -> supported -> new by name -> pages -> chunks -> store.

    ``registry`` is a Parquet table of the names ingested so far; the new names are added to it
    after the store is written. Returns counts and ``(name, reason)`` of what was left out."""
    from folio.session import materialize
    from folio.sources.files import extract_pages
    checked = _ingest.filter_supported(files.select("name", "content"), "name", ext)
    known = spark.read.parquet(registry) if _chunks.path_exists(spark, registry) else spark.createDataFrame([], "name string")
    named = checked.where("supported").select("name", "content", collection_name(F.col("name")).alias("collection"))
    fresh = _ingest.new_files(named, known, "name", "content")
    pages = materialize(extract_pages(fresh, "name", "content", extractor, keep=("collection",)), "pages")
    counts = _chunks.ingest_pages(spark, pages.where("error IS NULL"), store, embedder)
    done = pages.where("error IS NULL").select(F.col("source_id").alias("name")).distinct()
    rejected = checked.where("NOT supported").select("name", "reason").unionByName(
        pages.where("error IS NOT NULL").select(F.col("source_id").alias("name"), F.col("error").alias("reason")))
    rejected = materialize(rejected, "rejected")
    done.write.mode("append").parquet(registry)
    return counts, rejected


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 5, metric: str = "cosine",
             qid: str = "qid", text_col: str = "question", embedder=None) -> DataFrame:
    c = chunks if "doc_id" in chunks.columns else chunks.withColumn("doc_id", F.lit(0).cast("bigint"))
    hits = _chat.retrieve_for_questions(questions, c, k=k, qid=F.col(qid), metric=metric, text_col=text_col, embedder=embedder)
    return hits.withColumnRenamed("qid", qid)


def _titles(chunks: DataFrame) -> DataFrame:
    return _topics.titles(chunks)


def _journal(chunks: DataFrame, journal: str | None) -> str:
    """The journal's folder: the caller's, which later runs go on with, or a new one in the shared checkpoint folder."""
    from folio.session import scratch_path
    return journal or scratch_path(chunks.sparkSession, f"journal-{uuid.uuid4().hex}")


def _generated(tasks: DataFrame, texts: DataFrame, generator, n: int, journal: str, expand=None) -> tuple[DataFrame, DataFrame]:
    """Questions of the stored ``tasks(collection, topic, topic_rank, context_id, ...)`` about their ``texts(context_id, context, context_sha)`` (or rows
    that ``expand`` makes into them) from a generator: ask -> parse -> the first ``n`` of each task in the answer's order, numbered by ``question_pos``.
    What fails, and questions beyond the ``n``-th, are in ``quarantine(collection, reason)``. The answers are kept; what of them
    is wanted is parsed where it is read."""
    from folio.session import discard, stored
    keyed = tasks.withColumn("prompt_id", F.sha2(F.concat_ws("|", "collection", "topic"), 256))
    before, after = _prompts.split_render(_prompts.QUESTION_TEMPLATE, "context", n=F.lit(n), topic=F.col("topic"))
    asks = keyed.select("context_id", "prompt_id", before.alias("before"), after.alias("after"))
    own = keyed.drop("context_id").withColumnRenamed("topic", "asked_topic")
    answers = _ask.ask(texts, asks, generator, journal, expand=expand)
    made = stored(answers.join(own, "prompt_id"), "generated")
    discard(answers)
    # answers meet by their collection before they are parsed: their questions, which are many times as large, go through no shuffle
    raw = made.where("error IS NULL").withColumnRenamed("response", "json").drop("error").repartition("collection")
    good, bad = _generate.parse_questions(raw, keys=("prompt_id",), positions=True, carry=tuple(c for c in own.columns if c != "prompt_id"))
    placed = good.withColumn("question_pos", F.row_number().over(Window.partitionBy("collection", "prompt_id").orderBy("item_pos"))).drop("item_pos")
    reasons = bad.select("collection", "reason").unionByName(made.where("error IS NOT NULL").select("collection", F.col("error").alias("reason"))).unionByName(
        placed.where(F.col("question_pos") > n).select("collection", F.lit(f"more than {n} questions").alias("reason")))
    return placed.where(F.col("question_pos") <= n).drop("prompt_id"), reasons


def _model_topics(chunks: DataFrame, generator, journal: str, max_chars: int, topics_from: str):
    """``(topics, titles, pieces, quarantine)``: titles and topics by the generator (:mod:`folio.operators.topic_tree`), or, from
    "terms", by the built-in weights of terms."""
    from folio.session import stored
    if topics_from == "generator":
        lists, pieces, bad = _tree.topic_lists(chunks, generator, journal, max_chars)
        topics, over = _tree.topic_rows(lists)
        return stored(topics, "model_topics"), lists, pieces, bad.unionByName(over)
    if topics_from != "terms":
        raise ValueError(f"topics come from the generator or from terms, not from {topics_from}")
    topics = _topics.extract_topics(chunks)
    without = chunks.select("collection").distinct().join(topics.select("collection"), "collection", "left_anti").select("collection", F.lit("no topics").alias("reason"))
    return topics, _titles(chunks), stored(_tree.pieces_of(chunks, max_chars), "pieces"), without


def generate_level_1(chunks: DataFrame, n: int = _questions.N_LEVEL_1, generator=None, journal: str | None = None,
                     max_chars: int = _tree.MAX_CHARS, topics_from: str = "generator", tool: str = "generator"):
    """``(questions, metadata, quarantine)``: ``n`` questions a topic about the whole document.

    With a ``generator`` title and topics come from it too, through prompts of at most ``max_chars`` of text
    (``topics_from="terms"``: from the built-in weights); a topic's questions are asked about the whole text if that
    fits, else about the piece that names the topic most often. ``journal``: a folder that keeps the answers, so that a
    later call asks only for what is missing. ``quarantine(collection, reason)`` has what failed, questions beyond the
    ``n``-th and collections without topics."""
    if generator is None:
        q, quarantine = _questions.generate_level_1(chunks, _topics.extract_topics(chunks), n)
        return q, _questions.quiz_metadata(q, _titles(chunks)), quarantine
    from folio.session import stored
    path = _journal(chunks, journal)
    topics, titles, pieces, rejected = _model_topics(chunks, generator, path, max_chars, topics_from)
    context_id = F.concat_ws(":", "collection", "block", "sub")
    tasks = topics.select("collection", "topic", "topic_rank").join(_tree.topic_pieces(topics, pieces), ["collection", "topic"])
    q, bad = _generated(stored(tasks.select("collection", "topic", "topic_rank", context_id.alias("context_id")), "tasks"),
                        pieces.select(context_id.alias("context_id"), F.col("text").alias("context"), "context_sha"), generator, n, path)
    return q, _questions.quiz_metadata(q, titles, tool), rejected.unionByName(bad)


def generate_level_2(chunks: DataFrame, n: int = _questions.N_LEVEL_2, generator=None, embedder=None, journal: str | None = None,
                     max_chars: int = _tree.MAX_CHARS, topics_from: str = "generator", tool: str = "generator", k: int = 1):
    """``(questions with source, metadata, quarantine)``: ``n`` questions a topic about its best page, or with a ``generator``
    about its ``k`` best pages in their order; the other parameters are those of level 1."""
    from folio.session import discard, stored
    if generator is None:
        if k != 1:
            raise ValueError("the built-in questions are about the best page: k is for a generator")
        topics = _topics.extract_topics(chunks)
    else:
        path = _journal(chunks, journal)
        topics, titles, pieces, rejected = _model_topics(chunks, generator, path, max_chars, topics_from)
        discard(pieces)
    tq = topics.select("collection", "topic", "topic_rank", F.concat_ws("|", "collection", "topic").alias("qid"))
    c = chunks if "doc_id" in chunks.columns else chunks.withColumn("doc_id", F.lit(0).cast("bigint"))
    hits = _chat.hits_for_questions(tq, c, k=k, qid=F.col("qid"), text_col="topic", embedder=embedder).join(tq, ["qid", "collection"])
    if generator is None:
        best = _chat.with_documents(_questions.with_topics(hits, topics), c)
        q, quarantine = _questions.generate_level_2(best.select("collection", "topic", "topics", "page_number", "document", "confidence"), topics, chunks, n)
        return q, _questions.quiz_metadata(q, _titles(chunks), rag=True), quarantine
    # a collection's topics meet its pages in one row, so that no page is kept or shuffled once a topic: contexts and sources are put
    # together from that row, the topics of a collection side by side
    hits = stored(hits.select("collection", "topic", "topic_rank", "qid", "rank", "chunk_id", "page_number", "confidence"), "hits")
    asked = hits.groupBy("collection").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "collection"])).alias("hits"))    # k a topic
    pages = c.join(hits.select("collection", "chunk_id").distinct(), ["collection", "chunk_id"], "left_semi").groupBy("collection").agg(
        F.collect_list(F.struct("chunk_id", "document")).alias("pages"))    # those of its topics
    met = stored(asked.join(pages, "collection"), "topic_pages")

    def source(refs, pages):
        rows = F.array_sort(F.flatten(F.transform(refs, lambda h: F.transform(F.filter(pages, lambda p: p["chunk_id"] == h["chunk_id"]), lambda p: F.struct(
            h["rank"].alias("rank"), p["document"].alias("document"), F.struct(h["page_number"].cast("string").alias("page_number")).alias("metadata"), h["confidence"].alias("confidence"))))))
        return F.transform(rows, lambda x: F.struct(x["document"].alias("document"), x["metadata"].alias("metadata"), x["confidence"].alias("confidence"))).cast(_chat.SEGMENTS)

    topic = F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(h["qid"].alias("qid"), h["topic"].alias("topic"), h["topic_rank"].alias("topic_rank")))))
    of_topic = F.filter("hits", lambda h: (h["qid"] == F.col("t.qid")) & (h["topic_rank"] == F.col("t.topic_rank")))
    tasks = stored(met.select("collection", "hits", topic.alias("t")).select("collection", "t.topic", "t.topic_rank", F.col("t.qid").alias("context_id"), F.transform(
        of_topic, lambda h: F.struct(h["rank"].alias("rank"), h["chunk_id"].alias("chunk_id"), h["page_number"].alias("page_number"), h["confidence"].alias("confidence"))).alias("refs")), "tasks")

    def texts(met: DataFrame, *carry: str) -> DataFrame:
        t = met.select("near", "hits", "pages", *carry, topic.alias("t")).select("near", *carry, F.col("t.qid").alias("context_id"), source(of_topic, F.col("pages")).alias("source"))
        t = t.select("near", "context_id", *carry, F.array_join(F.transform("source", lambda x: _chat.context_line(x["document"], x["metadata"]["page_number"])), "").alias("context"))
        return t.withColumn("context_sha", F.sha2("context", 256))

    q, bad = _generated(tasks, met.withColumnRenamed("collection", "near"), generator, n, path, texts)
    q = q.join(met.select("collection", "pages"), "collection").withColumn("source", source(F.col("refs"), F.col("pages"))).drop("refs", "pages")
    without = tq.join(tasks.select(F.col("context_id").alias("qid")), "qid", "left_anti").select("collection", F.concat(F.lit("no page for topic: "), "topic").alias("reason"))
    discard(hits)
    return q, _questions.quiz_metadata(q, titles, tool, rag=True), rejected.unionByName(without).unionByName(bad)


def chat(spark: SparkSession, questions: DataFrame, chunks: DataFrame, k: int = _chat.CHAT_K,
         qid: str = "qid", embedder=None, generator=None) -> DataFrame:
    """``questions(qid, collection, question)`` -> ``qid, question, answer, documents, error, generated_at``.

    Every question comes back: those that fail the request checks with their ``error`` and neither
    answer nor documents, greetings answered directly (and not searched for), the others from one
    retrieval. A generator's answer that fails or does not parse leaves ``error`` set."""
    from folio.session import materialize
    checked = _chat.validate_requests(questions.withColumnRenamed(qid, "__qid")).select("__qid", "collection", "question", "error")
    routed = _chat.route_greetings(spark, checked.where(F.col("error").isNull()).drop("error"))
    asked = routed.where(~F.col("is_greeting")).select("__qid", "collection", "question")
    r = materialize(retrieve(asked, chunks, k=k, qid="__qid", embedder=embedder), "retrieved")
    segs = _chat.segments(r, ("__qid",))
    if generator is None:
        ans = _chat.extractive_answer(r, asked, "__qid").select("__qid", "answer", F.lit(None).cast("string").alias("problem"))
    else:
        context = r.groupBy("__qid").agg(ordered_concat(F.col("rank"), _chat.context_line(F.col("document"), F.col("page_number"))).alias("context"))
        prompt = _prompts.render(_prompts.CHAT_TEMPLATE, question=F.col("question"), context=F.coalesce("context", F.lit("")))
        prompts = asked.join(context, "__qid", "left").select(F.col("__qid").cast("string").alias("prompt_id"), prompt.alias("prompt"))
        made = materialize(_generate.batch_generate(prompts, generator), "generated")
        good, bad = _generate.parse_chat(made.where("error IS NULL").select("prompt_id", F.col("response").alias("json")), keys=("prompt_id",))
        ans = good.select("prompt_id", "answer", F.lit(None).cast("string").alias("problem")).unionByName(
            bad.select("prompt_id", F.lit(None).cast("string").alias("answer"), F.col("reason").alias("problem"))).unionByName(
            made.where("error IS NOT NULL").select("prompt_id", F.lit(None).cast("string").alias("answer"), F.col("error").alias("problem")))
        ans = asked.select("__qid", F.col("__qid").cast("string").alias("prompt_id")).join(ans, "prompt_id").drop("prompt_id")
    none = F.array().cast(_chat.SEGMENTS)
    full = routed.join(ans, "__qid", "left").join(segs, "__qid", "left").select(
        "__qid", "question", F.when(F.col("is_greeting"), F.col("reply")).when(F.col("problem").isNull(), F.coalesce("answer", F.lit(_chat.NO_ANSWER))).alias("answer"),
        F.coalesce("segments", none).alias("documents"), F.col("problem").alias("error"))
    refused = checked.where(F.col("error").isNotNull()).select("__qid", "question", F.lit(None).cast("string").alias("answer"), none.alias("documents"), "error")
    return full.unionByName(refused).withColumn("generated_at", F.current_timestamp()).withColumnRenamed("__qid", qid)


def build_instruction_set(open_rows: DataFrame | None, mcq_rows: DataFrame | None,
                          output_path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(rows, quarantine)``: the instruction rows of both sets, and ``id, reason`` of open rows without an answer
    (None without open rows)."""
    sets, quarantine = [], None
    if mcq_rows is not None:
        sets.append(_instruct.instruct_mcq(mcq_rows))
    if open_rows is not None:
        good, quarantine = _instruct.instruct_open(open_rows)
        sets.append(good)
    return _instruct.merge(sets, output_path), quarantine


def reset(spark: SparkSession, store: str) -> None:
    _chunks.reset(spark, store)
