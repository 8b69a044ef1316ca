"""Query keys: ``(spark, sf_dir) -> DataFrame`` for every operator of the inventory.

Each key reads the driver tables (or what Spark derives from them) in full. Computed
columns carry the same names as their SQL twins in :mod:`folio.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import chat, chunks, pages, retrieve
from folio.plans import fixtures as fx
from folio.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- minimum slice

@query("page_split")
def q_page_split(spark, sf):
    return fx.doc_pages(spark, sf).select("collection", "doc_id", "page_number", "text")


@query("embed_pages")
def q_embed_pages(spark, sf):
    return chunks.embed_stats(fx.doc_pages(spark, sf))


@query("retrieve_topk")
def q_retrieve_topk(spark, sf):
    """Every vector's 5 nearest other vectors of the same label (cosine)."""
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    q = v.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"),
                 F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    c = v.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"),
                 F.col("vec_id").alias("cid"), F.lit(0).alias("tie1"), F.col("vec_id").alias("tie2"),
                 F.col("embedding").alias("vec"))
    top = retrieve.knn(q, c, retrieve.KnnConfig(k=5, exclude_self=True))
    return top.select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"),
                      "confidence", F.round("distance", 6).alias("distance"))


def _chat_retrieved(spark, sf, k: int = chat.CHAT_K) -> DataFrame:
    qs = fx.user_questions(spark, sf)
    qid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    r = chat.retrieve_for_questions(qs, fx.source_corpus(spark, sf), k=k, qid=qid)
    keys = qs.select(qid.alias("qid"), "conv_id", "turn")
    return r.join(keys, "qid")


@query("chat_retrieve")
def q_chat_retrieve(spark, sf):
    r = _chat_retrieved(spark, sf)
    return r.select("conv_id", "turn", "collection", "rank", "chunk_id", "doc_id", "page_number",
                    "confidence", F.round("distance", 6).alias("distance"))


@query("chat_context")
def q_chat_context(spark, sf):
    return chat.chat_context(_chat_retrieved(spark, sf), keys=("conv_id", "turn"))


# ---------------------------------------------------------------- ingest rules, scans, page lookups

from folio.functions.text import collection_name as collection_name_expr  # noqa: E402
from folio.functions.text import has_extension  # noqa: E402
from folio.operators import ingest  # noqa: E402

SUPPORTED_EXT = ".html"


def _files(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", "url", collection_name_expr(F.col("url")).alias("collection"))


@query("collection_name")
def q_collection_name(spark, sf):
    return _files(spark, sf)


@query("filter_supported")
def q_filter_supported(spark, sf):
    return ingest.filter_supported(read_table(spark, sf, "pages", "page_id", "url"), "url", SUPPORTED_EXT)


@query("nonblank_pages")
def q_nonblank_pages(spark, sf):
    return pages.nonblank(fx.doc_pages(spark, sf)).select("collection", "page_number", "text")


def _registry_ids(spark, sf):
    """Ids already ingested by an earlier run: the labelled ones."""
    return read_table(spark, sf, "labels", "doc_id")


@query("new_files")
def q_new_files(spark, sf):
    files = _files(spark, sf)
    registry = files.join(_registry_ids(spark, sf).withColumnRenamed("doc_id", "page_id"), "page_id", "left_semi")
    return ingest.new_files(files, registry)


@query("name_collisions")
def q_name_collisions(spark, sf):
    """Names that map to one collection; the scheme is cut off, so that some do."""
    files = read_table(spark, sf, "pages", "page_id", "url")
    name = F.regexp_replace("url", r"[?#].*$", "")
    return ingest.name_collisions(files.select("url", collection_name_expr(F.regexp_replace(name, r"[0-9]+", "")).alias("collection")))


@query("rejected_documents")
def q_rejected_documents(spark, sf):
    """Documents without a text: those of even id lose theirs here."""
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return pages.rejected_documents(d.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.col("text"))))


def _stored_before(spark, sf):
    """Store of an earlier run: the first two pages of every labelled document."""
    c = fx.doc_chunks(spark, sf)
    return c.join(_registry_ids(spark, sf), "doc_id", "left_semi").where(F.col("page_number") <= 2)


@query("new_chunks")
def q_new_chunks(spark, sf):
    offered = fx.doc_chunks(spark, sf)
    return chunks.new_chunks(offered, _stored_before(spark, sf)).select(
        "collection", "chunk_id", "page_number", "document")


@query("ingest_stats")
def q_ingest_stats(spark, sf):
    return ingest.ingest_stats(fx.doc_pages(spark, sf), _stored_before(spark, sf))


@query("ingest_append")
def q_ingest_append(spark, sf):
    """Ingest every document twice into a fresh store; the second run adds nothing."""
    from folio.session import scratch_path
    import uuid
    path = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    offered = fx.doc_pages(spark, sf)
    first = chunks.ingest_pages(spark, offered, path)
    second = chunks.ingest_pages(spark, offered, path)
    if second["added"] != 0:
        raise AssertionError(f"re-ingest added {second['added']} rows")
    return chunks.read_store(spark, path).select("collection", "chunk_id", "page_number").withColumn(
        "added_first_run", F.lit(first["added"]).cast("bigint"))


@query("reset")
def q_reset(spark, sf):
    from folio.session import scratch_path
    import uuid
    path = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    before = chunks.ingest_pages(spark, fx.doc_pages(spark, sf), path)["added"]
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")       # must not matter
    try:
        chunks.reset(spark, path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    return chunks.read_store(spark, path).agg(F.lit(before).cast("bigint").alias("chunks_before"), F.count(F.lit(1)).alias("chunks_after"))


@query("resolve_collections")
def q_resolve_collections(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("collection"))
    requests = docs.unionByName(_files(spark, sf).select("collection"))
    return ingest.resolve_collections(requests, fx.doc_chunks(spark, sf))


@query("scan_collection")
def q_scan_collection(spark, sf):
    """The labelled documents' collections read from a store of all documents."""
    from folio.session import scratch_path
    import uuid
    path = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    chunks.ingest_pages(spark, fx.doc_pages(spark, sf), path)
    wanted = _registry_ids(spark, sf).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("collection"))
    return chunks.scan_collections(spark, path, wanted).select("collection", "chunk_id", "page_number", "document")


@query("collection_text")
def q_collection_text(spark, sf):
    return pages.collection_text(fx.doc_chunks(spark, sf))


@query("full_text")
def q_full_text(spark, sf):
    ft = pages.document_full_text(fx.documents(spark, sf))
    return ft.select("collection", "n_pages", F.length("full_text").cast("int").alias("length"),
                     F.md5("full_text").alias("text_md5"))


@query("text_with_fallback")
def q_text_with_fallback(spark, sf):
    """In-memory full text where this session has it (labelled documents), else the store's."""
    memory = (pages.document_full_text(fx.documents(spark, sf).join(_registry_ids(spark, sf), "doc_id", "left_semi"))
              .select("collection", F.col("full_text").alias("memory_text")))
    stored = pages.collection_text(fx.doc_chunks(spark, sf)).select("collection", F.col("text").alias("store_text"))
    t = ingest.text_with_fallback(stored, memory)
    return t.select("collection", "origin", F.length("text").cast("int").alias("length"), F.md5("text").alias("text_md5"))


@query("page_counts")
def q_page_counts(spark, sf):
    return pages.page_counts(fx.documents(spark, sf))


def _page_requests(spark, sf):
    """One lookup per document: page ``doc_id mod 7`` (0 and past-the-end are rejected), every third one twice."""
    d = read_table(spark, sf, "documents", "doc_id")
    d = d.union(d.where("doc_id % 3 = 0"))
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("collection"),
                    F.pmod(F.col("doc_id"), F.lit(7)).cast("int").alias("page_number"))


@query("single_page")
def q_single_page(spark, sf):
    return pages.single_page(_page_requests(spark, sf), fx.doc_pages(spark, sf),
                             pages.page_counts(fx.documents(spark, sf)))


@query("page_interval")
def q_page_interval(spark, sf):
    return pages.page_interval(_page_requests(spark, sf), fx.doc_pages(spark, sf),
                               pages.page_counts(fx.documents(spark, sf)), k=1)


@query("page_interval_wide")
def q_page_interval_wide(spark, sf):
    """Up to 500 pages on both sides, by their length and hash."""
    got = pages.page_interval(_page_requests(spark, sf), fx.doc_pages(spark, sf), pages.page_counts(fx.documents(spark, sf)), k=500)
    return got.select("collection", "page_number", "status", "reason", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


@query("page_window")
def q_page_window(spark, sf):
    return pages.page_window(fx.doc_pages(spark, sf), k=1)


@query("scan_files")
def q_scan_files(spark, sf):
    from folio.sources.digests import content_md5
    from folio.sources.files import scan_files
    return content_md5(scan_files(spark, sf, "*.parquet")).select("name", "length", "status", "content_md5")


@query("ingest_files")
def q_ingest_files(spark, sf):
    """Files end to end (``url`` as name, ``html`` as content): extension, new names, extraction,
    collections, chunks, store; the second run finds every name known."""
    from folio import api
    from folio.session import scratch_path
    import uuid
    base = scratch_path(spark, f"files-{uuid.uuid4().hex}")
    files = read_table(spark, sf, "pages", "url", "html").select(F.col("url").alias("name"), F.col("html").alias("content"))
    api.ingest_files(spark, files, f"{base}/store", f"{base}/registry")
    again, _ = api.ingest_files(spark, files, f"{base}/store", f"{base}/registry")
    if again["added"]:
        raise AssertionError(f"the second run added {again['added']} pages")
    return chunks.read_store(spark, f"{base}/store").select("collection", "chunk_id", "page_number")


@query("extract_pages")
def q_extract_pages(spark, sf):
    from folio.sources.files import extract_html_pages
    p = read_table(spark, sf, "pages", "page_id", "url", "html")
    return extract_html_pages(p)


@query("extract_pages_sql")
def q_extract_pages_sql(spark, sf):
    """The extractor as a table function in SQL."""
    from folio.sources.files import register_pages_function
    register_pages_function(spark)
    p = read_table(spark, sf, "pages", "page_id", "url", "html")
    return spark.sql("SELECT CAST(f.page_id AS STRING) AS source_id, p.page_number, p.text, p.error, f.collection FROM {files} f, LATERAL html_pages(f.html) p",
                     files=p.select("page_id", "html", collection_name_expr(F.col("url")).alias("collection")))


@query("stream_files")
def q_stream_files(spark, sf):
    """HTML files arrive in several micro-batches and go through the extractor into the store; then the stream starts
    again with its checkpoint lost: every name is known and nothing is added. A file holds some fifty pages of the table."""
    from folio.session import scratch_path
    from folio.streaming.ingest import stream_files
    import uuid
    base = scratch_path(spark, f"stream-files-{uuid.uuid4().hex}")
    p = read_table(spark, sf, "pages", "page_id", "html", spread=False)
    named = p.select(F.concat(F.lit("set_"), F.expr("page_id div 50").cast("string"), F.lit(".html")).alias("file"), "page_id", F.col("html").alias("value"))
    n = named.select("file").distinct().count()
    named.repartition(max(1, min(n, 200)), "file").sortWithinPartitions("file", "page_id").drop("page_id").write.partitionBy("file").text(f"{base}/in")
    name = F.regexp_extract("path", "/file=([^/]+)/", 1)
    run = lambda at: stream_files(spark, f"{base}/in", "part-*", f"{base}/store", f"{base}/registry", f"{base}/{at}", max_files=-(-n // 3), name=name)
    first, replay = run("checkpoint"), run("checkpoint-2")
    if first["batches"] < min(n, 2) or replay["added"] != 0:
        raise AssertionError(f"first run {first}, replay {replay}")
    return chunks.read_store(spark, f"{base}/store").select("collection", "chunk_id", "page_number", F.md5("document").alias("text_md5"))


# ---------------------------------------------------------------- topics and questions

from folio.operators import questions as qn  # noqa: E402
from folio.operators import topics as tp  # noqa: E402


def _topics(spark, sf):
    return tp.extract_topics(fx.doc_chunks(spark, sf))


@query("extract_topics")
def q_extract_topics(spark, sf):
    return _topics(spark, sf)


@query("topic_tasks")
def q_topic_tasks(spark, sf):
    return tp.topic_tasks(tp.topic_lists(_topics(spark, sf)), qn.N_LEVEL_1)


def _level_1(spark, sf):
    return qn.generate_level_1(fx.doc_chunks(spark, sf), _topics(spark, sf))


def _titles(spark, sf):
    return tp.titles(fx.doc_chunks(spark, sf))


@query("generate_level_1")
def q_generate_level_1(spark, sf):
    return qn.flat_questions(_level_1(spark, sf)[0])


def _topic_pages(spark, sf, topics: DataFrame) -> DataFrame:
    """Best page (top 1) of each topic in its own collection; a topic is its own key there."""
    ch = fx.doc_chunks(spark, sf).withColumn("doc_id", F.lit(0).cast("bigint"))
    hits = chat.hits_for_questions(topics.select("collection", "topic"), ch, k=1, qid=F.col("topic"), text_col="topic")
    r = chat.with_documents(qn.with_topics(hits, topics), ch)
    return r.select("collection", F.col("qid").alias("topic"), "topics", "page_number", "document", "confidence")


def _level_2(spark, sf):
    t = _topics(spark, sf)
    return qn.generate_level_2(_topic_pages(spark, sf, t), t, fx.doc_chunks(spark, sf))


@query("generate_level_2")
def q_generate_level_2(spark, sf):
    return qn.flat_questions(_level_2(spark, sf)[0], extra=("source_confidence",))


@query("question_sources")
def q_question_sources(spark, sf):
    """The ``source`` array of every level 2 question."""
    q = _level_2(spark, sf)[0].select("collection", "topic", "question_pos", F.explode("source").alias("s"))
    return q.select("collection", "topic", F.col("question_pos").cast("int").alias("question_pos"), "s.document",
                    F.col("s.metadata.page_number").alias("page_number"), "s.confidence")


@query("quiz_metadata_l1")
def q_quiz_metadata_l1(spark, sf):
    return qn.quiz_metadata(_level_1(spark, sf)[0], _titles(spark, sf))


@query("quiz_metadata_l2")
def q_quiz_metadata_l2(spark, sf):
    return qn.quiz_metadata(_level_2(spark, sf)[0], _titles(spark, sf), rag=True)


@query("question_quality")
def q_question_quality(spark, sf):
    qq = qn.question_quality(_level_1(spark, sf)[0])
    return qq.groupBy("collection").agg(F.count(F.lit(1)).alias("n_questions"),
                                        F.sum(F.col("flagged").cast("int")).cast("bigint").alias("n_flagged"))


@query("quiz_quarantine")
def q_quiz_quarantine(spark, sf):
    return _level_1(spark, sf)[1]


# ---------------------------------------------------------------- prompts, generation hook, JSON parsing

from folio.functions import prompts as pr  # noqa: E402
from folio.operators import generate as gen  # noqa: E402


def _collection_texts(spark, sf):
    return pages.collection_text(fx.doc_chunks(spark, sf)).select("collection", F.col("text").alias("context"))


@query("prompt_mcq")
def q_prompt_mcq(spark, sf):
    t = _topics(spark, sf).select("collection", "topic").join(_collection_texts(spark, sf), "collection")
    p = pr.render(pr.QUESTION_TEMPLATE, n=F.lit(qn.N_LEVEL_1), topic=F.col("topic"), context=F.col("context"))
    return t.select("collection", "topic", F.md5(p).alias("prompt_md5"), F.length(p).cast("int").alias("prompt_length"))


@query("prompt_topics")
def q_prompt_topics(spark, sf):
    p = pr.render(pr.TOPICS_TEMPLATE, context=F.col("context"))
    return _collection_texts(spark, sf).select("collection", F.md5(p).alias("prompt_md5"),
                                               F.length(p).cast("int").alias("prompt_length"))


def _chat_prompts(spark, sf):
    ctx = chat.chat_context(_chat_retrieved(spark, sf), keys=("conv_id", "turn"))
    qs = fx.user_questions(spark, sf)
    j = qs.join(ctx, ["conv_id", "turn"], "left")
    p = pr.render(pr.CHAT_TEMPLATE, question=F.col("question"), context=F.coalesce(F.col("context"), F.lit("")))
    return j.select("conv_id", "turn", p.alias("prompt"))


@query("prompt_chat")
def q_prompt_chat(spark, sf):
    return _chat_prompts(spark, sf).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"),
                                            F.length("prompt").cast("int").alias("prompt_length"))


def _offline_chat_generator():
    """Stand-in client: answers with the first context line. Deterministic, no network."""
    import json

    def fn(prompts):
        out = []
        for p in prompts:
            q = p.split("Question: ", 1)[1].split("\n", 1)[0] if "Question: " in p else ""
            ctx = p.split("Context:\n", 1)[1] if "Context:\n" in p else ""
            out.append(json.dumps({"question": q, "answer": ctx.split("\n", 1)[0]}, ensure_ascii=False))
        return out
    return fn


@query("batch_generate")
def q_batch_generate(spark, sf):
    p = _chat_prompts(spark, sf).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), "prompt")
    return gen.batch_generate(p, _offline_chat_generator)


def _offline_quiz_generator():
    """Stand-in client for quizzes: topics are the first ten different words of six letters or more, a merge takes them in
    the order of its lists, and a topic gets one question more than asked for. Deterministic, no network."""
    import json
    import re

    def topics(text):
        return list(dict.fromkeys(w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= 6))[:10]

    def fn(prompts):
        out = []
        for p in prompts:
            context = p.split("<<<\n", 1)[1].rsplit("\n>>>", 1)[0]
            if p.startswith("Read the book text"):
                found = topics(context)
                out.append(json.dumps({"book_title": "Book of " + (found or ["nothing"])[0], "total_topics": len(found), "main_topics": found}))
            elif p.startswith("The lines between"):
                lists = [x[len("Topics: "):].split("; ") for x in context.split("\n") if x.startswith("Topics: ")]
                found = list(dict.fromkeys(t for x in lists for t in x if t))[:10]
                out.append(json.dumps({"book_title": "Book of " + (found or ["nothing"])[0], "total_topics": len(found), "main_topics": found}))
            else:
                n, topic = re.match(r'Write (\d+) multiple-choice questions about the topic "(.*)", using', p).groups()
                named = topic in context.lower()
                out.append(json.dumps({"questions": [
                    {"topic": topic, "type": "MCQ", "question": f"{i}. Is {topic} named? {named}", "options": ["yes", "no", "both", "none"], "correct_answer": "A",
                     "page_number": i, "explanation": f"Page {i}"} for i in range(1, int(n) + 2)]}))
        return out
    return fn


MODEL_CHARS = 6000      # of text in a prompt; longer documents are read in pieces


def _model_level_1(spark, sf):
    from folio import api
    return api.generate_level_1(fx.doc_chunks(spark, sf), generator=_offline_quiz_generator, max_chars=MODEL_CHARS)


@query("generate_level_1_model")
def q_generate_level_1_model(spark, sf):
    """Level 1 with title, topics and questions from a generator (the deterministic stand-in)."""
    q, _, _ = _model_level_1(spark, sf)
    return q.select("collection", "topic_rank", "topic", "question_pos", "question", "page_number")


@query("generate_level_2_model")
def q_generate_level_2_model(spark, sf):
    """Level 2 with a generator that is asked about each topic's three best pages."""
    from folio import api
    q, _, _ = api.generate_level_2(fx.doc_chunks(spark, sf), generator=_offline_quiz_generator, max_chars=MODEL_CHARS, k=3)
    return q.select("collection", "topic", "question_pos", F.size("source").alias("n_pages"), F.col("source")[0]["metadata"]["page_number"].alias("best_page"),
                    F.col("source")[0]["confidence"].alias("confidence"))


@query("quiz_quarantine_model")
def q_quiz_quarantine_model(spark, sf):
    """What the generator's level 1 leaves out, counted: questions beyond the fifth, documents without topics."""
    _, _, bad = _model_level_1(spark, sf)
    return bad.groupBy("collection", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("export_questions_model")
def q_export_questions_model(spark, sf):
    """The generator's level 1 exported and read back, with its metadata."""
    from folio.session import discard, scratch_path, stored
    from folio.sinks import RESULT_SCHEMA, export_questions
    import uuid
    path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    q, meta, _ = _model_level_1(spark, sf)
    q = stored(q, "questions")
    export_questions(q, qn.quiz_metadata(q, meta.select("collection", "book_title"), "generator"), path, compression="gzip")
    discard(q)
    r = spark.read.schema(RESULT_SCHEMA).json(path)
    return r.select("collection", F.col("metadata.book_title").alias("book_title"), F.col("metadata.total_questions").alias("total_questions"),
                    F.posexplode_outer("questions").alias("pos", "q")).select("collection", "book_title", "total_questions", "pos", "q.topic", "q.question")


@query("collection_pieces")
def q_collection_pieces(spark, sf):
    """Collection texts in pieces of at most 6,000 characters, counted from 1 and put together again by their lengths."""
    p = pages.collection_pieces(fx.doc_chunks(spark, sf), MODEL_CHARS)
    if p.where(F.length("text") > MODEL_CHARS).count():
        raise AssertionError("a piece is longer than it may be")
    first = F.min(F.struct("block", "sub", "glue"))["glue"]
    return p.groupBy("collection").agg((F.sum(F.length("text") + F.length("glue")) - F.length(first)).cast("bigint").alias("length"),
                                       F.md5(F.concat_ws("", F.expr("transform(array_sort(collect_list(struct(block, sub, glue, text))), (x, i) -> concat(if(i = 0, '', x.glue), x.text))"))).alias("text_md5"))


def _questions_json(spark, sf):
    """Level-1 questions exported as one JSON document per collection (the generator's output shape)."""
    q = _level_1(spark, sf)[0]
    item = F.struct(*[F.col(c) for c in qn.QUESTION_FIELDS])
    return q.groupBy("collection").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("topic_rank", "question_pos", item.alias("q")))),
                                       lambda x: x["q"]).alias("questions"))).alias("json"))


@query("parse_questions")
def q_parse_questions(spark, sf):
    good, _ = gen.parse_questions(_questions_json(spark, sf), keys=("collection",))
    return qn.flat_questions(good.withColumn("question_pos", F.lit(0))).drop("question_pos")


ANSWERS_A_TASK = 20_000


@query("parse_quarantine")
def q_parse_quarantine(spark, sf):
    """Level 1 questions, each spoilt in one way by its document's number, and what the parser says."""
    from folio.session import stored
    q = stored(_level_1(spark, sf)[0].select("collection", "topic", "question_pos", "question"), "questions")
    q = q.withColumn("n", F.pmod(F.regexp_extract("collection", r"(\d+)$", 1).cast("int"), F.lit(8)))
    text = F.to_json(F.struct("question"))
    quoted = F.substring(text, F.lit(13), F.char_length(text) - 13)      # the question as a JSON string
    def item(question='QUESTION', options='["a","b","c","d"]', page="1", more=""):
        return F.concat(F.lit('{"topic":"t","type":"MCQ","question":'), quoted if question == "QUESTION" else F.lit(question),
                        F.lit(f',"options":{options},"correct_answer":"A","page_number":{page},"explanation":"e"{more}}}'))
    cases = [item(), item(options='"abc"'), item(options="null"), item(question="null"), item(question="5"), item(page='"x"'), item(more=',"extra":1'), F.lit("{")]
    spoilt = F.coalesce(*[F.when(F.col("n") == k, c) for k, c in enumerate(cases)])
    raw = q.select("collection", F.col("topic").alias("asked"), F.col("question_pos").cast("int").alias("question_pos"),
                   F.concat(F.lit('{"questions":['), spoilt, F.lit("]}")).alias("json"))
    # the parser reads them several times: computed once, and in more tasks than their size would give, as parsing is slow
    raw = stored(raw.repartition(max(1, -(-q.count() // ANSWERS_A_TASK)), "collection", "asked", "question_pos"), "answers")
    good, bad = gen.parse_questions(raw, keys=("collection", "asked", "question_pos"))
    checked = bad.select("collection", "asked", "question_pos", "reason").unionByName(
        good.select("collection", "asked", "question_pos", F.lit("accepted").alias("reason")))
    return checked.withColumnRenamed("asked", "topic")


@query("parse_topics")
def q_parse_topics(spark, sf):
    lists = tp.topic_lists(_topics(spark, sf))
    from folio.sinks import topic_list_json
    p, _ = gen.parse_topics(topic_list_json(lists), keys=("collection",))
    return p.select("collection", "book_title", "total_topics",
                    F.posexplode("main_topics").alias("pos", "topic")).select(
        "collection", "book_title", "total_topics", (F.col("pos") + 1).cast("int").alias("topic_rank"), "topic")


# ---------------------------------------------------------------- chat

def _chat_answers(spark, sf, retrieved: DataFrame | None = None):
    qs = fx.user_questions(spark, sf).withColumn(
        "qid", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    r = retrieved if retrieved is not None else _chat_retrieved(spark, sf)
    return chat.answer_questions(spark, qs, r.drop("conv_id", "turn"), key="qid")


@query("validate_requests")
def q_validate_requests(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    req = c.select("conv_id", "turn", F.col("text").alias("question"),
                   F.concat(F.lit("src"), F.pmod("conv_id", F.lit(fx.N_QUESTION_SOURCES)).cast("string")).alias("collection"))
    v = chat.validate_requests(req)
    return v.select("conv_id", "turn", F.col("error").isNull().alias("accepted"), "error")


@query("normalize_text")
def q_normalize_text(spark, sf):
    from folio.functions.text import normalize_text
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", normalize_text(F.col("text")).alias("normalized"))


@query("route_greetings")
def q_route_greetings(spark, sf):
    r = chat.route_greetings(spark, fx.user_questions(spark, sf))
    return r.select("conv_id", "turn", "is_greeting", "reply")


@query("chat_answer")
def q_chat_answer(spark, sf):
    a = _chat_answers(spark, sf)
    return a.select("conv_id", "turn", F.col("final_answer").alias("answer"), F.col("n_segments").cast("int").alias("n_segments"))


@query("parse_chat")
def q_parse_chat(spark, sf):
    a = _chat_answers(spark, sf)
    js = a.select("conv_id", "turn", F.to_json(F.struct(F.lit("").alias("generated_at"), "question",
                                                        F.col("final_answer").alias("answer"))).alias("json"))
    return gen.parse_chat(js, keys=("conv_id", "turn"))[0]


@query("answer_tokens")
def q_answer_tokens(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    return chat.answer_tokens(a, keys=("conv_id", "turn"))


def _chat_log_table(spark, sf):
    """Chat turns appended to a log table (input, output, segments, timestamp) and read back."""
    from folio.session import scratch_path
    import uuid
    from folio.session import materialize
    # one retrieval feeds both the answers and the segments (a Python stage is not
    # de-duplicated by exchange reuse, so it is materialised once)
    r = materialize(_chat_retrieved(spark, sf), "retrieved")
    a = _chat_answers(spark, sf, r)
    path = scratch_path(spark, f"chat-log-{uuid.uuid4().hex}")
    chat.append_chat_log(chat.chat_log_rows(a, r, ("conv_id", "turn")), path)
    return spark.read.parquet(path)


@query("chat_log")
def q_chat_log(spark, sf):
    t = _chat_log_table(spark, sf)
    return t.select("conv_id", "turn", "input", "output", F.size("segments").cast("int").alias("n_segments"))


@query("export_chat_log")
def q_export_chat_log(spark, sf):
    """The exported log read back, without its time field."""
    out = chat.export_chat_log(_chat_log_table(spark, sf), ("conv_id", "turn"))
    back = out.select("conv_id", "turn", F.from_json("json", f"struct<input:string,output:string,segments:{chat.SEGMENTS},timestamp:string>").alias("j"))
    pages_ = F.array_join(F.transform("j.segments", lambda x: x["metadata"]["page_number"]), ",")
    return back.select("conv_id", "turn", "j.input", "j.output", pages_.alias("segment_pages"), (F.length("j.timestamp") >= 19).alias("stamped"))


# ---------------------------------------------------------------- instruction data

from folio.operators import instruct  # noqa: E402


@query("load_split")
def q_load_split(spark, sf):
    return instruct.load_split(spark, f"{sf}/conversations.parquet", split="user", split_col="role")


@query("instruct_open")
def q_instruct_open(spark, sf):
    return instruct.instruct_open(fx.open_qa_rows(spark, sf))[0]


@query("instruct_quarantine")
def q_instruct_quarantine(spark, sf):
    return instruct.instruct_open(fx.open_qa_rows(spark, sf))[1]


@query("instruct_mcq")
def q_instruct_mcq(spark, sf):
    return instruct.instruct_mcq(fx.mcq_rows(spark, sf))


@query("preview_instruct")
def q_preview_instruct(spark, sf):
    return instruct.preview(instruct.instruct_open(fx.open_qa_rows(spark, sf))[0], 5)


@query("merge_instruct")
def q_merge_instruct(spark, sf):
    from folio.session import scratch_path
    import uuid
    sets = [instruct.instruct_mcq(fx.mcq_rows(spark, sf)), instruct.instruct_open(fx.open_qa_rows(spark, sf))[0]]
    return instruct.merge(sets, scratch_path(spark, f"train-merge-{uuid.uuid4().hex}"))


# ---------------------------------------------------------------- JSON in/out, raw retrieval shape, distances

@query("export_questions")
def q_export_questions(spark, sf):
    """``{metadata, questions}`` JSON per collection, written as text; read back as one row a question
    in file order, without the time field."""
    from folio.sinks import RESULT_SCHEMA, export_questions
    from folio.session import discard, scratch_path, stored
    import uuid
    path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    q = stored(_level_1(spark, sf)[0].drop("topics", "cores", "sentence"), "questions")
    export_questions(q, qn.quiz_metadata(q, _titles(spark, sf)), path, compression="gzip")
    discard(q)
    r = spark.read.schema(RESULT_SCHEMA).json(path).select("collection", F.posexplode("questions").alias("pos", "q"))
    return r.select("collection", "pos", "q.id", "q.topic", "q.question", "q.correct_answer", "q.page_number")


@query("export_questions_l2")
def q_export_questions_l2(spark, sf):
    """The level 2 export: its extra metadata and each question's source."""
    from folio.sinks import export_questions
    from folio.session import discard, scratch_path, stored
    import uuid
    path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    q = stored(_level_2(spark, sf)[0].drop("topics", "cores", "sentence"), "questions")
    export_questions(q, qn.quiz_metadata(q, _titles(spark, sf), rag=True), path, compression="gzip")
    discard(q)
    schema = ("collection string, metadata struct<total_questions:int,generation_method:string,embedding_model:string,vectore_store:string>, "
              f"questions array<struct<id:string,source:{chat.SEGMENTS}>>")
    r = spark.read.schema(schema).json(path)
    return r.select("collection", "metadata.*", F.explode_outer("questions").alias("q")).select(
        "collection", "total_questions", "generation_method", "embedding_model", "vectore_store", "q.id",
        F.get("q.source", F.lit(0))["metadata"]["page_number"].alias("source_page"))


@query("read_results")
def q_read_results(spark, sf):
    """Exported result files read back with an explicit schema; counts from the files."""
    from folio.sinks import RESULT_SCHEMA, export_questions
    from folio.sources.files import read_json_results
    from folio.session import discard, scratch_path, stored
    import uuid
    path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    q = stored(_level_1(spark, sf)[0].drop("topics", "cores", "sentence"), "questions")
    export_questions(q, qn.quiz_metadata(q, _titles(spark, sf)), path, compression="gzip")
    discard(q)
    r = read_json_results(spark, path, RESULT_SCHEMA)
    return r.select("collection", F.col("metadata.total_questions").alias("total_questions"),
                    F.col("metadata.book_title").alias("book_title"),
                    F.col("metadata.tool_used").alias("tool_used"))


def _page_maps(spark, sf):
    p = fx.doc_pages(spark, sf)
    # keys in numeric page order ("2" before "10"): sort on the number, then make the text keys
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("n"), F.col("text").alias("v"))))
    return p.groupBy("collection").agg(F.to_json(F.map_from_entries(F.transform(
        ordered, lambda x: F.struct(x["n"].cast("string").alias("k"), x["v"].alias("v"))))).alias("json"))


@query("page_map_json")
def q_page_map_json(spark, sf):
    return _page_maps(spark, sf)


@query("read_page_map")
def q_read_page_map(spark, sf):
    m = _page_maps(spark, sf)
    return m.select("collection", F.explode(F.from_json("json", "map<string,string>")).alias("k", "text")).select(
        "collection", F.col("k").cast("int").alias("page_number"), "text")


@query("flatten_results")
def q_flatten_results(spark, sf):
    """Retrieval in the store's raw shape (lists nested per query) flattened back to rows."""
    r = _chat_retrieved(spark, sf)
    raw = r.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", "document", F.struct(F.col("page_number").cast("string").alias("page_number")).alias("m"),
        "distance"))).alias("hits")).select(
        "conv_id", "turn",
        F.array(F.transform("hits", lambda h: h["chunk_id"])).alias("ids"),
        F.array(F.transform("hits", lambda h: h["document"])).alias("documents"),
        F.array(F.transform("hits", lambda h: h["m"])).alias("metadatas"),
        F.array(F.transform("hits", lambda h: h["distance"])).alias("distances"))
    flat = raw.select("conv_id", "turn", F.inline(F.arrays_zip(
        F.col("ids")[0].alias("id"), F.col("documents")[0].alias("document"),
        F.col("metadatas")[0].alias("metadata"), F.col("distances")[0].alias("distance"))))
    from folio.functions.vector import confidence
    return flat.select("conv_id", "turn", F.col("id").alias("chunk_id"),
                       F.col("metadata.page_number").alias("page_number"),
                       confidence(F.col("distance")).alias("confidence"))


@query("vector_distances")
def q_vector_distances(spark, sf):
    """Cosine, squared L2 and inner-product distance of every vector to its 5 nearest neighbours."""
    from folio.functions.vector import distance
    top = q_retrieve_topk(spark, sf).select("query_id", "neighbor_id")
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    j = (top.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id")
         .join(v.select(F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("b")), "neighbor_id"))
    return j.select("query_id", "neighbor_id",
                    F.round(distance("a", "b", "cosine"), 6).alias("cosine"),
                    F.round(distance("a", "b", "l2sq"), 6).alias("l2sq"),
                    F.round(distance("a", "b", "ip"), 6).alias("ip"))


# ---------------------------------------------------------------- streaming, approximate search

@query("stream_ingest")
def q_stream_ingest(spark, sf):
    """Documents arrive in three parts that share some of them, a part's files a micro-batch; then the
    stream starts again with its checkpoint lost: every file is offered again and nothing is
    added. The store then equals the batch ingest."""
    from folio.session import scratch_path
    from folio.streaming.ingest import DOC_SCHEMA, stream_ingest
    import uuid
    base = scratch_path(spark, f"stream-ingest-{uuid.uuid4().hex}")
    d = read_table(spark, sf, "documents", spread=False).select(*[f.name for f in DOC_SCHEMA.fields])
    for part in range(3):
        # every seventh document comes with two parts
        d.where((F.pmod("doc_id", F.lit(3)) == part) | ((F.pmod("doc_id", F.lit(7)) == 0) & (F.pmod("doc_id", F.lit(3)) == (part + 1) % 3))) \
            .write.parquet(f"{base}/in/{part}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/in").select("path").count()
    run = lambda at: stream_ingest(spark, f"{base}/in/*", "*.parquet", f"{base}/store", f"{base}/{at}", max_files=files // 3)
    first, replay = run("checkpoint"), run("checkpoint-2")
    if first["batches"] < 3 or replay["batches"] < 3 or replay["added"] != 0:
        raise AssertionError(f"first run {first}, replay {replay}")
    return chunks.read_store(spark, f"{base}/store").select("collection", "chunk_id", "page_number")


def _streamed(sf, name: str) -> str:
    """Source path of a table as a stream, be it one file or a folder of files (a plain path to a file is no stream source, a pattern is)."""
    return f"{sf.rstrip('/')}/{name}.parque[t]"


@query("stream_chat")
def q_stream_chat(spark, sf):
    """Conversation turns arrive as a stream; each micro-batch retrieves for its user turns."""
    from folio.session import scratch_path
    from folio.streaming.ingest import stream_questions
    import uuid
    base = scratch_path(spark, f"stream-chat-{uuid.uuid4().hex}")
    schema = read_table(spark, sf, "conversations", spread=False).schema
    corpus = _corpus_store(spark, sf, f"{base}/store")

    def answer(batch):
        qs = batch.where(F.col("role") == "user").select(
            "conv_id", "turn", F.col("text").alias("question"),
            F.concat(F.lit("src"), F.pmod("conv_id", F.lit(fx.N_QUESTION_SOURCES)).cast("string")).alias("collection"))
        qid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        r = chat.retrieve_for_questions(qs, corpus, k=chat.CHAT_K, qid=qid)
        return r.join(qs.select(qid.alias("qid"), "conv_id", "turn"), "qid").select(
            "conv_id", "turn", "rank", "chunk_id", "confidence")

    stream_questions(spark, _streamed(sf, "conversations"), "*", schema, f"{base}/out", f"{base}/checkpoint", answer)
    return spark.read.parquet(f"{base}/out").select("conv_id", "turn", "rank", "chunk_id", "confidence")


@query("stream_sessions")
def q_stream_sessions(spark, sf):
    """Conversation turns arrive out of order in three micro-batches (later turns first, some of them twice) and are logged in order."""
    from folio.session import scratch_path
    from folio.streaming.sessions import stream_sessions
    import uuid
    base = scratch_path(spark, f"stream-sessions-{uuid.uuid4().hex}")
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text", spread=False)
    for part in range(3):
        # a conversation's turns come by the remainder of their number, the larger remainders first
        c.where((F.pmod("turn", F.lit(3)) == 2 - part) | ((part == 2) & (F.pmod("conv_id", F.lit(5)) == 0))).write.parquet(f"{base}/in/{part}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/in").select("path").count()
    stream_sessions(spark, f"{base}/in/*", "*.parquet", f"{base}/out", f"{base}/checkpoint", max_files=-(-files // 3))
    return spark.read.parquet(f"{base}/out").select("conv_id", "turn", "role", "late", "is_greeting", F.md5("text").alias("text_md5"), "reply")


def _corpus_store(spark, sf, path):
    """The retrieval corpus written once: micro-batches read it, they do not embed it again."""
    fx.source_corpus(spark, sf).select("collection", "chunk_id", "doc_id", "page_number", "document", "embedding").write.parquet(path)
    return spark.read.parquet(path)


@query("stream_chat_log")
def q_stream_chat_log(spark, sf):
    """Conversation turns arrive as a stream; each micro-batch of questions is answered and logged
    (input, output, segments, timestamp)."""
    from folio.session import scratch_path
    from folio.streaming.ingest import stream_questions
    import uuid
    base = scratch_path(spark, f"stream-log-{uuid.uuid4().hex}")
    schema = read_table(spark, sf, "conversations", spread=False).schema
    corpus = _corpus_store(spark, sf, f"{base}/store")

    def answer(batch):
        from folio.session import materialize
        qid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        qs = batch.where(F.col("role") == "user").select(
            qid.alias("qid"), F.col("text").alias("question"),
            F.concat(F.lit("src"), F.pmod("conv_id", F.lit(fx.N_QUESTION_SOURCES)).cast("string")).alias("collection"))
        r = materialize(chat.retrieve_for_questions(qs, corpus), "retrieved")
        return chat.chat_log_rows(chat.answer_questions(batch.sparkSession, qs, r), r)

    stream_questions(spark, _streamed(sf, "conversations"), "*", schema, f"{base}/out", f"{base}/checkpoint", answer)
    return spark.read.parquet(f"{base}/out").select("qid", "input", "output", F.size("segments").alias("n_segments"))


@query("retrieve_topk_blocks")
def q_retrieve_topk_blocks(spark, sf):
    """``retrieve_topk`` on the path for query sets too large to broadcast."""
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    coll = F.concat(F.lit("label_"), F.col("label").cast("string"))
    q = v.select(coll.alias("collection"), F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    c = v.select(coll.alias("collection"), F.col("vec_id").alias("cid"), F.lit(0).alias("tie1"), F.col("vec_id").alias("tie2"), F.col("embedding").alias("vec"))
    top = retrieve.knn(q, c, retrieve.KnnConfig(k=5, exclude_self=True, force_path="block"))
    return top.select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"), "confidence", F.round("distance", 6).alias("distance"))


@query("retrieve_lsh")
def q_retrieve_lsh(spark, sf):
    """Approximate top 5 (random-hyperplane buckets, exact re-rank) with recall against exact."""
    from folio.operators.lsh import lsh_knn
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    coll = F.concat(F.lit("label_"), F.col("label").cast("string"))
    q = v.select(coll.alias("collection"), F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    c = v.select(coll.alias("collection"), F.col("vec_id").alias("cid"), F.lit(0).alias("tie1"),
                 F.col("vec_id").alias("tie2"), F.col("embedding").alias("vec"))
    approx = lsh_knn(q, c, retrieve.KnnConfig(k=5, exclude_self=True))
    exact = retrieve.knn(q, c, retrieve.KnnConfig(k=5, exclude_self=True))
    hit = approx.select("qid", "cid", F.lit(1).alias("hit"))
    recall = exact.join(hit, ["qid", "cid"], "left").groupBy("qid").agg(
        (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return approx.join(recall, "qid", "left").select(
        F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"), "confidence", "recall")


def _label_vectors(spark, sf, collection=None):
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    coll = F.concat(F.lit("label_"), F.col("label").cast("string")) if collection is None else F.lit(collection)
    q = v.select(coll.alias("collection"), F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return q, v.select(coll.alias("collection"), F.col("vec_id").alias("cid"), F.lit(0).alias("tie1"), F.col("vec_id").alias("tie2"), F.col("embedding").alias("vec"))


@query("retrieve_pruned")
def q_retrieve_pruned(spark, sf):
    """``retrieve_topk`` from a stored cell index: cells that the triangle inequality rules out are not visited."""
    from folio.operators import cells
    from folio.session import scratch_path
    import uuid
    q, c = _label_vectors(spark, sf)
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    cells.build(c, path)
    hits, _ = cells.search_exact(q, path, k=5, exclude_self=True)
    return hits.select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"), "confidence", F.round("distance", 6).alias("distance"))


@query("retrieve_index")
def q_retrieve_index(spark, sf):
    """Approximate top 5 of all vectors, taken as one collection, from a stored index that got them in two appends, with
    each query's recall against the exact search of the same index and the rows that one visited."""
    from folio.operators import cells
    from folio.session import materialize, scratch_path
    import uuid
    q, c = _label_vectors(spark, sf, "all")
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    cells.build(c.where("cid % 2 = 0"), path)
    cells.append(c, path)
    found = materialize(cells.search(q, path, k=5, exclude_self=True), "found")
    exact, visits = cells.search_exact(q, path, k=5, exclude_self=True)
    hit = found.select("qid", "cid", F.lit(1).alias("hit"))
    recall = exact.join(hit, ["qid", "cid"], "left").groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    seen = visits.select("qid", F.round(F.col("rows") / F.col("of_rows"), 4).alias("exact_visited"))
    return found.join(recall, "qid").join(seen, "qid").select(
        F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"), "confidence", "recall", "exact_visited")


# ---------------------------------------------------------------- end-to-end

@query("chat")
def q_chat(spark, sf):
    """The end-to-end chat call: checks, greeting route, top-3 retrieval, answer, documents."""
    from folio import api
    qs = fx.user_questions(spark, sf).withColumn(
        "qid", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = api.chat(spark, qs, fx.source_corpus(spark, sf))
    return out.join(qs.select("qid", "conv_id", "turn"), "qid").select(
        "conv_id", "turn", "answer", F.size("documents").cast("int").alias("n_segments"))


@query("chat_generator")
def q_chat_generator(spark, sf):
    """The same call with a model in the place of the extractive answer (the deterministic stand-in)."""
    from folio import api
    qs = fx.user_questions(spark, sf).withColumn(
        "my_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = api.chat(spark, qs, fx.source_corpus(spark, sf), qid="my_id", generator=_offline_chat_generator)
    return out.select("my_id", "answer", "error", F.size("documents").cast("int").alias("n_segments"))
