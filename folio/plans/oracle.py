"""Independent SQL twins of the query keys (DuckDB dialect, same driver tables).

These are the oracle for the correctness gate: written from the operator semantics, not
from the Spark code, over the same Parquet tables. Shared pieces are SQL fragments.
"""

from __future__ import annotations

LPP = 5      # lines per page
DIM = 64     # default embedding width
NSRC = 20    # question -> collection 'src' || (conv_id mod 20)

BLANK_CLASS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
NOT_BLANK = rf"regexp_matches({{x}}, '[^{BLANK_CLASS}]')"


def not_blank(x: str) -> str:
    return NOT_BLANK.replace("{x}", x)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def slot_counts(x: str) -> str:
    slots = f"list_transform({tokens(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM})"
    return f"list_transform(range({DIM}), lambda i: len(list_filter({slots}, lambda s: s = i)))"


def embedding(counts: str) -> str:
    ss = f"CAST(list_sum(list_transform({counts}, lambda v: v * v)) AS BIGINT)"
    return f"CASE WHEN {ss} > 0 THEN list_transform({counts}, lambda v: CAST(v / sqrt({ss}) AS FLOAT)) END"


def embed_ctes(name: str, src: str, text: str, with_vec: bool = True) -> str:
    """CTEs ``<name>`` = ``src`` rows + ``counts`` (+ ``vec``), computed in stages so that no
    list expression is re-evaluated inside a lambda."""
    slots = f"list_transform({tokens(text)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM})"
    out = f"""
{name}_s AS MATERIALIZED (SELECT *, {slots} AS __slots FROM {src}),
{name}_c AS MATERIALIZED (
  SELECT * EXCLUDE (__slots), list_transform(range({DIM}), lambda i: len(list_filter(__slots, lambda s: s = i))) AS counts
  FROM {name}_s)"""
    if not with_vec:
        return out.replace(f"{name}_c AS MATERIALIZED", f"{name} AS MATERIALIZED")
    return out + f""",
{name}_q AS (SELECT *, CAST(list_sum(list_transform(counts, lambda v: v * v)) AS BIGINT) AS __ss FROM {name}_c),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (__ss),
         CASE WHEN __ss > 0 THEN list_transform(counts, lambda v: CAST(v / sqrt(__ss) AS FLOAT)) END AS vec
  FROM {name}_q)"""


def cosine(a: str, b: str) -> str:
    return (f"(1 - list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
            f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))))")


def confidence(d: str) -> str:
    return f"round(greatest(0.0, 1 - {d}), 4)"


# pages of every document: collection = 'doc_' || doc_id (or the source), numbered from 1
def pages_cte(collection: str = "'doc_' || doc_id") -> str:
    return f"""
doc_lines AS (
  SELECT doc_id, source, {collection} AS collection, string_split(text, chr(10)) AS lines
  FROM documents WHERE text IS NOT NULL),
doc_page_idx AS (
  SELECT collection, doc_id, source, lines, unnest(range(0, CAST(ceil(len(lines) / {LPP}.0) AS BIGINT))) AS i
  FROM doc_lines),
doc_pages AS (
  SELECT collection, doc_id, source, CAST(i + 1 AS INTEGER) AS page_number,
         array_to_string(lines[i * {LPP} + 1 : i * {LPP} + {LPP}], chr(10)) AS text
  FROM doc_page_idx)"""


def source_corpus_cte() -> str:
    return pages_cte("source") + f""",
corpus_src AS (
  SELECT collection, doc_id, page_number, 'doc_' || doc_id || '_page_' || page_number AS chunk_id,
         text AS document
  FROM doc_pages WHERE {not_blank('text')}),""" + embed_ctes("corpus", "corpus_src", "document")


def questions_cte() -> str:
    return f"""
questions_src AS (
  SELECT conv_id, turn, text AS question, 'src' || (conv_id % {NSRC}) AS collection
  FROM conversations WHERE role = 'user'),""" + embed_ctes("questions", "questions_src", "question")


def chat_retrieve_cte(k: int = 3) -> str:
    return source_corpus_cte() + "," + questions_cte() + f""",
qc_pairs AS (
  SELECT q.conv_id, q.turn, c.collection, c.chunk_id, c.doc_id, c.page_number, c.document,
         {cosine('q.vec', 'c.vec')} AS distance
  FROM questions q JOIN corpus c ON q.collection = c.collection
  WHERE q.vec IS NOT NULL AND c.vec IS NOT NULL),
qc_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn
                               ORDER BY round(distance, 9), page_number, doc_id, chunk_id) AS rank
  FROM qc_pairs),
retrieved AS (SELECT * FROM qc_ranked WHERE rank <= {k})"""


ORACLE: dict[str, str] = {}

ORACLE["page_split"] = "WITH " + pages_cte() + """
SELECT collection, doc_id, page_number, text FROM doc_pages"""

ORACLE["embed_pages"] = "WITH " + pages_cte() + f""",
nb AS (SELECT collection, page_number, text FROM doc_pages WHERE {not_blank('text')}),""" + embed_ctes("cnt", "nb", "text", False) + f"""
SELECT collection, 'page_' || page_number AS chunk_id, page_number,
       CAST(len({tokens('text')}) AS INTEGER) AS n_tokens,
       CAST(list_sum(list_transform(counts, lambda v: v * v)) AS BIGINT) AS sumsq,
       md5(array_to_string(counts, ',')) AS slots_md5
FROM cnt"""

ORACLE["retrieve_topk"] = f"""
WITH v AS (SELECT vec_id, 'label_' || label AS collection, embedding FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, {cosine('q.embedding', 'c.embedding')} AS distance
  FROM v q JOIN v c ON q.collection = c.collection AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS rank
  FROM pairs WHERE isfinite(distance))
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, {confidence('distance')} AS confidence,
       round(distance, 6) AS distance
FROM ranked WHERE rank <= 5"""

ORACLE["chat_retrieve"] = "WITH " + chat_retrieve_cte(3) + f"""
SELECT conv_id, turn, collection, CAST(rank AS INTEGER) AS rank, chunk_id, doc_id, page_number,
       {confidence('distance')} AS confidence, round(distance, 6) AS distance
FROM retrieved"""

ORACLE["chat_context"] = "WITH " + chat_retrieve_cte(3) + """
SELECT conv_id, turn,
       string_agg(document || ' Page number: ' || page_number || chr(10), '' ORDER BY rank) AS context,
       CAST(count(*) AS INTEGER) AS n_docs
FROM retrieved GROUP BY conv_id, turn"""


# ---------------------------------------------------------------- ingest rules, scans, page lookups

NAME_RE = r"[^\p{L}\p{N}_]"


def coll_name(x: str) -> str:
    return f"regexp_replace({x}, '{NAME_RE}', '_', 'g')"


FILES = f"files AS (SELECT page_id, url, {coll_name('url')} AS collection FROM pages)"

DOC_CHUNKS = pages_cte() + f""",
doc_chunks AS (
  SELECT collection, doc_id, 'page_' || page_number AS chunk_id, page_number, text AS document
  FROM doc_pages WHERE {not_blank('text')})"""

STORED_BEFORE = """
stored AS (SELECT * FROM doc_chunks WHERE doc_id IN (SELECT doc_id FROM labels) AND page_number <= 2)"""

DOC_COUNTS = """
doc_counts AS (
  SELECT 'doc_' || doc_id AS collection,
         CAST(ceil(len(string_split(text, chr(10))) / 5.0) AS INTEGER) AS n_pages
  FROM documents WHERE text IS NOT NULL)"""

PAGE_REQUESTS = """
requests AS (
  SELECT 'doc_' || doc_id AS collection, CAST(doc_id % 7 AS INTEGER) AS page_number FROM documents
  UNION ALL SELECT 'doc_' || doc_id, CAST(doc_id % 7 AS INTEGER) FROM documents WHERE doc_id % 3 = 0),
checked AS (
  SELECT r.collection, r.page_number, c.n_pages,
         CASE WHEN c.n_pages IS NULL THEN 'unknown collection'
              WHEN r.page_number < 1 THEN 'page number below 1'
              WHEN r.page_number > c.n_pages THEN 'invalid page number' END AS reason
  FROM requests r LEFT JOIN doc_counts c USING (collection))"""

ORACLE["collection_name"] = f"WITH {FILES} SELECT page_id, url, collection FROM files"

ORACLE["filter_supported"] = """
SELECT page_id, url, suffix(lower(url), '.html') AS supported,
       CASE WHEN NOT suffix(lower(url), '.html') THEN 'Only .html files are supported.' END AS reason
FROM pages"""

ORACLE["nonblank_pages"] = "WITH " + pages_cte() + f"""
SELECT collection, page_number, text FROM doc_pages WHERE {not_blank('text')}"""

ORACLE["new_files"] = f"""
WITH {FILES},
known AS (SELECT url FROM pages WHERE page_id IN (SELECT doc_id FROM labels))
SELECT url, page_id, collection FROM files WHERE url NOT IN (SELECT url FROM known WHERE url IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1"""

ORACLE["name_collisions"] = f"""
WITH named AS (SELECT url, {coll_name("regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+', '', 'g')")} AS collection FROM pages)
SELECT collection, count(DISTINCT url) AS n_files, min(url) AS first_file FROM named GROUP BY collection HAVING count(DISTINCT url) > 1"""

ORACLE["rejected_documents"] = "SELECT doc_id, 'no text' AS reason FROM documents WHERE text IS NULL OR doc_id % 2 = 0"

ORACLE["new_chunks"] = "WITH " + DOC_CHUNKS + "," + STORED_BEFORE + """
SELECT collection, chunk_id, page_number, document FROM doc_chunks o
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.collection = o.collection AND s.chunk_id = o.chunk_id)"""

ORACLE["ingest_stats"] = "WITH " + DOC_CHUNKS + "," + STORED_BEFORE + f""",
flags AS (
  SELECT p.collection,
         NOT {not_blank('p.text')} AS blank,
         s.chunk_id IS NOT NULL AS known,
         len({tokens('p.text')}) = 0 AS no_tokens
  FROM doc_pages p LEFT JOIN stored s ON s.collection = p.collection AND s.page_number = p.page_number)
SELECT collection, count(*) AS offered,
       CAST(sum(CAST(blank AS INTEGER)) AS BIGINT) AS blank,
       CAST(sum(CAST(known AS INTEGER)) AS BIGINT) AS already_stored,
       CAST(sum(CAST(NOT blank AND NOT known AS INTEGER)) AS BIGINT) AS added,
       CAST(sum(CAST(NOT blank AND NOT known AND no_tokens AS INTEGER)) AS BIGINT) AS zero_vector
FROM flags GROUP BY collection"""

ORACLE["ingest_append"] = "WITH " + DOC_CHUNKS + """
SELECT collection, chunk_id, page_number, (SELECT count(*) FROM doc_chunks) AS added_first_run FROM doc_chunks"""

ORACLE["resolve_collections"] = "WITH " + DOC_CHUNKS + f", {FILES}" + """,
requests AS (SELECT DISTINCT collection FROM (
  SELECT 'doc_' || doc_id AS collection FROM documents UNION ALL SELECT collection FROM files)),
have AS (SELECT collection, count(*) AS n FROM doc_chunks GROUP BY collection)
SELECT r.collection, h.n IS NOT NULL AS "exists", CAST(coalesce(h.n, 0) AS BIGINT) AS n_chunks
FROM requests r LEFT JOIN have h USING (collection)"""

ORACLE["scan_collection"] = "WITH " + DOC_CHUNKS + """
SELECT collection, chunk_id, page_number, document FROM doc_chunks WHERE doc_id IN (SELECT doc_id FROM labels)"""

ORACLE["collection_text"] = "WITH " + DOC_CHUNKS + """
SELECT collection, CAST(count(*) AS INTEGER) AS n_pages, string_agg(document, ' ' ORDER BY page_number) AS text
FROM doc_chunks GROUP BY collection"""

FULL_TEXT = pages_cte() + """,
full_texts AS (
  SELECT collection, doc_id, CAST(count(*) AS INTEGER) AS n_pages, string_agg(text, '' ORDER BY page_number) AS full_text
  FROM doc_pages GROUP BY collection, doc_id)"""

ORACLE["full_text"] = "WITH " + FULL_TEXT + """
SELECT collection, n_pages, CAST(length(full_text) AS INTEGER) AS length, md5(full_text) AS text_md5 FROM full_texts"""

ORACLE["text_with_fallback"] = "WITH " + FULL_TEXT + f""",
doc_chunks AS (
  SELECT collection, page_number, text AS document FROM doc_pages WHERE {not_blank('text')}),
store AS (SELECT collection, string_agg(document, ' ' ORDER BY page_number) AS store_text FROM doc_chunks GROUP BY collection),
memory AS (SELECT collection, full_text AS memory_text FROM full_texts WHERE doc_id IN (SELECT doc_id FROM labels)),
j AS (SELECT coalesce(s.collection, m.collection) AS collection, store_text, memory_text
      FROM store s FULL OUTER JOIN memory m ON s.collection = m.collection),
t AS (SELECT collection,
             CASE WHEN memory_text IS NOT NULL AND memory_text <> '' THEN 'memory' ELSE 'store' END AS origin,
             CASE WHEN memory_text IS NOT NULL AND memory_text <> '' THEN memory_text ELSE store_text END AS text
      FROM j)
SELECT collection, origin, CAST(length(text) AS INTEGER) AS length, md5(text) AS text_md5 FROM t"""

ORACLE["page_counts"] = "WITH " + DOC_COUNTS + " SELECT collection, n_pages FROM doc_counts"

ORACLE["single_page"] = "WITH " + pages_cte() + "," + DOC_COUNTS + "," + PAGE_REQUESTS + """
SELECT c.collection, c.page_number, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason,
       CASE WHEN reason IS NULL THEN p.text END AS text
FROM checked c LEFT JOIN doc_pages p ON p.collection = c.collection AND p.page_number = c.page_number"""

ORACLE["page_interval"] = "WITH " + pages_cte() + "," + DOC_COUNTS + "," + PAGE_REQUESTS + """,
joined AS (
  SELECT c.collection, c.page_number, c.reason, p.page_number AS p_page, p.text AS p_text
  FROM (SELECT DISTINCT * FROM checked) c LEFT JOIN doc_pages p
    ON p.collection = c.collection AND c.reason IS NULL
   AND p.page_number BETWEEN greatest(1, c.page_number - 1) AND least(c.n_pages, c.page_number + 1)),
agg AS (SELECT collection, page_number, reason, string_agg(p_text, '' ORDER BY p_page) AS text
        FROM joined GROUP BY collection, page_number, reason)
SELECT collection, page_number, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason,
       CASE WHEN reason IS NULL THEN coalesce(text, '') END AS text
FROM agg JOIN requests USING (collection, page_number)"""

ORACLE["page_window"] = "WITH " + pages_cte() + """
SELECT a.collection, a.page_number, string_agg(b.text, '' ORDER BY b.page_number) AS window_text
FROM doc_pages a JOIN doc_pages b ON a.collection = b.collection AND b.page_number BETWEEN a.page_number - 1 AND a.page_number + 1
GROUP BY a.collection, a.page_number"""


# ---------------------------------------------------------------- topics and questions

SENT_SPLIT = r"[.!?][\t\n\f\r ]|\n"


def core(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


TOPICS = DOC_CHUNKS + f""",
toks AS (SELECT collection, unnest({tokens('document')}) AS token FROM doc_chunks),
tf AS (SELECT collection, token, count(*) AS tf FROM toks WHERE length(token) >= 4 GROUP BY collection, token),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
ncoll AS (SELECT count(DISTINCT collection) AS n FROM tf),
scored AS (SELECT tf.collection, tf.token, tf.tf, dfs.df, tf.tf * ln((1 + ncoll.n) / (1 + dfs.df)) AS score
           FROM tf JOIN dfs USING (token) CROSS JOIN ncoll),
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(score, 6) DESC, token) AS topic_rank
           FROM scored),
top AS (SELECT *, count(*) OVER (PARTITION BY collection) AS total_topics FROM ranked WHERE topic_rank <= 10),
first_page AS (SELECT collection, arg_min(document, page_number) AS doc FROM doc_chunks GROUP BY collection),
titles AS (SELECT collection,
                  {strip(f"list_filter(string_split(doc, chr(10)), lambda l: {not_blank('l')})[1]")} AS book_title
           FROM first_page),
topics AS (
  SELECT t.collection, ti.book_title, CAST(topic_rank AS INTEGER) AS topic_rank, token AS topic, tf, df,
         round(score, 6) AS score, CAST(total_topics AS INTEGER) AS total_topics
  FROM top t LEFT JOIN titles ti USING (collection)),
topic_arrays AS (SELECT collection, list(topic ORDER BY topic_rank) AS topics FROM topics GROUP BY collection)"""

ORACLE["extract_topics"] = "WITH " + TOPICS + """
SELECT collection, book_title, topic_rank, topic, tf, df, score, total_topics FROM topics"""

ORACLE["topic_tasks"] = "WITH " + TOPICS + """
SELECT collection, topic_rank AS topic_pos, topic, 5 AS n_questions FROM topics"""


def question_cols(src: str) -> str:
    """Question columns over a relation with collection, topic, topics, page_number, sentence_pos, sentence."""
    return f"""
q_opts AS (
  SELECT *, list_transform(
      list_sort(list_transform(
          list_concat([topic], list_transform(
              list_sort(list_transform(list_filter(topics, lambda t: t <> topic),
                                       lambda o: {{'h': md5(concat_ws('|', topic, o, sentence)), 't': o}}))[1:3],
              lambda x: x.t)),
          lambda o: {{'h': md5(concat_ws('|', o, sentence)), 't': o}})),
      lambda x: x.t) AS options
  FROM {src}),
q_rows AS (
  SELECT collection, topic, CAST(question_pos AS INTEGER) AS question_pos,
         sha256(concat_ws('|', collection, topic, CAST(page_number AS VARCHAR), CAST(sentence_pos AS VARCHAR))) AS id,
         'MCQ' AS type,
         array_to_string(list_transform(string_split(sentence, ' '),
                         lambda w: CASE WHEN {core('w')} = topic THEN '____' ELSE w END), ' ') AS question,
         CAST(list_position(topics, topic) AS INTEGER) AS topic_rank,
         options[1] AS option_a, options[2] AS option_b, options[3] AS option_c, options[4] AS option_d,
         substr('ABCD', CAST(list_position(options, topic) AS INTEGER), 1) AS correct_answer,
         CAST(page_number AS INTEGER) AS page_number,
         'Page ' || page_number || ': ' || sentence AS explanation,
         source_confidence
  FROM q_opts)"""


LEVEL_1 = TOPICS + f""",
sents_raw AS (
  SELECT collection, page_number, unnest(regexp_split_to_array(document, '{SENT_SPLIT}')) AS sentence,
         unnest(range(0, len(regexp_split_to_array(document, '{SENT_SPLIT}')))) AS sentence_pos
  FROM doc_chunks),
sents AS (SELECT * FROM sents_raw WHERE {not_blank('sentence')}),
matched AS (
  SELECT s.collection, s.page_number, CAST(s.sentence_pos AS INTEGER) AS sentence_pos, s.sentence, a.topics,
         unnest(list_filter(a.topics, lambda t: list_contains(
             list_transform(string_split(s.sentence, ' '), lambda w: {core('w')}), t))) AS topic
  FROM sents s JOIN topic_arrays a ON a.collection = s.collection AND len(a.topics) >= 4),
picked AS (
  SELECT *, NULL::DOUBLE AS source_confidence,
         row_number() OVER (PARTITION BY collection, topic ORDER BY page_number, sentence_pos) AS question_pos
  FROM matched QUALIFY question_pos <= 5),""" + question_cols("picked")

ORACLE["generate_level_1"] = "WITH " + LEVEL_1 + """
SELECT collection, topic, question_pos, id, type, question, option_a, option_b, option_c, option_d,
       correct_answer, page_number, explanation FROM q_rows"""

LEVEL_2 = TOPICS + f""",
l2_chunks AS (SELECT collection, page_number, document FROM doc_chunks),
l2_topics AS (SELECT collection, topic FROM topics),""" + embed_ctes("chunk_vecs", "l2_chunks", "document") + "," \
    + embed_ctes("topic_vecs", "l2_topics", "topic") + f""",
tp_pairs AS (
  SELECT t.collection, t.topic, c.page_number, c.document, {cosine('t.vec', 'c.vec')} AS distance
  FROM topic_vecs t JOIN chunk_vecs c ON c.collection = t.collection
  WHERE t.vec IS NOT NULL AND c.vec IS NOT NULL),
best AS (
  SELECT collection, topic, page_number, document, {confidence('distance')} AS source_confidence
  FROM tp_pairs
  QUALIFY row_number() OVER (PARTITION BY collection, topic ORDER BY round(distance, 9), page_number) = 1),
l2_sents AS (
  SELECT b.*, a.topics,
         unnest(regexp_split_to_array(b.document, '{SENT_SPLIT}')) AS sentence,
         unnest(range(0, len(regexp_split_to_array(b.document, '{SENT_SPLIT}')))) AS sentence_pos
  FROM best b JOIN topic_arrays a ON a.collection = b.collection AND len(a.topics) >= 4),
l2_hits AS (
  SELECT * FROM l2_sents
  WHERE {not_blank('sentence')}
    AND list_contains(list_transform(string_split(sentence, ' '), lambda w: {core('w')}), topic)),
l2_picked AS (
  SELECT collection, topic, topics, page_number, CAST(sentence_pos AS INTEGER) AS sentence_pos, sentence,
         source_confidence,
         row_number() OVER (PARTITION BY collection, topic ORDER BY sentence_pos) AS question_pos
  FROM l2_hits QUALIFY question_pos <= 10),""" + question_cols("l2_picked")

ORACLE["generate_level_2"] = "WITH " + LEVEL_2 + """
SELECT collection, topic, question_pos, id, type, question, option_a, option_b, option_c, option_d,
       correct_answer, page_number, explanation, source_confidence FROM q_rows"""

ORACLE["question_sources"] = "WITH " + LEVEL_2 + """
SELECT q.collection, q.topic, q.question_pos, b.document, CAST(b.page_number AS VARCHAR) AS page_number, b.source_confidence AS confidence
FROM q_rows q JOIN best b USING (collection, topic)"""

ORACLE["quiz_metadata_l1"] = "WITH " + LEVEL_1 + """,
lists AS (SELECT collection, book_title FROM titles),
cnt AS (SELECT collection, count(*) AS n FROM q_rows GROUP BY collection)
SELECT l.collection, CAST(coalesce(c.n, 0) AS INTEGER) AS total_questions, l.book_title, 'extractive' AS tool_used
FROM lists l LEFT JOIN cnt c USING (collection)"""

ORACLE["quiz_metadata_l2"] = "WITH " + LEVEL_2 + """,
lists AS (SELECT collection, book_title FROM titles),
cnt AS (SELECT collection, count(*) AS n FROM q_rows GROUP BY collection)
SELECT l.collection, CAST(coalesce(c.n, 0) AS INTEGER) AS total_questions, l.book_title, 'extractive' AS tool_used,
       'retrieval' AS generation_method, 'hashed-bow-64' AS embedding_model, 'parquet' AS vectore_store
FROM lists l LEFT JOIN cnt c USING (collection)"""

ORACLE["question_quality"] = "WITH " + LEVEL_1 + """
SELECT collection, count(*) AS n_questions,
       CAST(sum(CAST(NOT (type = 'MCQ' AND option_d IS NOT NULL AND correct_answer IN ('A','B','C','D')) AS INTEGER)) AS BIGINT) AS n_flagged
FROM q_rows GROUP BY collection"""

ORACLE["quiz_quarantine"] = "WITH " + TOPICS + """
SELECT c.collection, CASE WHEN a.collection IS NULL THEN 'no topics' ELSE 'fewer than 4 topics' END AS reason
FROM (SELECT DISTINCT collection FROM doc_chunks) c LEFT JOIN topic_arrays a USING (collection)
WHERE a.collection IS NULL OR len(a.topics) < 4"""


# ---------------------------------------------------------------- prompts, JSON parsing

from folio.functions.prompts import CHAT_TEMPLATE, QUESTION_TEMPLATE, TOPICS_TEMPLATE, render_sql  # noqa: E402

CTX = """
ctx AS (SELECT collection, string_agg(document, ' ' ORDER BY page_number) AS context FROM doc_chunks GROUP BY collection)"""

ORACLE["prompt_mcq"] = "WITH " + TOPICS + "," + CTX + f""",
p AS (SELECT t.collection, t.topic, {render_sql(QUESTION_TEMPLATE, n='5', topic='t.topic', context='c.context')} AS prompt
      FROM topics t JOIN ctx c USING (collection))
SELECT collection, topic, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_length FROM p"""

ORACLE["prompt_topics"] = "WITH " + DOC_CHUNKS + "," + CTX + f""",
p AS (SELECT collection, {render_sql(TOPICS_TEMPLATE, context='context')} AS prompt FROM ctx)
SELECT collection, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_length FROM p"""

CHAT_CTX = """,
chat_ctx AS (
  SELECT conv_id, turn, string_agg(document || ' Page number: ' || page_number || chr(10), '' ORDER BY rank) AS context,
         count(*) AS n_docs
  FROM retrieved GROUP BY conv_id, turn)"""

ORACLE["prompt_chat"] = "WITH " + chat_retrieve_cte(3) + CHAT_CTX + f""",
p AS (SELECT q.conv_id, q.turn,
             {render_sql(CHAT_TEMPLATE, question='q.question', context="coalesce(c.context, '')")} AS prompt
      FROM questions q LEFT JOIN chat_ctx c USING (conv_id, turn))
SELECT conv_id, turn, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_length FROM p"""

ORACLE["parse_questions"] = "WITH " + LEVEL_1 + """
SELECT collection, topic,
       sha256(concat_ws('|', collection, CAST(row_number() OVER (PARTITION BY collection ORDER BY topic_rank, question_pos) - 1 AS VARCHAR), question)) AS id,
       type, question, option_a, option_b, option_c, option_d, correct_answer, page_number, explanation FROM q_rows"""

ORACLE["parse_quarantine"] = "WITH " + LEVEL_1 + """
SELECT collection, topic, question_pos, CASE CAST(regexp_extract(collection, '(\\d+)$', 1) AS INTEGER) % 8
  WHEN 0 THEN 'accepted' WHEN 1 THEN 'options is not a list of strings' WHEN 2 THEN 'options is not a list of strings'
  WHEN 3 THEN 'question is not a string' WHEN 4 THEN 'question is not a string' WHEN 5 THEN 'page_number is not an integer'
  WHEN 6 THEN 'unexpected field: extra' ELSE 'invalid JSON' END AS reason
FROM q_rows"""

ORACLE["batch_generate"] = "WITH " + chat_retrieve_cte(3) + CHAT_CTX + """
SELECT q.conv_id || ':' || q.turn AS prompt_id,
       '{"question": ' || CAST(to_json(string_split(q.question, chr(10))[1]) AS VARCHAR)
         || ', "answer": ' || CAST(to_json(coalesce(string_split(c.context, chr(10))[1], '')) AS VARCHAR) || '}' AS response,
       CAST(NULL AS VARCHAR) AS error
FROM questions q LEFT JOIN chat_ctx c USING (conv_id, turn)"""

ORACLE["parse_topics"] = "WITH " + TOPICS + """
SELECT collection, book_title, total_topics, topic_rank, topic FROM topics"""


# ---------------------------------------------------------------- chat

WS_SPLIT = rf"[{BLANK_CLASS}]+"
NON_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{BLANK_CLASS}]"

GREETING_ROWS = """
greetings(greeting_key, reply) AS (VALUES
  ('hi', '👋 Hello! How can I assist you today?'),
  ('hello', '👋 Hello! What can I do for you?'),
  ('hey', '👋 Hey there! How can I help?'),
  ('good morning', '🌅 Good morning! What can I assist you with?'),
  ('good afternoon', '☀️ Good afternoon! How can I help you today?'),
  ('good evening', '🌙 Good evening! How may I assist you?'))"""


def normalized(x: str) -> str:
    return strip(f"lower(regexp_replace({x}, '{NON_WORD_OR_SPACE}', '', 'g'))")


ORACLE["validate_requests"] = f"""
SELECT conv_id, turn,
       (text IS NOT NULL AND {not_blank('text')}) AS accepted,
       CASE WHEN text IS NULL OR NOT {not_blank('text')} THEN 'Question cannot be empty.' END AS error
FROM conversations"""

ORACLE["normalize_text"] = f"SELECT conv_id, turn, {normalized('text')} AS normalized FROM conversations"

ORACLE["route_greetings"] = f"WITH {GREETING_ROWS}" + f"""
SELECT c.conv_id, c.turn, g.greeting_key IS NOT NULL AS is_greeting, g.reply
FROM conversations c LEFT JOIN greetings g ON g.greeting_key = {normalized('c.text')}
WHERE c.role = 'user'"""

CHAT_ANSWERS = chat_retrieve_cte(3) + "," + GREETING_ROWS + f""",
a_sents AS (
  SELECT conv_id, turn, rank, unnest(regexp_split_to_array(document, '{SENT_SPLIT}')) AS sentence,
         unnest(range(0, len(regexp_split_to_array(document, '{SENT_SPLIT}')))) AS pos
  FROM retrieved),
a_ov AS (
  SELECT s.conv_id, s.turn, s.rank, s.pos, s.sentence,
         len(list_intersect(list_distinct({tokens('s.sentence')}), list_distinct({tokens('q.question')}))) AS overlap
  FROM a_sents s JOIN questions q USING (conv_id, turn)
  WHERE {not_blank('s.sentence')}),
a_best AS (
  SELECT conv_id, turn, sentence, overlap FROM a_ov
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, rank, pos) = 1),
a_n AS (SELECT conv_id, turn, count(*) AS n FROM retrieved GROUP BY conv_id, turn),
answers AS (
  SELECT q.conv_id, q.turn, q.question,
         CASE WHEN g.greeting_key IS NOT NULL THEN g.reply
              WHEN b.overlap > 0 THEN b.sentence ELSE 'No answer provided.' END AS answer,
         CAST(CASE WHEN g.greeting_key IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END AS INTEGER) AS n_segments
  FROM questions q
  LEFT JOIN greetings g ON g.greeting_key = {normalized('q.question')}
  LEFT JOIN a_best b USING (conv_id, turn)
  LEFT JOIN a_n n USING (conv_id, turn))"""

ORACLE["chat_answer"] = "WITH " + CHAT_ANSWERS + " SELECT conv_id, turn, answer, n_segments FROM answers"

ORACLE["parse_chat"] = "WITH " + CHAT_ANSWERS + " SELECT conv_id, turn, question, answer FROM answers"

ORACLE["export_chat_log"] = "WITH " + CHAT_ANSWERS + """
SELECT a.conv_id, a.turn, a.question AS input, a.answer AS output,
       CASE WHEN a.n_segments = 0 THEN '' ELSE p.pages END AS segment_pages, true AS stamped
FROM answers a LEFT JOIN (SELECT conv_id, turn, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY rank) AS pages
                          FROM retrieved GROUP BY conv_id, turn) p USING (conv_id, turn)"""

ORACLE["stream_chat_log"] = "WITH " + CHAT_ANSWERS + """
SELECT conv_id || ':' || turn AS qid, question AS input, answer AS output, n_segments FROM answers"""

ORACLE["chat_generator"] = "WITH " + CHAT_ANSWERS + CHAT_CTX + """
SELECT a.conv_id || ':' || a.turn AS my_id,
       CASE WHEN r.reply IS NOT NULL THEN r.reply ELSE coalesce(string_split(c.context, chr(10))[1], '') END AS answer,
       CAST(NULL AS VARCHAR) AS error, a.n_segments
FROM answers a LEFT JOIN chat_ctx c USING (conv_id, turn) LEFT JOIN greetings r ON r.reply = a.answer"""

ORACLE["chat_log"] = "WITH " + CHAT_ANSWERS + """
SELECT conv_id, turn, question AS input, answer AS output, n_segments FROM answers"""

ORACLE["answer_tokens"] = f"""
WITH t AS (
  SELECT conv_id, turn, list_filter(regexp_split_to_array({strip('text')}, '{WS_SPLIT}'), lambda x: x <> '') AS toks
  FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, unnest(toks) AS token, unnest(range(0, len(toks))) AS pos FROM t)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token || ' ' AS token FROM u"""


# ---------------------------------------------------------------- instruction data

OPEN_INSTR = "Given the following context create me open ended question-answer pair"
MCQ_INSTR = "Given the following context create me MCQ questions with options and answer pair"

OPEN_ROWS = """
qa AS (
  SELECT u.conv_id, u.turn, u.text, n.role AS next_role, n.text AS next_text
  FROM conversations u LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
  WHERE u.role = 'user')"""

INSTRUCT_OPEN = OPEN_ROWS + f""",
open_rows AS (
  SELECT '{OPEN_INSTR}' AS instruction,
         'Title: ' || conv_id || chr(10) || 'Context: ' || text AS input,
         chr(10) || 'question: ' || text || ' ' || chr(10) || chr(10) || 'answer: ' || next_text || chr(10) AS output,
         conv_id || ':' || turn AS id
  FROM qa WHERE next_role = 'assistant')"""

INSTRUCT_MCQ = f"""
mcq_rows AS (
  SELECT '{MCQ_INSTR}' AS instruction, text AS input,
         chr(10) || 'question: ' || text || ' ' || chr(10) || chr(10) || 'answer: '
           || substr('ABCDEFGH', CAST(item_id % 8 + 1 AS INTEGER), 1) || chr(10) AS output,
         CAST(item_id AS VARCHAR) AS id
  FROM benchmark)"""

ORACLE["load_split"] = "SELECT * FROM conversations WHERE role = 'user'"
ORACLE["instruct_open"] = "WITH " + INSTRUCT_OPEN + " SELECT * FROM open_rows"
ORACLE["instruct_quarantine"] = "WITH " + OPEN_ROWS + """
SELECT conv_id || ':' || turn AS id, 'no answer' AS reason FROM qa WHERE next_role IS DISTINCT FROM 'assistant'"""
ORACLE["instruct_mcq"] = "WITH " + INSTRUCT_MCQ + " SELECT * FROM mcq_rows"
ORACLE["preview_instruct"] = "WITH " + INSTRUCT_OPEN + " SELECT * FROM open_rows ORDER BY id LIMIT 5"
ORACLE["merge_instruct"] = "WITH " + INSTRUCT_OPEN + "," + INSTRUCT_MCQ + """
SELECT * FROM mcq_rows UNION ALL SELECT * FROM open_rows"""


# ---------------------------------------------------------------- JSON round trips, raw retrieval shape, distances

ORACLE["export_questions"] = "WITH " + LEVEL_1 + """
SELECT collection, CAST(row_number() OVER (PARTITION BY collection ORDER BY topic_rank, question_pos) - 1 AS INTEGER) AS pos,
       id, topic, question, correct_answer, page_number FROM q_rows"""

ORACLE["export_questions_l2"] = "WITH " + LEVEL_2 + """,
cnt AS (SELECT collection, count(*) AS n FROM q_rows GROUP BY collection)
SELECT l.collection, CAST(coalesce(c.n, 0) AS INTEGER) AS total_questions, 'retrieval' AS generation_method,
       'hashed-bow-64' AS embedding_model, 'parquet' AS vectore_store, q.id, CAST(q.page_number AS VARCHAR) AS source_page
FROM titles l LEFT JOIN cnt c USING (collection) LEFT JOIN q_rows q USING (collection)"""

ORACLE["read_results"] = "WITH " + LEVEL_1 + """,
lists AS (SELECT collection, book_title FROM titles),
cnt AS (SELECT collection, count(*) AS n FROM q_rows GROUP BY collection)
SELECT l.collection, CAST(coalesce(c.n, 0) AS INTEGER) AS total_questions, l.book_title, 'extractive' AS tool_used
FROM lists l LEFT JOIN cnt c USING (collection)"""

ORACLE["read_page_map"] = "WITH " + pages_cte() + " SELECT collection, page_number, text FROM doc_pages"

ORACLE["flatten_results"] = "WITH " + chat_retrieve_cte(3) + f"""
SELECT conv_id, turn, chunk_id, CAST(page_number AS VARCHAR) AS page_number, {confidence('distance')} AS confidence
FROM retrieved"""

ORACLE["vector_distances"] = f"""
WITH v AS (SELECT vec_id, 'label_' || label AS collection, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, q.e AS a, c.e AS b,
         {cosine('q.e', 'c.e')} AS distance
  FROM v q JOIN v c ON q.collection = c.collection AND q.vec_id <> c.vec_id),
top AS (SELECT * FROM pairs WHERE isfinite(distance)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) <= 5)
SELECT query_id, neighbor_id, round(distance, 6) AS cosine,
       round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS l2sq,
       round(1 - list_dot_product(a, b), 6) AS ip
FROM top"""

ORACLE["stream_ingest"] = "WITH " + DOC_CHUNKS + " SELECT collection, chunk_id, page_number FROM doc_chunks"

ORACLE["stream_chat"] = "WITH " + chat_retrieve_cte(3) + f"""
SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, chunk_id, {confidence('distance')} AS confidence FROM retrieved"""

ORACLE["reset"] = "WITH " + DOC_CHUNKS + " SELECT count(*) AS chunks_before, CAST(0 AS BIGINT) AS chunks_after FROM doc_chunks"

ORACLE["retrieve_topk_blocks"] = ORACLE["retrieve_topk"]

# label groups here are smaller than a bucket, so the search is exact
ORACLE["retrieve_lsh"] = f"SELECT query_id, rank, neighbor_id, confidence, CAST(1.0 AS DOUBLE) AS recall FROM ({ORACLE['retrieve_topk']})"

ORACLE["chat"] = ORACLE["chat_answer"]

ORACLE["page_map_json"] = "WITH " + pages_cte() + """
SELECT collection,
       CAST(to_json(map_from_entries(list((CAST(page_number AS VARCHAR), text) ORDER BY page_number))) AS VARCHAR) AS json
FROM doc_pages GROUP BY collection"""


# ---------------------------------------------------------------- generator path (the stand-in client), pieces, stored index

MODEL_TOPICS = DOC_CHUNKS + "," + CTX + """,
words AS (SELECT collection, unnest(w) AS topic, generate_subscripts(w, 1) AS pos
          FROM (SELECT collection, list_filter(string_split_regex(lower(context), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 6) AS w FROM ctx)),
firsts AS (SELECT collection, topic, min(pos) AS pos FROM words GROUP BY collection, topic),
topics AS (SELECT collection, topic, CAST(row_number() OVER (PARTITION BY collection ORDER BY pos) AS INTEGER) AS topic_rank FROM firsts
           QUALIFY row_number() OVER (PARTITION BY collection ORDER BY pos) <= 10),
asked AS (SELECT *, unnest(range(1, 6)) AS i FROM topics)"""

ORACLE["generate_level_1_model"] = "WITH " + MODEL_TOPICS + """
SELECT collection, topic_rank, topic, CAST(i AS INTEGER) AS question_pos, i || '. Is ' || topic || ' named? True' AS question, CAST(i AS INTEGER) AS page_number FROM asked"""

ORACLE["quiz_quarantine_model"] = "WITH " + MODEL_TOPICS + """
SELECT collection, 'more than 5 questions' AS reason, count(*) AS n FROM topics GROUP BY collection
UNION ALL SELECT DISTINCT collection, 'no topics', 1 FROM doc_chunks WHERE collection NOT IN (SELECT collection FROM topics)"""

ORACLE["export_questions_model"] = "WITH " + MODEL_TOPICS + """,
named AS (SELECT DISTINCT collection FROM doc_chunks),
total AS (SELECT collection, count(*) AS n, 'Book of ' || min(topic) FILTER (topic_rank = 1) AS book_title FROM asked GROUP BY collection)
SELECT collection, coalesce(book_title, 'Book of nothing') AS book_title, CAST(coalesce(n, 0) AS INTEGER) AS total_questions,
       CAST(row_number() OVER (PARTITION BY collection ORDER BY topic_rank, i) - 1 AS INTEGER) AS pos, topic, i || '. Is ' || topic || ' named? True' AS question
FROM named LEFT JOIN total USING (collection) LEFT JOIN asked USING (collection)"""

ORACLE["collection_pieces"] = "WITH " + DOC_CHUNKS + "," + CTX + """
SELECT collection, CAST(length(context) AS BIGINT) AS length, md5(context) AS text_md5 FROM ctx"""

ORACLE["retrieve_pruned"] = ORACLE["retrieve_topk"]

# visible text of HTML: scripts and styles out, block ends to line breaks, other tags to blanks, then the named characters
_S = r"regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g')"
_S = rf"regexp_replace(regexp_replace({_S}, '(?i)<\s*(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _S = f"replace({_S}, '&{_name};', '{_char}')"
HTML_PAGES = rf"""
lined AS (SELECT *, list_filter(list_transform(string_split({_S.format('html')}, chr(10)),
                    lambda x: array_to_string(list_filter(string_split_regex(x, '[\s\x0b\x1c-\x1f\p{{Z}}\x{{85}}]+'), lambda y: y <> ''), ' ')), lambda x: x <> '') AS lines FROM raw),
html_pages AS (SELECT * EXCLUDE (lines), CAST(n AS INTEGER) AS page_number, array_to_string(list_slice(lines, (n - 1) * 5 + 1, n * 5), chr(10)) AS text
               FROM (SELECT *, unnest(range(1, greatest(CAST(ceil(len(lines) / 5.0) AS BIGINT), 1) + 1)) AS n FROM lined))"""

ORACLE["extract_pages"] = f"""WITH raw AS (SELECT page_id, html, {coll_name('url')} AS collection FROM pages), {HTML_PAGES}
SELECT CAST(page_id AS VARCHAR) AS source_id, page_number, text, CAST(NULL AS VARCHAR) AS error, collection FROM html_pages"""

ORACLE["extract_pages_sql"] = ORACLE["extract_pages"]

# files of one name: the smallest content; names of one collection: the smallest text of each page
ORACLE["ingest_files"] = f"""WITH raw AS (SELECT url, {coll_name('url')} AS collection, min(html) AS html FROM pages WHERE ends_with(lower(url), '.html') GROUP BY url), {HTML_PAGES}
SELECT DISTINCT collection, 'page_' || page_number AS chunk_id, page_number FROM html_pages WHERE {not_blank('text')}"""

ORACLE["stream_files"] = f"""WITH raw AS (
  SELECT 'set_' || (page_id // 50) || '_html' AS collection, string_agg(html || chr(10), '' ORDER BY page_id) AS html FROM pages GROUP BY page_id // 50), {HTML_PAGES}
SELECT collection, 'page_' || page_number AS chunk_id, page_number, md5(text) AS text_md5 FROM html_pages WHERE {not_blank('text')}"""

ORACLE["stream_sessions"] = f"""WITH {GREETING_ROWS}, t AS (SELECT conv_id, turn, role, text, {normalized('text')} AS normalized FROM conversations)
SELECT conv_id, turn, role, false AS late, coalesce(role = 'user' AND reply IS NOT NULL, false) AS is_greeting, md5(text) AS text_md5,
       CASE WHEN role = 'user' THEN reply END AS reply FROM t LEFT JOIN greetings ON normalized = greeting_key"""

ORACLE["page_interval_wide"] = "WITH " + pages_cte() + "," + DOC_COUNTS + "," + PAGE_REQUESTS + """,
texts AS (SELECT r.collection, r.page_number, string_agg(p.text, '' ORDER BY p.page_number) AS text
          FROM (SELECT DISTINCT collection, page_number FROM requests) r JOIN doc_pages p ON p.collection = r.collection AND p.page_number BETWEEN r.page_number - 500 AND r.page_number + 500
          GROUP BY r.collection, r.page_number)
SELECT collection, page_number, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason,
       CASE WHEN reason IS NULL THEN CAST(length(text) AS INTEGER) END AS length, CASE WHEN reason IS NULL THEN md5(text) END AS text_md5
FROM checked LEFT JOIN texts USING (collection, page_number)"""
