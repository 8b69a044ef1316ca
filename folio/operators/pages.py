"""Page-level operators: split, lookup, intervals, full text, counts.

A document is one row; its pages are computed inside that row (``transform`` over a
``sequence``) and exploded, so splitting never shuffles. Operators that read a stored page
table (``collection_text``, ``page_window``, ``page_interval``) group by collection; a
collection is one document, so each group is bounded by the size of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import not_blank

LINES_PER_PAGE = 5


def _page_array(lines: Column, lines_per_page: int) -> Column:
    """Pages of a line array. ``lines`` should be a column of its own projection: it is
    referenced twice here, so Catalyst does not inline the split into the per-page lambda."""
    n_pages = F.ceil(F.size(lines) / F.lit(float(lines_per_page))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n_pages - 1),
        lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, F.lit(lines_per_page)), "\n"),
    )


def _with_lines(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).withColumn("__lines", F.split(F.col(text_col), "\n", -1))


def split_pages(docs: DataFrame, text_col: str = "text", lines_per_page: int = LINES_PER_PAGE,
                keep: tuple[str, ...] = ("doc_id", "source"), collection: Column | None = None) -> DataFrame:
    """documents -> ``pages(collection, <keep>, page_number, text)``, pages numbered from 1.

    The default stand-in extractor: ``lines_per_page`` lines per page. Narrow: no shuffle.
    """
    coll = collection if collection is not None else F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return (
        _with_lines(docs, text_col)
        .select(coll.alias("collection"), *keep,
                F.posexplode(_page_array(F.col("__lines"), lines_per_page)).alias("pos", "text"))
        .select("collection", *keep, (F.col("pos") + 1).cast("int").alias("page_number"), "text")
    )


def rejected_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, reason)`` of the documents that give no page: those without a text."""
    return docs.where(F.col(text_col).isNull()).select("doc_id", F.lit("no text").alias("reason"))


def document_full_text(docs: DataFrame, text_col: str = "text", lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Whole text of each document, pages in order with **no** separator (the extractor's view).

    Computed inside the document row; no grouping.
    """
    pages = _page_array(F.col("__lines"), lines_per_page)
    return _with_lines(docs, text_col).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("collection"),
        F.size(pages).cast("int").alias("n_pages"),
        F.array_join(pages, "").alias("full_text"),
    )


def page_counts(docs: DataFrame, text_col: str = "text", lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    lines = F.split(F.col(text_col), "\n", -1)
    return docs.where(F.col(text_col).isNotNull()).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("collection"),
        F.ceil(F.size(lines) / F.lit(float(lines_per_page))).cast("int").alias("n_pages"),
    )


def nonblank(pages: DataFrame, text_col: str = "text") -> DataFrame:
    return pages.where(not_blank(text_col))


def ordered_concat(key: Column, value: Column, sep: str = "") -> Column:
    """Aggregate: ``value`` joined by ``sep`` in ``key`` order (ordered string aggregate)."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"]),
        sep,
    )


def collection_text(chunks: DataFrame, sep: str = " ") -> DataFrame:
    """All stored text of each collection joined by one space, numeric page order."""
    return chunks.groupBy("collection").agg(
        F.count(F.lit(1)).cast("int").alias("n_pages"),
        ordered_concat(F.col("page_number"), F.col("document"), sep).alias("text"),
    )


def single_page(requests: DataFrame, pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Requests ``(collection, page_number)`` -> page text, or a reject reason.

    ``page_number < 1`` or past the last page is rejected; an unknown collection as well.
    """
    r = requests.join(counts, "collection", "left")
    status = (F.when(F.col("n_pages").isNull(), F.lit("unknown collection"))
              .when(F.col("page_number") < 1, F.lit("page number below 1"))
              .when(F.col("page_number") > F.col("n_pages"), F.lit("invalid page number")))
    r = r.withColumn("reason", status)
    p = pages.select("collection", "page_number", "text")
    return (r.join(p, ["collection", "page_number"], "left")
            .select("collection", "page_number",
                    F.when(F.col("reason").isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
                    "reason",
                    F.when(F.col("reason").isNull(), F.col("text")).alias("text")))


def page_interval(requests: DataFrame, pages: DataFrame, counts: DataFrame, k: int = 1) -> DataFrame:
    """Text of pages ``n-k .. n+k`` clamped to the document, no separator; ``n`` out of range rejected.

    An interval join by bins of ``2k+1`` pages: a page lies in one bin and an interval meets two at most, whatever
    ``k`` is, so that is what is shuffled of a request. What a request finds in a bin is joined to one text where the
    two meet, on ``(collection, bin)``, which holds ``2k+1`` pages and the requests about them, however long the document is.
    """
    # each different request once; repeated requests get its answer each
    once = requests.select("collection", "page_number").distinct()
    r = (once.join(counts, "collection", "left")
         .withColumn("reason", F.when(F.col("n_pages").isNull(), F.lit("unknown collection"))
                     .when(F.col("page_number") < 1, F.lit("page number below 1"))
                     .when(F.col("page_number").isNull() | (F.col("page_number") > F.col("n_pages")), F.lit("invalid page number"))))
    r = r.select("collection", "page_number", "reason", F.greatest(F.lit(1), F.col("page_number") - k).alias("lo"), F.least(F.col("n_pages"), F.col("page_number") + k).alias("hi"))
    width = 2 * k + 1
    bins = F.array_distinct(F.array(F.expr(f"lo div {width}"), F.expr(f"hi div {width}")))
    asked = r.where(F.col("reason").isNull()).select("collection", "page_number", "lo", "hi", F.explode(bins).alias("bin"))
    p = pages.select("collection", F.expr(f"page_number div {width}").alias("bin"), F.col("page_number").alias("p_page"), F.col("text").alias("p_text"))
    met = asked.join(p, ["collection", "bin"]).where(F.col("p_page").between(F.col("lo"), F.col("hi")))
    parts = met.groupBy("collection", "bin", "page_number").agg(ordered_concat(F.col("p_page"), F.col("p_text"), "").alias("part"))      # where they met
    texts = parts.groupBy(F.col("collection").alias("of_collection"), F.col("page_number").alias("of_page")).agg(ordered_concat(F.col("bin"), F.col("part"), "").alias("text"))
    reasons = r.select(F.col("collection").alias("r_collection"), F.col("page_number").alias("r_page"), "reason")
    same = F.col("collection").eqNullSafe(F.col("r_collection")) & F.col("page_number").eqNullSafe(F.col("r_page"))
    answered = requests.select("collection", "page_number").join(reasons, same).join(
        texts, (F.col("collection") == F.col("of_collection")) & (F.col("page_number") == F.col("of_page")), "left")
    return answered.select(
        "collection", "page_number",
        F.when(F.col("reason").isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
        "reason", F.when(F.col("reason").isNull(), F.coalesce("text", F.lit(""))).alias("text"))


def page_window(pages: DataFrame, k: int = 1, range_pages: int = 64) -> DataFrame:
    """For every page, the text of pages ``n-k .. n+k`` of its document (a sliding frame).

    Documents are cut into ranges of ``range_pages`` pages; only the ``k`` pages next to a border
    are copied into the neighbouring range. So a window holds a range, whatever the size of a
    document, and a text is shuffled about once.
    """
    n = F.col("page_number")

    def range_of(x):
        return F.floor((x - 1) / range_pages)
    fan = pages.select("collection", "page_number", "text",
                       F.explode(F.sequence(range_of(n - k), range_of(n + k))).alias("part"))
    w = Window.partitionBy("collection", "part").orderBy("page_number").rangeBetween(-k, k)
    own = fan.withColumn("window_text", F.array_join(F.collect_list("text").over(w), ""))
    return own.where(F.col("part") == range_of(n)).select("collection", "page_number", "window_text")


PIECE_PAGES = 64


def collection_pieces(chunks: DataFrame, max_chars: int, sep: str = " ") -> DataFrame:
    """``collection, block, sub, glue, text``: a collection's text in ordered pieces of at most ``max_chars`` characters.

    The pieces in the order of (block, sub), each but the first behind its ``glue``, are the
    :func:`collection_text`. A block is a range of PIECE_PAGES page numbers; within it, pages (or
    parts of pages, cut behind white space where there is some) are packed by a running length.
    So no group holds more than a block of pages, however long the collection is, and texts are
    shuffled once."""
    half = max(1, max_chars // 2 - len(sep))
    parts = F.regexp_extract_all("document", F.lit(rf"(?s).{{1,{half}}}(?:(?<=\s)|\z)|.{{1,{half}}}"), 0)
    p = chunks.select("collection", "page_number", F.expr(f"page_number div {PIECE_PAGES}").cast("int").alias("block"),
                      F.posexplode(F.when(F.length("document") <= half, F.array("document")).otherwise(parts)).alias("part", "text"))
    before = Window.partitionBy("collection", "block").orderBy("page_number", "part").rowsBetween(Window.unboundedPreceding, -1)
    size = half + len(sep)
    p = p.withColumn("sub", (F.coalesce(F.sum(F.length("text") + len(sep)).over(before), F.lit(0)) / size).cast("int"))
    glue = F.when(F.col("part") == 0, F.lit(sep)).otherwise(F.lit(""))
    packed = p.groupBy("collection", "block", "sub").agg(F.min_by(glue, F.struct("page_number", "part")).alias("glue"),
                                                         ordered_concat(F.struct("page_number", "part"), F.concat(glue, "text"), "").alias("text"))
    return packed.select("collection", "block", "sub", "glue", F.expr("substr(text, length(glue) + 1)").alias("text"))
