"""Pages, intervals, re-ingest, store append/reset."""

import uuid

from pyspark.sql import functions as F

from folio.operators import chunks, pages


def _pages(spark, data):
    return spark.createDataFrame(data, "collection string, page_number int, text string")


def test_split_pages_five_lines(spark):
    text = "\n".join(f"l{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    got = [(r.page_number, r.text) for r in pages.split_pages(docs).orderBy("page_number").collect()]
    assert got == [(1, "l0\nl1\nl2\nl3\nl4"), (2, "l5\nl6\nl7\nl8\nl9"), (3, "l10\nl11")]
    ft = pages.document_full_text(docs).first()
    assert ft.full_text == "".join(t for _, t in got) and ft.n_pages == 3


def test_numeric_page_order(spark):
    p = _pages(spark, [("c", 10, "ten"), ("c", 2, "two"), ("c", 1, "one")]).withColumnRenamed("text", "document")
    assert pages.collection_text(p).first().text == "one two ten"


def test_interval_k1(spark):
    p = _pages(spark, [("c", 1, "A"), ("c", 2, "B"), ("c", 3, "C")])
    counts = spark.createDataFrame([("c", 3)], "collection string, n_pages int")
    req = spark.createDataFrame([("c", n) for n in (1, 2, 3, 4, 0)], "collection string, page_number int")
    got = {r.page_number: (r.status, r.text) for r in pages.page_interval(req, p, counts, k=1).collect()}
    assert got[1] == ("ok", "AB") and got[2] == ("ok", "ABC") and got[3] == ("ok", "BC")
    assert got[4][0] == "rejected" and got[0][0] == "rejected"
    single = {r.page_number: r.status for r in pages.single_page(req, p, counts).collect()}
    assert single == {1: "ok", 2: "ok", 3: "ok", 4: "rejected", 0: "rejected"}


def test_blank_pages_not_stored(spark):
    p = _pages(spark, [("c", 1, ""), ("c", 2, "  "), ("c", 3, "\n\t"), ("c", 4, "a")])
    assert [r.page_number for r in chunks.to_chunks(p).collect()] == [4]


def test_reingest_first_writer_wins(spark, tmp_path):
    path = str(tmp_path / f"store-{uuid.uuid4().hex}")
    first = chunks.to_chunks(_pages(spark, [("c", 1, "one"), ("c", 2, "two"), ("c", 3, "three")]))
    second = chunks.to_chunks(_pages(spark, [("c", 2, "TWO"), ("c", 3, "THREE"), ("c", 4, "four")]))
    assert chunks.ingest_append(spark, first, path)["added"] == 3
    assert chunks.ingest_append(spark, second, path)["added"] == 1
    assert chunks.ingest_append(spark, second, path)["added"] == 0
    store = {r.page_number: r.document for r in chunks.read_store(spark, path).collect()}
    assert store == {1: "one", 2: "two", 3: "three", 4: "four"}
    chunks.reset(spark, path)
    assert chunks.read_store(spark, path).count() == 0
