"""Files that arrive as a stream: extension, names, extraction, store; and the table function."""

import os

from pyspark.sql import functions as F

from folio import api
from folio.operators import chunks
from folio.sources.files import extract_pages, extract_pages_lateral, register_pages_function
from folio.streaming.ingest import stream_files

PAGE = "<html><body>" + "".join("<p>{0} line %d</p>" % i for i in range(7)) + "</body></html>"


def test_files_in_several_batches_equal_the_batch_ingest(spark, tmp_path):
    put = tmp_path / "in"
    files = {f"set{k}/file {k}.html": PAGE.format(k) for k in range(6)} | {"set0/notes.txt": "text", "set1/UP.HTML": PAGE.format("up"), "set2/empty.html": "", "set3/bad.html": b"\xff\xfe\x00"}
    for name, content in files.items():
        os.makedirs(put / os.path.dirname(name), exist_ok=True)
        (put / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    run = lambda at: stream_files(spark, str(put), "*", str(tmp_path / "store"), str(tmp_path / "registry"), str(tmp_path / at), max_files=3, rejects=str(tmp_path / f"rejects-{at}"))
    first = run("one")
    assert first["batches"] >= 3 and first["added"] == 14 and first["rejected"] == 2
    left_out = {r["name"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "rejects-one")).collect()}
    assert set(left_out) == {"notes.txt", "bad.html"} and "Only .html" in left_out["notes.txt"]
    assert run("lost")["added"] == 0                        # the checkpoint is lost: all files come again
    (put / "set0" / "late.html").write_text(PAGE.format("late"))
    assert run("one")["added"] == 2 and run("one") == {"batches": 0, "added": 0, "failed": 0, "rejected": 0}
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(put)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    counts, _ = api.ingest_files(spark, whole, str(tmp_path / "store-2"), str(tmp_path / "registry-2"))
    rows = lambda store: sorted(tuple(r) for r in chunks.read_store(spark, str(tmp_path / store)).select("collection", "chunk_id", "page_number", "document").collect())
    assert counts["added"] == 16 and rows("store") == rows("store-2")


def test_table_function_gives_the_same_pages(spark):
    files = spark.createDataFrame([("a", PAGE.format("x").encode(), 1), ("b", b"\xff\xfe", 2), ("c", b"", 3), ("d", b"<p>one</p>", 4)], "name string, content binary, keep int")
    want = sorted(map(str, extract_pages(files, "name", "content", keep=("keep",)).collect()))
    assert sorted(map(str, extract_pages_lateral(files, "name", "content", keep=("keep",)).collect())) == want
    register_pages_function(spark, "own_pages")
    got = spark.sql("SELECT f.name AS source_id, p.*, f.keep FROM {files} f, LATERAL own_pages(f.content) p", files=files)
    assert sorted(map(str, got.collect())) == want and got.where("error IS NOT NULL").count() == 1
