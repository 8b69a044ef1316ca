"""Structured Streaming: incremental ingest and a question stream answered against the store.

Both are ``readStream`` -> ``foreachBatch``: per micro-batch the batch operators run
unchanged (page split, blank filter, in-batch dedupe, anti join against the store, append;
or retrieval against a static chunk snapshot). Progress lives in a checkpoint under the
cluster's shared ``spark.checkpoint.dir``; a replayed batch writes the same rows again
(ingest: the anti join finds them stored; chat: the batch's own folder is overwritten).
Top-k per question is not a time window, which a streaming aggregation could not express,
so it runs inside ``foreachBatch`` on each micro-batch as a static frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import chunks as ch
from folio.operators.pages import split_pages

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def stream_ingest(spark: SparkSession, source_dir: str, glob: str, store_path: str, checkpoint: str,
                  schema: T.StructType = DOC_SCHEMA, max_files: int = 100) -> dict:
    """Run the incremental ingest until no file is left (``availableNow``); returns totals."""
    totals = {"batches": 0, "added": 0}

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        pages = split_pages(batch.select("doc_id", "text", "source"))
        r = ch.ingest_pages(batch.sparkSession, pages, store_path)
        totals["batches"] += 1
        totals["added"] += r["added"]

    q = (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
         .parquet(source_dir)
         .writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return totals


def stream_questions(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType, out_path: str,
                     checkpoint: str, answer: Callable[[DataFrame], DataFrame], max_files: int = 100) -> None:
    """Answer every micro-batch of questions with ``answer`` and append the rows.

    Idempotent per batch: rows of batch ``b`` go to ``<out>/batch_id=b`` with overwrite, so a
    batch replayed after a failure replaces its own output instead of duplicating it.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
         .parquet(source_dir)
         .writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_files(spark: SparkSession, source_dir: str, glob: str, store_path: str, registry: str, checkpoint: str, ext: str = ".html",
                 extractor=None, embedder=None, max_files: int = 1000, rejects: str | None = None, name: Column | None = None) -> dict:
    """Files as they arrive (``binaryFile``), each through the extension check, the registry of names, the extractor and the
    store, until no file is left (``availableNow``); returns totals. ``rejects``: a folder for ``name, reason`` of what was
    left out, one subfolder a batch, which a replay of the batch overwrites.

    A file's name is the last part of its path, and its folder does not count, as with an upload (``name``: another column made of ``path``). Two files of one
    name in one batch are decided by their content, in two batches by arrival."""
    from folio import api
    totals = {"batches": 0, "added": 0, "failed": 0, "rejected": 0}

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        files = batch.select((F.element_at(F.split("path", "/"), -1) if name is None else name).alias("name"), "content")
        counts, left_out = api.ingest_files(batch.sparkSession, files, store_path, registry, ext, extractor, embedder)
        totals["batches"] += 1
        for k in ("added", "failed"):
            totals[k] += counts[k]
        totals["rejected"] += left_out.count()
        if rejects:
            left_out.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")

    q = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
         .load(source_dir)
         .writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return totals
