"""Chunk store: pages -> chunks (id, metadata, embedding); dedupe; append; reset.

The store is one Parquet table partitioned by ``bucket = pmod(xxhash64(collection), 64)``:
a folder per collection would be one small file per document at scale, while a fixed
number of hash buckets keeps files large and still lets a one-collection read prune to one
bucket. "Already stored" is a left anti join, never a driver-side id set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import not_blank
from folio.functions.vector import DEFAULT_DIM, sum_squares, with_hashed_embedding, with_slot_counts

N_BUCKETS = 64

CHUNK_SCHEMA = T.StructType([
    T.StructField("collection", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("document", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("page_number", T.StringType())])),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
STORE_SCHEMA = T.StructType(CHUNK_SCHEMA.fields + [T.StructField("bucket", T.IntegerType())])


def bucket_of(collection: Column) -> Column:
    return F.pmod(F.xxhash64(collection), F.lit(N_BUCKETS)).cast("int")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def chunk_id(page_number: Column) -> Column:
    return F.concat(F.lit("page_"), page_number.cast("string"))


def model_embedder(fn: Callable[[list[str]], np.ndarray], dim: int) -> Callable[[Column], Column]:
    """Wrap an injected embedding model (texts -> matrix) as an Arrow-batched pandas UDF. A text that
    fails (alone, after its batch failed) has a null embedding."""
    def rows(texts: list[str]) -> list:
        return list(np.asarray(fn(texts), dtype=np.float32).reshape(len(texts), dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        try:
            return pd.Series(rows(texts))
        except Exception:  # noqa: BLE001
            out = []
            for t in texts:
                try:
                    out.append(rows([t])[0])
                except Exception:  # noqa: BLE001
                    out.append(None)
            return pd.Series(out, dtype=object)
    return lambda c: _embed(c)


def to_chunks(pages: DataFrame, embedder: Callable[[Column], Column] | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Non-blank pages -> chunk rows. Blank test runs before the (costly) embedding."""
    p = pages.where(not_blank("text"))
    if embedder is None:
        p = with_hashed_embedding(p, "text", "embedding", DEFAULT_DIM)
    else:
        p = p.withColumn("embedding", embedder(F.col("text")))
    return p.select(
        "collection", *keep,
        chunk_id(F.col("page_number")).alias("chunk_id"),
        "page_number",
        F.col("text").alias("document"),
        F.struct(F.col("page_number").cast("string").alias("page_number")).alias("metadata"),
        "embedding",
    )


def embed_stats(pages: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """Exact, engine-independent view of the default embedding: slot counts and their square sum."""
    p = with_slot_counts(pages.where(not_blank("text")), "text", "counts", dim)
    counts = F.col("counts")
    return p.select(
        "collection", chunk_id(F.col("page_number")).alias("chunk_id"), "page_number",
        F.size(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")).alias("n_tokens"),
        sum_squares(counts).alias("sumsq"),
        F.md5(F.array_join(F.transform(counts, lambda v: v.cast("string")), ",")).alias("slots_md5"),
    )


def new_chunks(offered: DataFrame, stored: DataFrame) -> DataFrame:
    """Offered rows whose ``(collection, chunk_id)`` is not stored yet (first writer wins). With a
    ``bucket`` on both sides it is part of the key, and each bucket meets its own folder."""
    keys = [c for c in ("bucket", "collection", "chunk_id") if c in offered.columns and c in stored.columns]
    return offered.join(stored.select(*keys), keys, "left_anti")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def scan_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """One collection's chunks: the bucket predicate prunes to one partition folder."""
    s = read_store(spark, path)
    return s.where((F.col("bucket") == bucket_of(F.lit(collection))) & (F.col("collection") == collection))


def scan_collections(spark: SparkSession, path: str, collections: DataFrame) -> DataFrame:
    """The stored chunks of the named collections (each named once or more)."""
    wanted = collections.select("collection").distinct().withColumn("bucket", bucket_of(F.col("collection")))
    return read_store(spark, path).join(wanted, ["bucket", "collection"], "left_semi")


def _append(new: DataFrame, path: str) -> int:
    """Write chunk rows to the store; returns how many."""
    obs = Observation("ingest")
    new = new.observe(obs, F.count(F.lit(1)).alias("added"))
    (new.select(*[f.name for f in CHUNK_SCHEMA.fields], bucket_of(F.col("collection")).alias("bucket"))
     # rebalance: AQE splits a bucket that holds a hot collection and merges small ones
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", "collection", "page_number")
     .write.mode("append").partitionBy("bucket").parquet(path))
    try:
        return int(obs.get.get("added", 0) or 0)
    except Py4JJavaError:       # the plan turned out empty, so nothing was observed
        return 0


def _first(rows: DataFrame, order: str) -> DataFrame:
    """One row a ``(collection, chunk_id)``: the one with the smallest ``order``."""
    rest = [c for c in rows.columns if c not in ("collection", "chunk_id")]
    return rows.groupBy("collection", "chunk_id").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select("collection", "chunk_id", "r.*")


def ingest_append(spark: SparkSession, offered: DataFrame, path: str) -> dict:
    """Append ready chunk rows that are new to the store; returns counts. Nothing new is not an error.

    Of rows of one id in the batch the smallest text wins; what is stored already is left out by an
    anti join before anything is written; one job, one commit.
    """
    rows = offered.withColumn("bucket", bucket_of(F.col("collection")))
    return {"added": _append(_first(new_chunks(rows, read_store(spark, path)), "document"), path)}


def ingest_pages(spark: SparkSession, pages: DataFrame, path: str,
                 embedder: Callable[[Column], Column] | None = None, order: str = "text") -> dict:
    """Pages ``(collection, page_number, text)`` into the store: blank ones are left out, of rows of
    one page the one with the smallest ``order`` wins, stored ones are left out, and only what
    is left is embedded. Returns ``added`` and ``failed`` (pages an injected embedder failed
    on: not stored, so a later run offers them again)."""
    p = pages.where(not_blank("text")).withColumn("chunk_id", chunk_id(F.col("page_number"))).withColumn("bucket", bucket_of(F.col("collection")))
    own = dict.fromkeys(["bucket", "collection", "chunk_id", "page_number", "text", order])
    new = _first(new_chunks(p.select(*own), read_store(spark, path)), order)
    if embedder is None:
        return {"added": _append(to_chunks(new), path), "failed": 0}
    from folio.session import materialize
    embedded = materialize(to_chunks(new, embedder), "embedded")    # a model is not run again if an executor is lost
    failed = embedded.where("embedding IS NULL").count()
    return {"added": _append(embedded.where("embedding IS NOT NULL"), path), "failed": failed}


def reset(spark: SparkSession, path: str) -> None:
    """Remove all chunks of all collections: overwrite with an empty frame of the same schema, whatever
    the session says about partition overwrites."""
    (spark.createDataFrame([], STORE_SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("bucket").parquet(path))
