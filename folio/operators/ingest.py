"""Ingest rules: supported files, new files, collection resolution, stats, text fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import has_extension, not_blank, tokens


def filter_supported(files: DataFrame, name_col: str, ext: str) -> DataFrame:
    """Adds ``supported`` (case-insensitive extension test) and a ``reason`` for rejects."""
    ok = has_extension(F.col(name_col), ext)
    return files.select("*", ok.alias("supported"),
                        F.when(~ok, F.lit(f"Only {ext} files are supported.")).alias("reason"))


def new_files(files: DataFrame, registry: DataFrame, name_col: str = "url", order_col: str = "page_id") -> DataFrame:
    """Files whose *name* is not in the registry; of files of one name the lowest ``order_col`` wins.

    A new file whose name maps to a stored collection stays: its unseen pages are added to it.
    ``min_by`` is a partial + final aggregate, so a name with many arrivals is combined
    map-side instead of being sorted in one task.
    """
    fresh = files.join(registry.select(name_col).distinct(), name_col, "left_anti")
    rest = [c for c in files.columns if c != name_col]
    return fresh.groupBy(name_col).agg(F.min_by(F.struct(*rest), order_col).alias("r")).select(name_col, "r.*")


def name_collisions(files: DataFrame, name_col: str = "url") -> DataFrame:
    """Collections that files of different names map to, with how many."""
    return (files.select("collection", name_col).distinct().groupBy("collection")
            .agg(F.count(F.lit(1)).alias("n_files"), F.min(name_col).alias("first_file")).where("n_files > 1"))


def ingest_stats(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Per collection: pages offered, blank, already stored, zero-vector (no tokens), added."""
    s = stored.select("collection", F.col("page_number").alias("sp"), F.lit(True).alias("is_stored"))
    p = pages.join(s, (pages["collection"] == s["collection"]) & (pages["page_number"] == s["sp"]), "left") \
        .drop(s["collection"])
    blank = ~not_blank(F.col("text"))
    known = F.coalesce(F.col("is_stored"), F.lit(False))
    zero = ~blank & (F.size(tokens(F.col("text"))) == 0)
    added = ~blank & ~known
    as_int = lambda c: F.sum(c.cast("int")).cast("bigint")
    return p.groupBy("collection").agg(
        F.count(F.lit(1)).alias("offered"),
        as_int(blank).alias("blank"),
        as_int(known).alias("already_stored"),
        as_int(added).alias("added"),
        as_int(added & zero).alias("zero_vector"),
    )


def resolve_collections(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join of requested names to stored collections; a read never creates one."""
    have = chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"))
    return (requests.distinct().join(have, "collection", "left")
            .select("collection", F.col("n_chunks").isNotNull().alias("exists"),
                    F.coalesce(F.col("n_chunks"), F.lit(0)).cast("bigint").alias("n_chunks")))


def text_with_fallback(stored: DataFrame, memory: DataFrame) -> DataFrame:
    """``memory_text`` when present and non-empty, else ``store_text``."""
    j = stored.join(memory, "collection", "full_outer")
    use_mem = F.col("memory_text").isNotNull() & (F.col("memory_text") != "")
    return j.select("collection",
                    F.when(use_mem, F.lit("memory")).otherwise(F.lit("store")).alias("origin"),
                    F.when(use_mem, F.col("memory_text")).otherwise(F.col("store_text")).alias("text"))
