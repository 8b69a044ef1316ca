"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, column-pruned, in the splits of its files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def text_of(column: str) -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of ASCII alone take the short way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def slices(batch, column: int, most: int = 2 << 20):
    """Pieces of an Arrow batch with at most so many bytes of text each, or one row."""
    import numpy as np
    import pyarrow.compute as pc
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the cluster's shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, a row a key that says in ``matches`` how many of all ``total`` rows
    of ``many`` it meets. Keys of over a thousandth of the rows, of which there are a thousand at most, are
    broadcast; the others go through a shuffle. ``many`` is read twice."""
    hot = F.broadcast(one.where(F.col("matches") * 1000 > total).drop("matches"))
    cold = one.where(F.col("matches") * 1000 <= total).drop("matches")
    return many.join(hot, keys).unionByName(many.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
