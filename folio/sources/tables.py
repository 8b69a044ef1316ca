"""Driver tables (``<sf_dir>/<name>.parquet``) and column-pruned readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a scan that came out in fewer partitions than there are cores.

    Only for local sessions that ask for it (``spark.folio.spreadSmallTables``): a small single
    row-group file would otherwise run every downstream stage as one task. On a cluster tables
    stay in the splits of their files.
    """
    if df.sparkSession.conf.get("spark.folio.spreadSmallTables", "false") != "true":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str, spread: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return ensure_parallelism(df) if spread else df
