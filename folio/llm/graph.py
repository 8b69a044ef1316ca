"""Connected components of an edge table by alternating large-star and small-star steps.

Only DataFrame operations: each step is a partial minimum per node and a join on a side with
one row per node, so a node with very many edges is split by the skew join. A round replaces
edges and never adds any; rounds stop when a round leaves the edges unchanged.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folio.llm.common import discard, written


EDGES_A_FILE = 200_000


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (b, s) with b > s."""
    both = e.union(e.select(F.col("s"), F.col("b")))
    least = both.groupBy(F.col("b").alias("s")).agg(F.min("s").alias("m"))
    large = e.join(least, "s").select("b", F.least("s", "m").alias("s")).distinct()
    low = large.groupBy("b").agg(F.min("s").alias("m"))
    moved = large.join(low, "b")
    return (moved.where(F.col("s") != F.col("m")).select(F.col("s").alias("b"), F.col("m").alias("s"))
            .union(low.select("b", F.col("m").alias("s"))).distinct())


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksum, from the one job that writes them."""
    seen = Observation()
    out = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("b", "s").cast("decimal(38,0)")).alias("sum")), "edges")
    try:
        return out, (seen.get["n"], seen.get["sum"])
    except Py4JJavaError:       # the plan turned out empty, so nothing was observed
        return out, (0, None)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node each node of an edge reaches. Nodes without an edge to
    another node are not in the result; null ends and loops are left out."""
    e, mark = _written(edges.where(F.col(a) != F.col(b))
                       .select(F.greatest(a, b).alias("b"), F.least(a, b).alias("s")).distinct())
    while mark[0]:
        # edges never grow in number, so a round's table needs no more files than its rows fill
        new, new_mark = _written(_stars(e).coalesce(max(1, mark[0] // EDGES_A_FILE)))
        discard(e)
        e = new
        if new_mark == mark:
            break
        mark = new_mark
    return e.select(F.col("b").alias("node"), F.col("s").alias("root")).union(
        e.select(F.col("s").alias("node"), F.col("s").alias("root")).distinct())
