"""Approximate nearest pages: random-hyperplane buckets, exact re-rank inside buckets.

Each vector gets ``bands`` signatures of sign bits (``sign(v . r)`` for fixed random hyperplanes
``r``). A collection of up to ``bucket_rows`` rows is searched whole. For a larger one, up to
``SAMPLE`` of its queries are answered exactly, and the distances in bits between their and their
neighbours' signatures tell what any number of bits, up to buckets of ``bucket_rows`` rows on
average, and any number of probed flips would have found. The cheapest choice that finds ``recall`` of
them is taken, the whole collection if none is cheaper, so that recall holds at every size.
Within a bucket the exact kernel of :mod:`folio.operators.retrieve` ranks
(it bounds block sizes, so a crowded bucket gets more blocks, not a bigger group) and keeps
``k`` per bucket; these are merged per query, repeats dropped, and only then cut to ``k``.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.vector import confidence
from folio.operators.retrieve import KnnConfig, knn
from folio.session import materialize


MAX_BITS = 16
SAMPLE = 200        # queries of a collection that are answered exactly
RECALL = 0.95       # of the sample; some above the floor of 0.9 that the whole has to keep
PROBE_ROWS = 64     # a probed bucket costs as much as so many more rows


def hyperplanes(dim: int, bands: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bands * bits, dim))


def signatures(vec_col: str, dim: int, bands: int, bits: int, seed: int = 7):
    planes = hyperplanes(dim, bands, bits, seed)
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sig(vecs: pd.Series) -> pd.Series:
        out = [None] * len(vecs)
        ok = vecs.notna().to_numpy()
        if ok.any():
            M = np.stack(vecs[ok].to_numpy()).astype(np.float64)
            s = (M @ planes.T >= 0).astype(np.int64).reshape(len(M), bands, bits)
            codes = (s * weights).sum(axis=2)
            for j, row in zip(np.flatnonzero(ok), codes):
                out[j] = row.tolist()
        return pd.Series(out)

    return sig(F.col(vec_col))


def chosen(queries: DataFrame, corpus: DataFrame, cfg: KnnConfig, dim: int, bands: int, bucket_rows: int, recall: float) -> DataFrame:
    """``collection, __bits, __masks``: the bits each collection uses and the flips its queries probe."""
    most = F.least(F.lit(MAX_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / bucket_rows)))).cast("int")
    sizes = materialize(corpus.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).select("collection", "n", most.alias("most")), "sizes")
    large = sizes.where("most > 0")
    whole = F.array(F.lit(0).cast("bigint"))
    if large.isEmpty():
        return sizes.select("collection", F.lit(0).alias("__bits"), whole.alias("__masks"))

    def signed(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select("collection", key, signatures("vec", dim, bands, MAX_BITS).alias(name))

    w = Window.partitionBy("collection").orderBy(F.xxhash64("qid"), "qid")
    some = queries.where(F.col("vec").isNotNull()).join(large.select("collection"), "collection", "left_semi")
    some = materialize(some.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= SAMPLE).drop("__at"), "sample")
    own = corpus.join(large.select("collection"), "collection", "left_semi")
    pairs = knn(some, own, cfg).select("collection", "qid", "cid").join(signed(some, "qid", "__q"), ["collection", "qid"]).join(
        signed(own, "cid", "__c"), ["collection", "cid"]).join(large, "collection")
    apart = pairs.withColumn("__x", F.zip_with("__q", "__c", lambda a, b: a.bitwiseXOR(b))).select(
        "collection", "n", "__x", F.explode(F.sequence(F.lit(1), "most")).alias("bits"))
    # a neighbour is found if one of its bands is near enough
    least = F.expr("array_min(transform(__x, x -> bit_count(x & (shiftleft(1L, bits) - 1))))")
    tries = apart.select("collection", "n", "bits", least.alias("least")).withColumn("flips", F.explode(F.expr("sequence(0, bits)")))
    probes = F.array(*[F.array(*[F.lit(sum(comb(b, i) for i in range(r + 1))) for r in range(b + 1)]) for b in range(MAX_BITS + 1)])
    cost = bands * probes[F.col("bits")][F.col("flips")] * (F.col("n") / F.expr("shiftleft(1L, bits)") + PROBE_ROWS)
    found = tries.groupBy("collection", "n", "bits", "flips").agg(F.avg((F.col("least") <= F.col("flips")).cast("int")).alias("found"))
    best = found.withColumn("cost", cost).where((F.col("found") >= recall) & (F.col("cost") < F.col("n"))).groupBy("collection").agg(
        F.min(F.struct("cost", "bits", "flips")).alias("best"))
    masks = F.expr("filter(sequence(0L, shiftleft(1L, best.bits) - 1), m -> bit_count(m) <= best.flips)")
    return materialize(sizes.join(best, "collection", "left").select(
        "collection", F.coalesce("best.bits", F.lit(0)).alias("__bits"), F.when(F.col("best").isNull(), whole).otherwise(masks).alias("__masks")), "chosen")


def lsh_knn(queries: DataFrame, corpus: DataFrame, cfg: KnnConfig = KnnConfig(), dim: int = 64,
            bands: int = 8, bucket_rows: int = 256, recall: float = RECALL) -> DataFrame:
    """``collection, qid, rank, cid, tie1, tie2, distance, confidence`` of the ``k`` best found."""
    use = chosen(queries, corpus, cfg, dim, bands, bucket_rows, recall)

    def bucketed(df: DataFrame, probes) -> DataFrame:
        own = df.join(use, "collection").withColumn("__sig", signatures("vec", dim, bands, MAX_BITS))
        # a collection of one bucket is searched once, not once a band
        own = own.select("*", F.posexplode("__sig").alias("__band", "__all")).where((F.col("__bits") > 0) | (F.col("__band") == 0))
        own = own.withColumn("__code", F.expr("__all & (shiftleft(1L, __bits) - 1)")).withColumn("__code", F.explode(probes))
        return (own.withColumn("collection", F.concat_ws("#", "collection", F.col("__band").cast("string"), F.col("__code").cast("string")))
                .drop("__sig", "__band", "__all", "__code", "__bits", "__masks"))

    flipped = F.expr("transform(__masks, m -> __code ^ m)")
    cand = knn(bucketed(queries, flipped), bucketed(corpus, F.array("__code")), cfg)
    dedup = (cand.withColumn("collection", F.regexp_replace("collection", r"#\d+#\d+$", ""))
             .dropDuplicates(["collection", "qid", "cid"]))
    w = Window.partitionBy("collection", "qid").orderBy(F.round("distance", 9), "tie1", "tie2", "cid")
    top = dedup.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.k)
    return top.select("collection", "qid", F.col("rank").cast("int").alias("rank"), "cid", "tie1", "tie2", "distance",
                      confidence(F.col("distance")).alias("confidence"))
