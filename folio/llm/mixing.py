"""Temperature mixing of sources.

A source's weight is its token share to the power a, over the sum of these powers. The exponent a
is bisected between 0 (equal weights) and 1 (the shares as they are) until the weights meet a target
entropy or the most repeated source meets a limit. Each source then gets its weight of the
token budget as blocks: every whole block is a keyed permutation of all the source's documents,
the last block is cut where the quota is used up.

The cut is found without sorting a source: tokens are summed in 4096 cells of the permutation
key, the running sum over the cells gives the cell of the cut, and only this cell's documents
are put in order. Which rows to take is then a comparison of keys in each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import text_of, written

CELL_BITS = 12
SMALL_SOURCES = 10_000      # rows of a table of sources that may be broadcast


def tokens_of(text: str) -> Column:
    """Tokens for the shares: runs of other than white space."""
    return F.regexp_count(text_of(text), F.lit(r"\S+")).cast("bigint")


def shares(sized: DataFrame) -> DataFrame:
    """(source, tokens, p) of the sources that have tokens."""
    t = sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    t = written(t, "source_tokens")
    return t.withColumn("p", F.col("tokens") / F.lit(t.agg(F.sum("tokens")).first()[0]))


def weights_at(s: DataFrame, a: float) -> dict:
    """Sums over the sources at exponent a: the weights' divisor, entropy and repetitions."""
    w = F.pow("p", F.lit(a))
    r = s.agg(F.sum(w).alias("z"), F.sum(w * F.ln("p")).alias("l"), F.max(w / F.col("p")).alias("most"), F.min(w / F.col("p")).alias("least")).first()
    if not r["z"]:
        return {"z": 1.0, "entropy": 0.0, "spread": 1.0, "least": 1.0}
    return {"z": r["z"], "entropy": math.log(r["z"]) - a * r["l"] / r["z"], "spread": r["most"] / r["least"], "least": r["least"]}


def exponent(s: DataFrame, entropy: float | None = None, repeats: float | None = None, steps: int = 20) -> float:
    """The largest a in [0, 1] whose weights have at least ``entropy`` nats, or the smallest at
    which no source is repeated over ``repeats`` times as often as the least repeated one."""
    low, high = 0.0, 1.0
    if repeats is not None and weights_at(s, 0.0)["spread"] <= repeats or entropy is not None and weights_at(s, 1.0)["entropy"] >= entropy:
        return 0.0 if repeats is not None else 1.0
    for _ in range(steps):
        a = (low + high) / 2
        at = weights_at(s, a)
        flat = at["entropy"] >= entropy if entropy is not None else at["spread"] > repeats
        low, high = (a, high) if flat else (low, a)
    return low if entropy is not None else high


def plan(sized: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: float | None = None,
         seed: int = 42) -> DataFrame:
    """(mix_source, whole, cut): the blocks each source gives in full, and the key up to which its
    last block goes. ``sized``: (source, doc, hash, tokens). Without a ``budget`` the least repeated
    source gives exactly one block, so every document is taken at least once."""
    s = shares(sized)
    a = exponent(s, entropy, None if entropy is not None else repeats)
    at = weights_at(s, a)
    weight = F.pow("p", F.lit(a)) / at["z"]
    blocks = weight / F.col("p") * (at["z"] / at["least"] if budget is None else budget / max(float(s.agg(F.sum("tokens")).first()[0] or 1), 1.0))
    blocks = F.when(F.abs(blocks - F.round(blocks)) < 1e-9, F.round(blocks)).otherwise(blocks)
    quota = s.select(F.col("source").alias("mix_source"), F.col("p"), weight.alias("weight"), F.floor(blocks).cast("int").alias("whole"),
                     (F.col("tokens") * (blocks - F.floor(blocks))).alias("rest"))
    quota = written(quota, "quota")
    mine = sized.join(_small(quota), sized["source"].eqNullSafe(quota["mix_source"]))
    keyed = mine.where("rest > 0").select("mix_source", "rest", "tokens", "salt", key_of(F.col("whole"), F.col("doc"), F.col("hash"), seed).alias("key"))
    # the key at which each source's rest ends; copies of a document have one key, and the last ones of them are told apart by their salt
    ends = written(_ends(keyed, "key"), "cuts")
    at_end = keyed.drop("rest").join(_small(ends.select(F.col("source").alias("of"), F.col("at").alias("of_key"), "left")),
                                     F.col("mix_source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
    several = at_end.groupBy(F.col("mix_source").alias("n_source")).agg(F.count("*").alias("n")).where("n > 1").select("n_source")
    repeated = at_end.join(_small(written(several, "several")), F.col("mix_source").eqNullSafe(F.col("n_source")))
    copies = written(_ends(repeated.select("mix_source", F.col("left").alias("rest"), "tokens", "salt"), "salt"), "copies")
    cut = ends.select("source", F.col("at").alias("cut")).join(copies.select(F.col("source").alias("c_source"), F.col("at").alias("cut_salt")), F.col("source").eqNullSafe(F.col("c_source")), "left")
    return written(quota.join(cut.drop("c_source"), F.col("mix_source").eqNullSafe(F.col("source")), "left").select("mix_source", "weight", "whole", "cut", "cut_salt"), "mix")


def _ends(rows: DataFrame, key: str) -> DataFrame:
    """(source, at, left): the ``key`` with which the tokens of (mix_source, rest, tokens, key), in its order, reach ``rest``, and what of it
    was left before that key; none where they do not reach it. A task holds the different keys of one of 4096 cells."""
    keys = rows.groupBy("mix_source", F.col(key).alias("at")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))       # copies are one
    keys = written(keys.withColumn("cell", F.shiftright("at", 64 - CELL_BITS)), "keys")
    cells = keys.groupBy("mix_source", "cell").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("mix_source").orderBy("cell")      # 4096 rows a source at most
    cells = cells.withColumn("end", F.sum("tokens").over(upto))
    cut = cells.where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("tokens") < F.col("rest"))).select(
        F.col("mix_source").alias("cut_source"), F.col("cell").alias("cut_cell"), (F.col("rest") - F.col("end") + F.col("tokens")).alias("left"))
    last = keys.join(_small(written(cut, "cells")), F.col("mix_source").eqNullSafe(F.col("cut_source")) & (F.col("cell") == F.col("cut_cell")))
    order = Window.partitionBy("mix_source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).where(F.col("before") < F.col("left"))
    return taken.groupBy(F.col("mix_source").alias("source")).agg(F.max(F.struct("at", (F.col("left") - F.col("before")).alias("left"))).alias("end")).select("source", "end.at", "end.left")


def key_of(block: Column, doc: Column, text_hash: Column, seed: int) -> Column:
    """Place of a document in the keyed permutation of a block."""
    return F.xxhash64(F.lit(seed), block, doc, text_hash)


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= SMALL_SOURCES else sources


def sized_rows(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc"), F.xxhash64(text_of(text)).alias("hash"), tokens_of(text).alias("tokens"),
                       salt_of().alias("salt"))


def salt_of() -> Column:
    """Tells copies apart: from a row's place in the scan, which is the same whenever the same files are read."""
    return F.xxhash64(F.monotonically_increasing_id())


def taken_blocks(seed: int, doc: Column, text_hash: Column, salt: Column) -> Column:
    """The blocks (0, 1, ...) in which a row joined with its source's row of the mix appears."""
    every = F.sequence(F.lit(0), F.col("whole"))
    key = lambda b: key_of(b, doc, text_hash, seed)
    return F.filter(every, lambda b: (b < F.col("whole")) | (key(b) < F.col("cut")) | ((key(b) == F.col("cut")) & (salt <= F.coalesce("cut_salt", F.lit((1 << 63) - 1)))))


def mixture(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: float | None = None,
            seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, block, position): one row for each time a document is taken;
    (block, position) is its order within its source.

    A null source is a source of its own; a null doc_id is a value like any other; repeated rows
    count and are taken each for itself, so that a block ends with the document that fills its quota, a copy or not; sources without any token (empty or null texts alone) give
    no share and are taken once, as block 0; an empty table gives an empty table; other columns are
    not read."""
    sized = written(sized_rows(docs, doc_id, source, text), "sized")
    mix = plan(sized, entropy, repeats, budget, seed)
    rows = sized.join(_small(mix), sized["source"].eqNullSafe(mix["mix_source"]), "left")
    blocks = F.when(F.col("whole").isNull(), F.array(F.lit(0))).otherwise(taken_blocks(seed, F.col("doc"), F.col("hash"), F.col("salt")))
    return rows.select("*", F.explode(blocks).alias("block")).select(
        F.col("doc").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "block",
        key_of(F.col("block"), F.col("doc"), F.col("hash"), seed).alias("position"))


def mixed(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: float | None = None,
          seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with their own columns. Texts stay where
    they are: rows meet only the table of sources."""
    sized = written(sized_rows(docs, doc_id, source, text), "sized")
    mix = plan(sized, entropy, repeats, budget, seed).select("mix_source", "whole", "cut", "cut_salt")
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    own = docs.withColumnsRenamed(names).withColumn("mix_salt", salt_of())
    rows = own.join(_small(mix), F.col(names[source]).eqNullSafe(F.col("mix_source")), "left")
    blocks = taken_blocks(seed, F.col(names[doc_id]), F.xxhash64(text_of(names[text])), F.col("mix_salt"))
    blocks = F.when(F.col("whole").isNull(), F.array(F.lit(0))).otherwise(blocks)
    taken = rows.select(*names.values(), F.explode(blocks).alias("mix_block"))
    return taken.select(*[F.col(n).alias(c) for c, n in names.items()])
