"""SpotSigs document fingerprints.

A signature is a common word (the anchor) with the chain of content words that follow it. So that
texts in other languages and tables have anchors too, one in eight other words counts as common,
picked by its hash. A text's
fingerprint is the set of its signatures' hashes, sorted, 8 hex digits each, so its length grows with
the text's. Likeness is the Jaccard coefficient of two sets. :func:`similar` finds all pairs of a
likeness or more: sets are partitioned by length so that only neighbouring partitions can hold
such pairs, postings of each set's rarest signatures bring candidates together, size and place
bounds prune them, and the sets decide.

DataFrame operations only. A text is split once, runs of anchors are written without blanks, and one
pattern takes each run with the chain behind it, in time linear in the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import text_of, written

# Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have in is it not of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui se son sur un une "
    "als auch auf das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von war zu "
    "al con del el ella las lo los no para por su una y"
).split()
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ONE_IN = 8      # so many words have one more anchor among them, picked by hash
# anchors are written between \x06 and \x05, content words between blanks; a run is taken where it begins
CHAINED = "\x06(?<![^ ]\x06)([^ ]++) ([^ ]++) (?=[^ ]*+ ([^ ]++))"
LEAST = 0.8     # likeness of a pair that :func:`similar` returns
FIRST_KEY = -(1 << 63)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted set of signature hashes of a text column. A text without a full chain has
    its words as signatures; one without words has none."""
    words, sigs, kept = f"{out}_words", f"{out}_sigs", df.columns
    df = df.withColumn(words, F.array_remove(F.split(F.lower(text), BETWEEN), ""))
    anchor = lambda w: w.isin(ANCHORS) | (F.pmod(F.hash(w), F.lit(ONE_IN)) == 0)
    marked = F.array_join(F.transform(words, lambda w: F.when(anchor(w), F.concat(F.lit("\x06"), w, F.lit("\x05"))).otherwise(F.concat(F.lit(" "), w, F.lit(" ")))), "")
    runs = F.regexp_extract_all(F.regexp_replace(marked, CHAINED, "\x02$1\x04$2 $3\x03"), F.lit("\x02([^\x03]*)\x03"), 1)

    def of_run(run):
        chain = F.substring_index(run, "\x04", -1)
        own = F.array_distinct(F.array_remove(F.split(F.translate(F.substring_index(run, "\x04", 1), "\x06", ""), "\x05"), ""))
        return F.transform(own, lambda w: F.hash(F.concat_ws(" ", w, chain)))
    df = df.withColumn(sigs, F.flatten(F.transform(runs, of_run)))
    full = F.when(F.size(sigs) > 0, F.col(sigs)).otherwise(F.transform(words, lambda w: F.hash(w)))
    return df.select(*kept, F.sort_array(F.array_distinct(full)).alias(out))


def spelt(sigs: str) -> Column:
    """A signature set as text."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two sets, 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.transform(F.array(both), lambda i: i / (F.size(a) + F.size(b) - i))[0])


def similar(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: (a, b, likeness) of all different signature sets of ``least`` likeness or more, a < b, and
    (doc_id, cls): each row's set, named by its smallest doc_id.

    Equal sets are one class, so copies are not paired with each other. A set of n signatures must share one of its
    n - ceil(least n) + 1 rarest with any set that is so like it; sets lie in partitions of the logarithm of n, and such a
    set lies in the same or the next one. Null texts are empty, empty sets are one class without pairs, a null doc_id
    counts as the smallest, an empty table gives empty tables."""
    if not 0 < least <= 1:
        raise ValueError("a likeness lies over 0 and not over 1")
    own = with_signatures(docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FIRST_KEY)).alias("id"), text_of(text).alias("text")), "text", "sigs")
    own = written(own.select("id", "sigs", F.sha2(F.array_join(F.col("sigs").cast("array<string>"), ","), 256).alias("sha")), "sigs")
    sets = written(own.groupBy("sha").agg(F.min("id").alias("cls"), F.first("sigs").alias("sigs")), "sets")
    named = sets.where(F.size("sigs") > 0).select("cls", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = written(named.groupBy("sig").agg(F.count("*").alias("df")), "rarity")
    # a set's signatures by rarity: their places, of which only the prefix is kept
    order = F.transform(F.array_sort(F.collect_list(F.struct("df", "sig"))), lambda x: x["sig"])
    ordered = named.join(rare, "sig").groupBy("cls", "n").agg(order.alias("by"))
    keep = (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int")
    part = F.floor(F.ln("n") / -math.log(least) + 1e-9) if least < 1 else F.col("n")
    posting = written(ordered.select("cls", "n", part.alias("part"), F.posexplode(F.slice("by", F.lit(1), keep)).alias("at", "sig")), "postings")
    a = posting.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own_part"))
    b = posting.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "sig", "part")
    # the smaller set looks into its own and the next partition; of equal sizes the smaller class does
    met = a.join(b, ["sig", "part"]).where((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * least / (1 + least) - 1e-9)
    near = met.where((F.col("n_a") >= least * F.col("n_b") - 1e-9) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need))
    cand = near.select("a", "b").distinct()
    full = cand.join(sets.select(F.col("cls").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("sigs").alias("y")), "b")
    pairs = full.select("a", "b", likeness("x", "y").alias("likeness")).where(F.col("likeness") >= least - 1e-12)
    null_of = lambda c: F.when(F.col(c) != FIRST_KEY, F.col(c))
    return (pairs.select(null_of("a").alias("p"), null_of("b").alias("q"), "likeness").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "likeness"),
            own.join(sets.select("sha", "cls"), "sha").select(null_of("id").alias("doc_id"), null_of("cls").alias("cls")))


def preceding(keys: DataFrame) -> DataFrame:
    """(key, to, to_n): for each key of (key, n) the key before it in ascending order (the last one
    for the first) and that key's n. Keys are dealt out by range; only each range's first and last
    row go through the driver."""
    dealt = written(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    ends = sorted(dealt.groupBy("part").agg(F.min("key").alias("low"), F.max(F.struct("key", "n")).alias("high")).collect(), key=lambda r: r["part"])
    before = [(r["part"], *ends[k - 1]["high"]) for k, r in enumerate(ends)]
    edge = F.broadcast(dealt.sparkSession.createDataFrame(before, "part int, edge_key bigint, edge_n bigint"))
    w = Window.partitionBy("part").orderBy("key")
    return dealt.join(edge, "part").select("key", F.coalesce(F.lag("key").over(w), "edge_key").alias("to"), F.coalesce(F.lag("n").over(w), "edge_n").alias("to_n"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every
    row of ``docs``.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document's, ids ascending and after the last the first. Null counts
    as the empty text. A null doc_id comes before all others. Of rows with one doc_id each is
    fingerprinted, and the next document is the one of the next id whose text has the smallest hash. An empty
    table gives an empty table, other columns are not read."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FIRST_KEY)).alias("key"), text_of(text).alias("text"))
    keys = written(own.groupBy("key").agg(F.max(F.char_length("text")).cast("bigint").alias("n")), "keys")
    sent = own.join(preceding(keys), "key").select("to", F.expr("substring(text, 1, cast(to_n div 4 as int))").alias("head"), "text")
    sent = with_signatures(sent, "text", "next_sigs").groupBy("to").agg(F.min_by(F.struct("head", "next_sigs"), F.xxhash64("text")).alias("next"))
    pair = own.join(sent, F.col("key") == F.col("to")).select("key", "text", F.char_length("text").alias("n"), F.col("next.head").alias("head"), F.col("next.next_sigs").alias("next_sigs"))
    edited = F.concat(F.expr("substring(text, 1, n - n div 4)"), F.expr("substring(head, 1, cast(n div 4 as int))"))
    pair = pair.withColumn("edited", edited)
    pair = with_signatures(with_signatures(pair, "text", "sigs"), "edited", "edited_sigs")
    return pair.select(
        F.when(F.col("key") != FIRST_KEY, F.col("key")).alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spelt("sigs").alias("fingerprint"), spelt("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"))
