"""Benchmark decontamination as a prefix-filtered containment join.

Every benchmark item is cut into windows of 10 words (an item of fewer words is one window). A
window's tokens are its 5-word shingles. They are ordered by rarity over all documents, and as a
window is found only where all its shingles are, the prefix that must be joined is its rarest
shingle. A joined pair is a place in a document: it must leave room for the whole window (length
and positional bounds) and then its words are compared with the window's.

DataFrame operations only. The documents' shingles are hashed row by row and meet the benchmark's
set of shingles in one pass, as a broadcast of checked size or else as a shuffle join; only
places that hold a benchmark shingle are written. Hits are sums over merged intervals, so no
word is counted twice and no interval is spelt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, text_of, written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"                   # of a text without A-Z
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000      # rows of hashes or windows that may be broadcast


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def n_words_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, BETWEEN_ANY), "")).cast("bigint")


def _shingle(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(k)])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, width: int, item_id: str, text: str) -> DataFrame:
    """(item, window, n): the windows of every item with words; a null item_id reads as ''."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(text_of(text)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    cut = w.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("at"))
    own = F.slice("words", F.col("at") + 1, F.lit(width))
    return cut.select("item", F.array_join(own, " ").alias("window"), F.size(own).alias("n")).distinct()


def window_shingles(wins: DataFrame, shingle: int) -> DataFrame:
    """(window, n, k, offset, hash) for the shingles of k = min(shingle, n) words of every window."""
    parts = []
    w = wins.select("window", "n").distinct().withColumn("words", F.split("window", " "))
    for k in range(1, shingle + 1):
        own = w.where(F.col("n") >= k if k == shingle else F.col("n") == k)
        at = own.select("window", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("offset"))
        parts.append(at.select("window", "n", F.lit(k).alias("k"), "offset", _shingle("words", F.col("offset"), k).alias("hash")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def places(docs: DataFrame, hashes: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """(doc, mark, n_words, k, at, hash, near, near_at): the places of benchmark shingles in the
    documents with the words around that a window there can cover."""
    w = docs.select("doc", "mark", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    each = w.select("doc", "mark", "words", F.posexplode("words").alias("at", "word"))
    room = F.size("words") - F.col("at")
    if len(sizes) == 1:
        each = each.where(room >= sizes[0]).select("doc", "mark", "words", "at", F.lit(sizes[0]).alias("k"), _shingle("words", F.col("at"), sizes[0]).alias("hash"))
    else:
        found = F.array(*[F.when(room >= k, F.struct(F.lit(k).alias("k"), _shingle("words", F.col("at"), k).alias("hash"))) for k in sizes])
        each = each.select("doc", "mark", "words", "at", F.explode(found).alias("s")).where("s IS NOT NULL").select("doc", "mark", "words", "at", "s.k", "s.hash")
    near_at = F.greatest(F.col("at") - width, F.lit(0))
    columns = ["doc", "mark", F.size("words").alias("n_words"), "k", "at", "hash", F.slice("words", near_at + 1, F.lit(2 * width)).alias("near"), near_at.alias("near_at")]
    if hashes.count() > BROADCAST_ROWS:     # a shuffle must not carry all words with each place
        return each.select(*columns).join(hashes, ["k", "hash"]).select("doc", "mark", "n_words", "k", "at", "hash", "near", "near_at")
    return each.join(F.broadcast(hashes), ["k", "hash"]).select(*columns)


def occurrences(docs: DataFrame, wins: DataFrame, width: int, shingle: int) -> DataFrame:
    """(doc, mark, start, n, window): every occurrence of a window in (doc, mark, text)."""
    tokens = written(window_shingles(wins, shingle), "window_shingles")
    sizes = sorted(r["k"] for r in tokens.select("k").distinct().collect()) or [shingle]
    found = written(places(docs, tokens.select("k", "hash").distinct(), sizes, width), "shingle_places")
    rarity = found.groupBy("k", "hash").agg(F.count("*").alias("seen"))
    # the rarest shingle of each window; a window with a shingle never seen is nowhere
    ranked = tokens.join(rarity, ["k", "hash"], "left").groupBy("window", "n", "k").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("hash"), F.col("offset"))).alias("rarest"))
    prefix = written(ranked.where("rarest.seen > 0").select("window", "n", "k", "rarest.hash", "rarest.offset"), "prefixes")
    start = F.col("at") - F.col("offset")
    near = F.array_join(F.slice("near", start - F.col("near_at") + 1, F.col("n")), " ")
    return found.join(_small(prefix), ["k", "hash"]).where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).where(
        near == F.col("window")).select("doc", "mark", start.alias("start"), "n", "window")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    Null and wordless texts have no words and no hit; items without words have no window; items
    of one text count each; repeated rows of ``docs`` come back as often as given, a null doc_id stays
    null (rows are told apart by id and text); an empty table of documents gives an empty table, an
    empty benchmark gives no hit; other columns are not read."""
    own = docs.select(F.col(doc_id).alias("doc"), text_of(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    wins = written(windows(items, width, item_id, item_text), "windows")
    occ = written(occurrences(own, wins, width, shingle), "occurrences")
    before = Window.partitionBy("doc", "mark").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    merged = occ.withColumn("done", F.max(end).over(before))
    hits = merged.groupBy("doc", "mark").agg(F.sum(F.greatest(end - F.greatest("start", F.coalesce("done", "start")), F.lit(0))).cast("bigint").alias("n_hit"))
    of = occ.select("doc", "mark", "window").distinct().join(wins.select("window", "item"), "window")
    found = of.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = hits.join(found, hits["doc"].eqNullSafe(found["doc"]) & (hits["mark"] == found["mark"])).select(
        hits["doc"].alias("of_doc"), hits["mark"].alias("of_mark"), "n_hit", "items")
    counted = own.select("doc", "mark", n_words_of(F.col("text")).alias("n_words"))
    joined = counted.join(result, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark")), "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"),
                         F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs, all columns as they are."""
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    own = docs.withColumnsRenamed(names)
    keyed = own.select(F.col(names[doc_id]).alias("doc"), text_of(names[text]).alias("text")).withColumn("mark", F.xxhash64("text"))
    wins = written(windows(items, width, item_id, item_text), "windows")
    hit = written(occurrences(keyed, wins, width, shingle).select("doc", "mark").distinct(), "contaminated")
    kept = own.join(hit, F.col(names[doc_id]).eqNullSafe(F.col("doc")) & (F.xxhash64(text_of(names[text])) == F.col("mark")), "left_anti")
    return kept.withColumnsRenamed({n: c for c, n in names.items()})
