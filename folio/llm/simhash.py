"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints have 64 bits. Every bit position gets a non-zero vector of ``radius + 1`` bits
(positions in turn get 1, 2, ..., 2^(radius+1)-1, 1, ...); table ``v`` keeps the positions whose
vector has an odd overlap with ``v``. At most ``radius`` differing positions give that many
linear conditions on ``radius + 1`` bits, so some ``v`` drops them all: every pair within the
radius meets in a table, and nothing has to be probed twice.

Within a bucket the links are followed from one fingerprint to those still unvisited, which
gives a spanning forest instead of all pairs: copies cost one row each, and no link between
different components is lost. A bucket over ``bucket_rows`` is dealt out once more by the same
masks on the positions its table dropped; distinct fingerprints that share both masks number
2^(open positions) at most, so the second level is bounded without any cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import text_of, written
from folio.llm.graph import components

BITS = 64
SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """The 2^(radius+1)-1 masks over the given bit positions (all 64 by default), unsigned."""
    positions = list(range(BITS)) if positions is None else positions
    top = 1 << (radius + 1)
    vector = {p: k % (top - 1) + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, top)]


def second_masks(radius: int) -> list[list[int]]:
    """For each first mask, its refinements: the mask and a covering of the positions it drops."""
    return [[m | n for n in covering_masks(radius, [p for p in range(BITS) if not m >> p & 1])]
            for m in covering_masks(radius)]


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of a text: majority of each bit over the XXH64 of its word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts, stops = [0, *ends[:n - 1].tolist()], (ends[shingle - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts, stops)]
    ones = np.zeros(BITS, np.int64)
    h = np.array(hashes, np.uint64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(h[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp bigint) of every whole text; null and wordless texts have fingerprint 0."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, "doc_id bigint, fp bigint")


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among the distinct fingerprints ``x``."""
    left, a, b = np.arange(len(x)), [], []
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            p = todo.pop()
            near = np.bitwise_count(x[left] ^ x[p]) <= radius
            if near.any():
                new = left[near]
                a.append(np.full(new.size, x[p]))
                b.append(x[new])
                todo.extend(new)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linker(radius: int, bucket_rows: int | None):
    """Rows (t, key, fp) sorted by bucket in; rows (t, a, b) out: links with t null, or the
    fingerprints (a, no b) of a bucket over ``bucket_rows`` with its table t."""
    def table(t, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(t, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64) if b is not None else [None] * len(a), pa.int64())],
            ["t", "a", "b"])

    def close(t, x):
        if bucket_rows and len(x) > bucket_rows:
            return table(np.full(len(x), t, np.int32), x, None)
        a, b = forest(x, radius)
        return table([None] * len(a), a, b) if len(a) else None

    def run(batches):
        held, at, over = [], None, False    # the bucket still open, over: its rows already left
        for batch in batches:
            t, key = (np.asarray(batch.column(i)) for i in (0, 1))
            fp = np.asarray(batch.column(2)).view(np.uint64)
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, stops = np.r_[0, cut], np.r_[cut, len(t)]
            a, b = [], []
            pairs = starts[1:-1][stops[1:-1] - starts[1:-1] == 2] if len(starts) > 2 else np.empty(0, int)
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius]
            a.append(fp[near])
            b.append(fp[near + 1])
            long = np.flatnonzero(stops - starts > 2) if len(starts) > 2 else np.arange(len(starts))
            for k in sorted({0, len(starts) - 1, *long.tolist()}):
                x, here = fp[starts[k]:stops[k]], (t[starts[k]], key[starts[k]])
                if here != at and at is not None:
                    if held and (out := table(np.full(sum(map(len, held)), at[0], np.int32), np.concatenate(held), None) if over else close(at[0], np.concatenate(held))):
                        yield out
                    held, over = [], False
                at = here
                held.append(x)
                if bucket_rows and (over or sum(map(len, held)) > bucket_rows):
                    over = True
                    yield table(np.full(sum(map(len, held)), at[0], np.int32), np.concatenate(held), None)
                    held = []
                elif k < len(starts) - 1:
                    if (out := close(at[0], np.concatenate(held))):
                        yield out
                    held, at = [], None
            if a[0].size:
                yield table([None] * len(a[0]), a[0], b[0])
        if held and (out := close(at[0], np.concatenate(held))):
            yield out
    return run


def links(fps: DataFrame, radius: int = 4, bucket_rows: int = 20000) -> DataFrame:
    """(a, b): links that connect what pairs of fingerprints within ``radius`` bits connect.
    ``fps`` holds distinct fingerprints in column fp."""
    masks = covering_masks(radius)
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    first = written(dealt.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
                    .mapInArrow(_linker(radius, bucket_rows), "t int, a bigint, b bigint"), "links")
    found = first.where("b IS NOT NULL").select("a", "b")
    large = first.where("b IS NULL")
    if large.isEmpty():
        return found.distinct()
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in second_masks(radius)])
    again = large.select(F.col("a").alias("fp"), F.col("t").alias("t1"), F.posexplode(finer[F.col("t")]).alias("t2", "mask"))
    again = again.select((F.col("t1") * len(masks) + F.col("t2")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    more = again.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(
        _linker(radius, None), "t int, a bigint, b bigint").select("a", "b")
    return found.union(more).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4, bucket_rows: int = 20000) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits.
    Null and wordless texts have fingerprint 0 and link like any other; repeated rows come back
    as often as they are given; a null doc_id stays null and takes the component of its
    fingerprint (null if no other id is in it); an empty table gives an empty table; other columns
    are not read."""
    own = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    least = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint_classes")
    joined = components(links(least.select("fp"), radius, bucket_rows), "a", "b")
    rooted = least.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
