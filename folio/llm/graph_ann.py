"""Nearest neighbours by inner product through robust-pruned directed graphs.

Equal vectors are one point of the index, which knows the smallest ids of its copies. Points are
dealt by hash into shards of a bounded size, each with a graph of its own (Vamana): points are
inserted in batches, a greedy beam search over the graph so far proposes neighbours, and relaxed
pruning keeps a neighbour only if none nearer to the point is ``alpha`` times nearer to it. Each
block of different query vectors is beam-searched in every shard.

Inner product order within a shard is the order of distance after one more component
sqrt(max |x|^2 - |x|^2) is added to its points and a zero to the query, so the graphs are built in
Euclidean space whatever the vectors' lengths. Distances along the way are single precision; what is
returned is scored again in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import written

SHARD = 8192        # points of a shard, on average
BLOCK = 2048        # queries of a block
DEGREE = 32         # edges a point keeps
BUILD_BEAM = 64
ALPHA = 1.2
BATCH = 512         # points inserted, or queries searched, at once
MOST_TASKS = 20_000
INDEX = "dim int, shard int, ids binary, vectors binary, edges binary, starts binary"


# ---------------------------------------------------------------- one shard

def with_norm(points: np.ndarray) -> np.ndarray:
    """Points with the component that makes inner product order one of distance (single precision)."""
    size = np.einsum("ij,ij->i", points, points)
    return np.c_[points, np.sqrt(np.maximum(size.max(initial=0.0) - size, 0.0))].astype(np.float32)


def beam_search(x: np.ndarray, size: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points found for each query: (places, distances), nearest first, place -1
    where there are fewer. All queries take a step at once: the nearest point of each beam that was not
    expanded yet is expanded. ``size``: squared lengths; distances leave out the query's own."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True                                       # the mark of no edge
    beam = np.full((q, width + DEGREE), n)
    far = np.full((q, width + DEGREE), np.inf, np.float32)
    done = np.ones((q, width + DEGREE), bool)
    s = starts[:width]
    beam[:, :len(s)] = s
    far[:, :len(s)] = size[s] - 2 * (queries @ x[s].T)
    done[:, :len(s)] = False
    seen[:, s] = True
    live = np.arange(q)
    while live.size:
        open_ = np.where(done[live, :width], np.inf, far[live, :width])
        at = open_.argmin(axis=1)
        more = np.isfinite(open_[np.arange(len(live)), at])
        live, at = live[more], at[more]
        if not live.size:
            break
        done[live, at] = True
        near = edges[beam[live, at]]
        new = ~seen[live[:, None], near]
        near = np.where(new, near, n)
        seen[live[:, None], near] = True
        # whatever is near enough enters the beam's tail, and the beam is put in order again
        dist = np.where(new, size[np.minimum(near, n - 1)] - 2 * np.einsum("qrd,qd->qr", x[np.minimum(near, n - 1)], queries[live]), np.inf)
        beam[live, width:], far[live, width:], done[live, width:] = near, dist, ~new
        hit = live[(dist < far[live, width - 1:width]).any(axis=1)]
        order = np.argsort(far[hit], axis=1, kind="stable")
        beam[hit], far[hit], done[hit] = (np.take_along_axis(v[hit], order, axis=1) for v in (beam, far, done))
    order = np.argsort(far[:, :width], axis=1, kind="stable")
    beam, far = np.take_along_axis(beam[:, :width], order, axis=1), np.take_along_axis(far[:, :width], order, axis=1)
    return np.where(np.isfinite(far), beam, -1), far


def robust_prune(x: np.ndarray, size: np.ndarray, points: np.ndarray, cand: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Up to DEGREE edges of each point out of its row of candidates (-1: none): the nearest is kept, and
    those that are ``alpha`` times nearer to it than to the point are dropped, again and again."""
    n = len(x)
    cand = np.where((cand == points[:, None]) | (cand < 0), n, cand)
    ordered = np.sort(cand, axis=1)
    again = np.c_[np.zeros(len(cand), bool), ordered[:, 1:] == ordered[:, :-1]]
    cand = np.where(again, n, ordered)
    c = np.minimum(cand, n - 1)
    own, vec = x[points], x[c]
    dist = np.where(cand < n, np.maximum(size[points][:, None] + size[c] - 2 * np.einsum("pcd,pd->pc", vec, own), 0), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")[:, :BUILD_BEAM + DEGREE]
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    c = np.minimum(cand, n - 1)
    vec = x[c]
    apart = np.maximum(size[c][:, :, None] + size[c][:, None, :] - 2 * (vec @ vec.transpose(0, 2, 1)), 0)
    out = np.full((len(points), DEGREE), n)
    left, rows = np.isfinite(dist), np.arange(len(points))
    for k in range(DEGREE):
        at = np.where(left, dist, np.inf).argmin(axis=1)
        some = left[rows, at]
        if not some.any():
            break
        out[:, k] = np.where(some, cand[rows, at], n)
        left &= alpha * alpha * apart[rows, at] > dist
        left[rows, at] = False
        left &= some[:, None]
    return out


def build(points: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of a graph over the points; an edge to ``len(points)`` is none."""
    x = with_norm(points)
    size, n, rng = np.einsum("ij,ij->i", x, x), len(x), np.random.default_rng(seed)
    edges = np.full((n + 1, DEGREE), n)
    centre = int(np.argmin(size - 2 * (x @ x.mean(axis=0)))) if n else 0
    order = np.r_[centre, rng.permutation(np.delete(np.arange(n), centre))] if n else np.arange(0)
    starts = order[:min(n, 8)]
    first = order[:BATCH]                                   # among the first points all are candidates
    edges[first] = robust_prune(x, size, first, np.broadcast_to(first, (len(first), len(first))).copy()) if len(first) else edges[first]
    for again in range(2):                                  # the second time over the whole graph
        for k in range(0 if again else BATCH, n, BATCH):
            some = order[k:k + BATCH]
            found, _ = beam_search(x, size, edges, starts, x[some], BUILD_BEAM)
            edges[some] = robust_prune(x, size, some, np.c_[found, np.where(edges[some] < n, edges[some], -1)])
            # and back: the points that got an edge take it among their own, pruned anew if there are too many
            a, b = np.repeat(some, DEGREE), edges[some].ravel()
            a, b = a[b < n], b[b < n]
            known = (edges[b] == a[:, None]).any(axis=1)
            by = np.lexsort((a, b[:]))
            by = by[~known[by]]
            a, b = a[by], b[by]
            to, at, count = np.unique(b, return_index=True, return_counts=True)
            rank = np.arange(len(b)) - np.repeat(at, count)
            most = int(count.max(initial=0))
            extra = np.full((len(to), most), -1)
            extra[np.repeat(np.arange(len(to)), count), rank] = a
            for j in range(0, len(to), BATCH):
                t = to[j:j + BATCH]
                both = np.c_[np.where(edges[t] < n, edges[t], -1), extra[j:j + BATCH]]
                full = (both >= 0).sum(axis=1) > DEGREE
                if (~full).any():
                    edges[t[~full]] = np.where((kept := -np.sort(-both[~full], axis=1)[:, :DEGREE]) < 0, n, kept)
                if full.any():
                    edges[t[full]] = robust_prune(x, size, t[full], both[full])
    return edges[:n], starts


def search(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` points of largest inner product that a beam of ``width`` found."""
    x = with_norm(points)
    size, edges = np.einsum("ij,ij->i", x, x), np.r_[edges, np.full((1, DEGREE), len(x))]
    places, scores = [], []
    for j in range(0, len(queries), BATCH):
        q = queries[j:j + BATCH]
        found, _ = beam_search(x, size, edges, starts, np.c_[q, np.zeros(len(q))].astype(np.float32), max(width, k))
        score = np.where(found < 0, -np.inf, np.einsum("qkd,qd->qk", points[found], q))
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        places.append(np.take_along_axis(found, order, axis=1))
        scores.append(np.take_along_axis(score, order, axis=1))
    return np.concatenate(places), np.concatenate(scores)


# ---------------------------------------------------------------- jobs

def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, v) of the vectors that take part: not null, not zero, all components finite."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(
        finite & F.exists("v", lambda x: x != 0)).select("vec_id", F.size("v").alias("dim"), "v")


def distinct_points(rows: DataFrame, copies: int) -> DataFrame:
    """(point, dim, v, ids): each different vector, under its smallest id, with its ``copies`` smallest ids. A
    task sends no more than those of a vector, however many copies there are."""
    w = Window.partitionBy("dim", "v").orderBy("vec_id")
    kept = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= copies)
    return kept.groupBy("dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), "dim", "v", "ids")


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().reshape(-1, dim)


def index(points: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """A row for each shard of (point, dim, v): its ids, vectors, edges and entry points."""
    sizes = written(points.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "ann_sizes")
    tasks = int(sizes.agg(F.sum("shards")).first()[0] or 1)      # a task for each shard, as building one is long
    dealt = points.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("point"), F.col("shards")).cast("int").alias("shard"), "point", "v").repartition(
        min(4 * tasks, MOST_TASKS), "dim", "shard")

    def made(key, table):
        dim = key[0].as_py()
        rows = table.sort_by("point")
        vectors = np.ascontiguousarray(_matrix(rows.column("v"), dim))
        edges, starts = build(vectors)
        return pa.table({"dim": [dim], "shard": [key[1].as_py()], "ids": [rows.column("point").to_numpy().astype("<i8").tobytes()], "vectors": [vectors.astype("<f8").tobytes()],
                         "edges": [edges.astype("<i4").tobytes()], "starts": [starts.astype("<i4").tobytes()]}).cast(
            pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary()), ("starts", pa.binary())]))

    return dealt.groupBy("dim", "shard").applyInArrow(made, INDEX)


def shard_hits(shards: DataFrame, queries: DataFrame, k: int, width: int, block: int = BLOCK) -> DataFrame:
    """(query, point, score): the ``k`` points found in each shard for each query (query, dim, v). A block of
    queries and a shard meet as one row each."""
    def packed(key, table):
        return pa.table({"dim": key[:1], "qb": key[1:2], "queries": [table.column("query").to_numpy().astype("<i8").tobytes()],
                         "asked": [np.ascontiguousarray(_matrix(table.column("v"), key[0].as_py())).astype("<f8").tobytes()]}).cast(
            pa.schema([("dim", pa.int32()), ("qb", pa.int32()), ("queries", pa.binary()), ("asked", pa.binary())]))

    counts = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of = shards.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    dealt = queries.join(counts, "dim").select("dim", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("qb"), "query", "v")
    blocks = written(dealt.groupBy("dim", "qb").applyInArrow(packed, "dim int, qb int, queries binary, asked binary"), "ann_blocks")
    each = blocks.join(of, "dim").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("shards")
    own = shards.join(counts, "dim").withColumn("qb", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    pairs = of.join(counts, "dim").agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    on, tasks = ["dim", "shard", "qb"], min(2 * pairs, MOST_TASKS)
    met = own.repartition(tasks, *on).join(each.repartition(tasks, *on), on)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                of_ = lambda name, kind, dim=0: np.frombuffer(row[name], kind).reshape(*([-1, dim] if dim else [-1]))
                places, scores = search(of_("vectors", "<f8", row["dim"]), of_("edges", "<i4", DEGREE).astype(np.int64), of_("starts", "<i4").astype(np.int64),
                                        of_("asked", "<f8", row["dim"]), k, width)
                q, at = np.nonzero(places >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(of_("queries", "<i8")[q]), pa.array(of_("ids", "<i8")[places[q, at]]), pa.array(scores[q, at])], ["query", "point", "score"])

    spread = met.select("dim", "ids", "vectors", "edges", "starts", "queries", "asked")
    return spread.mapInArrow(run, "query bigint, point bigint, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, width: int = 96, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` other rows of
    largest inner product that the graphs find, nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id; vectors
    of another length are compared among themselves. Rows of one id with several vectors are rows each. An
    empty table gives an empty table; other columns are not read. Equal vectors are equally near, so of each only the k + 1
    smallest ids can be among anyone's k nearest: that loses nothing. A task holds a shard and a block of queries."""
    rows = written(usable(vectors, vec_id, embedding), "ann_rows")
    points = written(distinct_points(rows, k + 1), "ann_points")
    shards = written(index(points, shard_rows), "ann_index")
    asking = rows.where(F.col("vec_id") % every == 0)
    asked = written(distinct_points(asking, 1).select(F.col("point").alias("query"), "dim", "v"), "ann_queries")
    hits = shard_hits(shards, asked, k + 1, width)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    best = written(hits.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1).select("query", "point", "score"), "ann_best")
    # from different vectors back to rows
    asks = asking.join(asked, ["dim", "v"]).select("query", F.col("vec_id").alias("query_id"))
    near = best.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)     # one may be the query itself
    lists = written(near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near")), "ann_lists")
    found = asks.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return found.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
