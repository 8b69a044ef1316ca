"""Exact top-k similarity join (nearest pages per question, within a collection).

No (query, chunk) pair is ever a row. Distances are computed block-wise with numpy inside
Spark tasks and only the best ``k`` per query and block leave a task:

* **broadcast path** (query set under a checked byte bound): the query matrix of each
  collection is broadcast once; the corpus is streamed through ``mapInPandas`` in its own
  partitioning (no corpus shuffle, vectors only: text stays in the JVM);
* **block path** (larger query sets): queries and chunks are cut into bounded blocks per
  collection (block counts grow with the collection, so a hot collection gets more blocks,
  not bigger ones), small collections share packs of a block's size, and block pairs meet
  in a ``cogroup`` -> ``applyInPandas``.

Either way the candidates (``k`` per query per partition/block) are shuffled once on the
collection and query id and cut to ``k`` by ``row_number`` (planned as ``WindowGroupLimit``, i.e. a partial
top-k before the exchange). Payload columns (text, page) are joined back on the chunk id
afterwards, for ``k`` rows per query only.

Order of results: ``round(distance, 9)``, then ``tie1``, ``tie2``, then chunk id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.vector import confidence as confidence_expr

QUERY_TILE = 1024
TILE_CELLS = 1 << 20   # distance-matrix cells per tile (8 MB of doubles), all of which may be equally near
NORMS = (1e-100, 1e100)  # lengths whose squares and quotients are normal doubles


@dataclass(frozen=True)
class KnnConfig:
    k: int = 5
    metric: str = "cosine"
    exclude_self: bool = False          # drop the candidate whose id equals the query id
    max_broadcast_bytes: int = 8 << 20   # query matrix bound for the broadcast path
    query_block: int = 8192             # rows per query block (block path)
    corpus_block: int = 32768           # rows per corpus block (block path)
    force_path: str | None = None       # "broadcast" | "block" (tests)


def _dist(Q: np.ndarray, C: np.ndarray, metric: str) -> np.ndarray:
    G = Q @ C.T
    if metric == "cosine":
        qn = np.sqrt(np.einsum("ij,ij->i", Q, Q))
        cn = np.sqrt(np.einsum("ij,ij->i", C, C))
        return 1.0 - G / np.outer(qn, cn)
    if metric == "ip":
        return 1.0 - G
    if metric == "l2sq":
        qq = np.einsum("ij,ij->i", Q, Q)
        cc = np.einsum("ij,ij->i", C, C)
        return np.maximum(qq[:, None] + cc[None, :] - 2.0 * G, 0.0)
    raise ValueError(metric)


def _round9(x: np.ndarray) -> np.ndarray:
    # half away from zero on the scaled value, as SQL round() does
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9


def reach(x: np.ndarray) -> np.ndarray:
    """No distance beyond this rounds to what ``x`` rounds to."""
    return x + 2e-9 + 4e-15 * np.abs(x)


def _topk_index(q, cid, t1, t2, key, k):
    """Indices of the first ``k`` rows per ``q`` ordered by (key, t1, t2, cid)."""
    if len(q) == 0:
        return np.array([], dtype=np.int64)
    order = np.lexsort((t2, t1, key, q))
    same = np.ones(len(q) - 1, dtype=bool)
    for x in (q, key, t1, t2):
        xs = x[order]
        same &= xs[1:] == xs[:-1]
    if same.any() or pd.isna(t2).any() or pd.isna(t1).any():   # only then do the ids decide
        order = np.lexsort((pd.factorize(cid, sort=True)[0], t2, t1, key, q))
    qs = q[order]
    start = np.searchsorted(qs, qs, side="left")
    return order[(np.arange(len(qs)) - start) < k]


def _near_candidates(qids, Q, cids, t1, t2, C, cfg: KnnConfig, self_ids):
    """:func:`_block_candidates` for cosine: products of unit vectors in single precision leave few cells, whose distances
    are then computed in double precision. None where lengths or ``k`` do not allow it.

    Cells are taken in chunks: ``k`` chunks hold a cell each that is as near as the k-th best chunk's best, so no cell that is
    farther by more than the error of two products is among the ``k`` best."""
    qn, cn = np.sqrt(np.einsum("ij,ij->i", Q, Q)), np.sqrt(np.einsum("ij,ij->i", C, C))
    q_ok, c_ok = ((x >= NORMS[0]) & (x <= NORMS[1]) for x in (qn, cn))
    if not (q_ok.all() and c_ok.all()):
        return None
    n, d = C.shape
    width = 128 if n >= 1 << 13 else 32
    chunks = -(-n // width)
    if chunks < max(16, 4 * cfg.k):
        return None
    margin = np.float32(4 * (d + 8) * 2.0 ** -24 + 1e-8)
    U = (Q / qn[:, None]).astype(np.float32)
    V = np.zeros((chunks * width, d), dtype=np.float32)
    V[:n] = C / cn[:, None]
    V = np.ascontiguousarray(V.T)
    out = []
    tile = max(1, min(QUERY_TILE, 2 * TILE_CELLS // (chunks * width)))
    for s in range(0, Q.shape[0], tile):
        S = U[s:s + tile] @ V
        S[:, n:] = -2
        if cfg.exclude_self:
            S[:, :n][self_ids[s:s + tile][:, None] == cids[None, :]] = -2
        S = S.reshape(len(S), chunks, width)
        best = S.max(axis=2)
        bound = np.maximum(np.partition(best, chunks - cfg.k, axis=1)[:, chunks - cfg.k] - margin, np.float32(-1.5))
        r, g = np.nonzero(best >= bound[:, None])
        if len(r) * width > S.size // 4:   # very many are equally near
            out.append(_dense_candidates(qids[s:s + tile], Q[s:s + tile], cids, t1, t2, C, cfg, self_ids[s:s + tile]))
            continue
        i, j = np.nonzero(S[r, g] >= bound[r][:, None])
        r, c = r[i], g[i] * width + j
        if len(r) == 0:
            continue
        D = np.concatenate([_pair_dist(Q[s + r[a:a + PAIR_BUDGET]], C[c[a:a + PAIR_BUDGET]], cfg.metric,
                                       qn[s + r[a:a + PAIR_BUDGET]], cn[c[a:a + PAIR_BUDGET]]) for a in range(0, len(r), PAIR_BUDGET)])
        key = _round9(D)
        keep = _topk_index(r, cids[c], t1[c], t2[c], key, cfg.k)
        r, c = r[keep], c[keep]
        out.append((qids[s + r], cids[c], t1[c], t2[c], D[keep], key[keep]))
    return [x for x in out if x is not None]


def _block_candidates(qids, Q, cids, t1, t2, C, cfg: KnnConfig, self_ids=None):
    """Top-k candidates of each query against one corpus block; returns flat arrays.

    ``self_ids`` (default ``qids``) are compared with ``cids`` when ``exclude_self`` is set."""
    self_ids = qids if self_ids is None else self_ids
    out = _near_candidates(qids, Q, cids, t1, t2, C, cfg, self_ids) if cfg.metric == "cosine" else None
    if out is None:
        return _dense_candidates(qids, Q, cids, t1, t2, C, cfg, self_ids)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(6)) if out else None


def _dense_candidates(qids, Q, cids, t1, t2, C, cfg: KnnConfig, self_ids):
    """:func:`_block_candidates` by all distances in double precision."""
    out = []
    n = C.shape[0]
    tile = max(1, min(QUERY_TILE, TILE_CELLS // max(n, 1)))
    for s in range(0, Q.shape[0], tile):
        Qt = Q[s:s + tile]
        qt = qids[s:s + tile]
        D = _dist(Qt, C, cfg.metric)
        D[~np.isfinite(D)] = np.inf
        if cfg.exclude_self:
            D[self_ids[s:s + tile][:, None] == cids[None, :]] = np.inf
        if n > cfg.k:
            # a little beyond the k-th distance, so that whatever rounds to it stays; only these are rounded
            kth = np.partition(D, cfg.k - 1, axis=1)[:, cfg.k - 1]
            mask = (D <= reach(kth)[:, None]) & np.isfinite(D)
        else:
            mask = np.isfinite(D)
        r, c = np.nonzero(mask)
        if len(r) == 0:
            continue
        key = _round9(D[r, c])
        keep = _topk_index(r, cids[c], t1[c], t2[c], key, cfg.k)
        r, c = r[keep], c[keep]
        out.append((qt[r], cids[c], t1[c], t2[c], D[r, c], key[keep]))
    if not out:
        return None
    return tuple(np.concatenate([o[i] for o in out]) for i in range(6))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)


def _valid(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[pdf["vec"].notna()] if pdf["vec"].isna().any() else pdf


def _candidate_schema(qtype: T.DataType, ctype: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("collection", T.StringType()),
        T.StructField("qid", qtype), T.StructField("cid", ctype),
        T.StructField("tie1", T.IntegerType()), T.StructField("tie2", T.LongType()),
        T.StructField("distance", T.DoubleType()), T.StructField("dkey", T.DoubleType()),
    ])


def _frame(c, coll) -> pd.DataFrame:
    return pd.DataFrame({"collection": coll, "qid": c[0], "cid": c[1], "tie1": c[2].astype("int32"), "tie2": c[3].astype("int64"),
                         "distance": c[4], "dkey": c[5]})


PAIR_MAX_Q = 32        # collections with at most this many queries take the pair path
PAIR_BUDGET = 1 << 16  # pairs per vectorised step (bounds the gathered arrays)


def _pair_dist(Qp: np.ndarray, Cp: np.ndarray, metric: str, qn: np.ndarray, cn: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", Qp, Cp)
    if metric == "cosine":
        return 1.0 - dot / (qn * cn)
    if metric == "ip":
        return 1.0 - dot
    if metric == "l2sq":
        return np.maximum(qn * qn + cn * cn - 2.0 * dot, 0.0)
    raise ValueError(metric)


def _payload(qpdf: pd.DataFrame) -> dict:
    """Queries sorted by collection, as flat arrays."""
    qpdf = _valid(qpdf)
    codes, uniques = pd.factorize(qpdf["collection"])
    order = np.argsort(codes, kind="stable")
    Q = _matrix(qpdf["vec"].iloc[order]) if len(order) else np.zeros((0, 1))
    if len(order) and np.asarray(qpdf["vec"].iloc[0]).dtype == np.float32:
        Q = Q.astype(np.float32)   # exact for float inputs; halves what is broadcast
    counts = np.bincount(codes, minlength=len(uniques)).astype(np.int64)
    return {
        "colls": list(uniques), "qids": qpdf["qid"].to_numpy()[order], "Q": Q,
        "code": codes[order].astype(np.int64), "counts": counts,
        "starts": (np.cumsum(counts) - counts).astype(np.int64),
    }


def _scan(p: dict, cfg: KnnConfig, batches) -> pd.DataFrame | None:
    """Top k of each query of ``p`` over corpus batches of any collections.

    Collections with few queries are handled together as (query, row) index pairs with one
    vectorised row-wise dot product (no per-collection Python loop: per-document collections
    are many and tiny); collections with many queries get a blocked matrix product. Of the
    running best only the queries a batch touches are merged anew.
    """
    Qa, qids, counts_, starts = p["Q"].astype(np.float64), p["qids"], p["counts"], p["starts"]
    code_of = {c: i for i, c in enumerate(p["colls"])}
    qnorm = np.sqrt(np.einsum("ij,ij->i", Qa, Qa)) if len(Qa) else np.zeros(0)
    acc = None
    for pdf in batches:
        cc = pdf["collection"].map(code_of)
        sub = pdf[cc.notna().to_numpy() & pdf["vec"].notna().to_numpy()]
        if len(sub) == 0:
            continue
        rcode = sub["collection"].map(code_of).to_numpy().astype(np.int64)
        C = _matrix(sub["vec"])
        cids, t1, t2 = sub["cid"].to_numpy(), sub["tie1"].to_numpy(), sub["tie2"].to_numpy()
        cnorm = np.sqrt(np.einsum("ij,ij->i", C, C))
        nq = counts_[rcode]
        parts = []
        # pair path: rows of collections with few queries, all collections at once
        rows = np.flatnonzero(nq <= PAIR_MAX_Q)
        if len(rows):
            reps = nq[rows]
            bounds = np.searchsorted(np.cumsum(reps), np.arange(PAIR_BUDGET, reps.sum() + PAIR_BUDGET,
                                                                PAIR_BUDGET), side="right")
            lo = 0
            for hi in np.unique(np.append(bounds, len(rows))):
                if hi <= lo:
                    continue
                rr, rp = rows[lo:hi], reps[lo:hi]
                lo = hi
                ci = np.repeat(rr, rp)
                qi = np.repeat(starts[rcode[rr]], rp) + (np.arange(rp.sum()) - np.repeat(np.cumsum(rp) - rp, rp))
                D = _pair_dist(Qa[qi], C[ci], cfg.metric, qnorm[qi], cnorm[ci])
                ok = np.isfinite(D)
                if cfg.exclude_self:
                    ok &= qids[qi] != cids[ci]
                qi, ci, D = qi[ok], ci[ok], D[ok]
                key = _round9(D)
                keep = _topk_index(qi, cids[ci], t1[ci], t2[ci], key, cfg.k)
                qi, ci = qi[keep], ci[keep]
                parts.append((qi, cids[ci], t1[ci], t2[ci], D[keep], key[keep]))
        # matrix path: one blocked product per large collection
        for code in np.unique(rcode[nq > PAIR_MAX_Q]):
            rr = np.flatnonzero(rcode == code)
            s0, n0 = starts[code], counts_[code]
            cand = _block_candidates(np.arange(s0, s0 + n0), Qa[s0:s0 + n0], cids[rr], t1[rr], t2[rr], C[rr],
                                     cfg, self_ids=qids[s0:s0 + n0])
            if cand is not None:
                parts.append(cand)
        if not parts:
            continue
        rest = None
        if acc is not None:
            touched = np.isin(acc[0], np.unique(np.concatenate([x[0] for x in parts])))
            parts.append(tuple(a[touched] for a in acc))
            rest = tuple(a[~touched] for a in acc)
        cand = tuple(np.concatenate([x[i] for x in parts]) for i in range(6))
        keep = _topk_index(cand[0].astype(np.int64), cand[1], cand[2], cand[3], cand[5], cfg.k)
        acc = tuple(a[keep] for a in cand)
        if rest is not None:
            acc = tuple(np.concatenate(x) for x in zip(acc, rest))
    if acc is None:
        return None
    qi = acc[0].astype(np.int64)
    return _frame((qids[qi],) + acc[1:], np.asarray(p["colls"], dtype=object)[p["code"][qi]])


def _broadcast_candidates(corpus: DataFrame, qpdf: pd.DataFrame, cfg: KnnConfig, qtype, ctype) -> DataFrame:
    """Queries (checked size) are broadcast once; the corpus streams in its own partitioning."""
    bc = corpus.sparkSession.sparkContext.broadcast(_payload(qpdf))

    def kernel(batches):
        out = _scan(bc.value, cfg, batches)
        if out is not None:
            yield out

    return corpus.select("collection", "cid", "tie1", "tie2", "vec").mapInPandas(
        kernel, _candidate_schema(qtype, ctype))


def _block_path_candidates(queries: DataFrame, corpus: DataFrame, cfg: KnnConfig, qtype, ctype) -> DataFrame:
    """Groups of bounded size: a large collection is cut into blocks, collections of one block
    each share a pack (so millions of tiny collections are not a Python call each), which counts
    their queries as well as their chunks."""
    qn = queries.groupBy("collection").agg(F.count(F.lit(1)).alias("nq"))
    cn = corpus.groupBy("collection").agg(F.count(F.lit(1)).alias("nc"))
    nb = (qn.join(cn, "collection")
          .select("collection", (F.col("nc") + F.col("nq")).alias("rows"),
                  F.ceil(F.col("nq") / cfg.query_block).cast("int").alias("nqb"),
                  F.ceil(F.col("nc") / cfg.corpus_block).cast("int").alias("ncb")))
    single = (F.col("nqb") == 1) & (F.col("ncb") == 1)
    packed = nb.agg(F.sum(F.when(single, F.col("rows")))).first()[0] or 0
    packs = max(1, -(-packed // cfg.corpus_block))
    nb = nb.select("collection", "nqb", "ncb", F.when(single, F.concat(F.lit("p"), F.pmod(F.xxhash64("collection"), F.lit(packs)).cast("string")))
                   .otherwise(F.concat(F.lit("c"), "collection")).alias("pack"))
    q = (queries.join(nb, "collection")
         .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("ncb") - 1)))
         .select(F.col("pack").alias("q_pack"), "collection", "qb", "cb", "qid", "vec"))
    c = (corpus.join(nb, "collection")
         .withColumn("cb", F.pmod(F.xxhash64("cid"), F.col("ncb")).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)))
         .select(F.col("pack").alias("c_pack"), "collection", "qb", "cb", "cid", "tie1", "tie2", "vec"))

    def pair_kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        out = _scan(_payload(qpdf), cfg, [cpdf]) if len(qpdf) and len(cpdf) else None
        return out if out is not None else _frame(tuple(np.array([]) for _ in range(6)), [])

    return q.groupBy("q_pack", "qb", "cb").cogroup(c.groupBy("c_pack", "qb", "cb")).applyInPandas(pair_kernel, _candidate_schema(qtype, ctype))


def knn(queries: DataFrame, corpus: DataFrame, cfg: KnnConfig = KnnConfig()) -> DataFrame:
    """Exact k nearest corpus rows per query, within the same collection.

    ``queries``: ``collection, qid, vec array<float|double>`` (null vectors are skipped).
    ``corpus``: ``collection, cid, tie1 int, tie2 bigint, vec`` (null vectors are skipped).
    Returns ``collection, qid, rank, cid, tie1, tie2, distance, confidence``.
    """
    # Null vectors are dropped inside the Python kernels: a Spark filter on ``vec`` would be
    # pushed below the projection that computes it and re-inline the embedding expression.
    qtype = queries.schema["qid"].dataType
    ctype = corpus.schema["cid"].dataType
    path = cfg.force_path
    qpdf = None
    if path != "block":
        # size check before anything is collected: rows and the bytes of their names are counted without their
        # vectors, whose width is that of the first ones
        width = 4 if isinstance(queries.schema["vec"].dataType.elementType, T.FloatType) else 8
        # (no filter on ``vec``: it would be pushed into the projection that computes it)
        head = [r["d"] for r in queries.select(F.size("vec").alias("d")).limit(16).collect() if r["d"] and r["d"] > 0]
        names = F.octet_length("collection") + F.octet_length(F.col("qid").cast("string"))
        size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(names).alias("names")).first()
        if size["n"] * (width * (head[0] if head else 1024) + 48) + (size["names"] or 0) <= cfg.max_broadcast_bytes:
            path, qpdf = "broadcast", queries.select("collection", "qid", "vec").toPandas()
        elif path == "broadcast":
            raise ValueError(f"{size['n']} queries are over max_broadcast_bytes, use the block path")
        else:
            path = "block"
    if path == "broadcast":
        cand = _broadcast_candidates(corpus, qpdf, cfg, qtype, ctype)
    else:
        cand = _block_path_candidates(queries, corpus, cfg, qtype, ctype)
    w = Window.partitionBy("collection", "qid").orderBy("dkey", "tie1", "tie2", "cid")
    top = (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.k))
    return top.select("collection", "qid", F.col("rank").cast("int").alias("rank"), "cid", "tie1", "tie2", "distance",
                      confidence_expr(F.col("distance")).alias("confidence"))
