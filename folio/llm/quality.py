"""Positive-unlabelled quality classifier.

Learns from trusted positives and unlabelled text alone. With prior p, risk of a linear score f
under logistic loss l is  p*E_P[l(f)] + max(0, E_U[l(-f)] - p*E_P[l(-f)]):  the second term is
the unbiased estimate of the negatives' risk and is kept from going below zero. Without the
maximum this is convex, so Newton steps on sums over all documents find the minimum in a few
passes; where the estimate is negative its gradient is left out, and steps that raise the risk
are halved. Every pass is one sum over all rows of the feature table: no sample is taken.

Features see the text only: shares of each ASCII punctuation mark, of upper case, digits, white
space and bytes beyond ASCII, word and line lengths, repeated lines and words. They are standardised
by means and deviations over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import text_of, written

MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
N = len(MARKS) + 12
RIDGE = 1e-2
PASSES = 14


def features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text; the empty text has all zeros."""
    out = np.zeros((len(texts), N), np.float32)
    for k, t in enumerate(texts):
        raw = t.as_buffer()
        n = raw.size
        if not n:
            continue
        c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, lower, digits, beyond = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
        gaps, breaks = c[32] + c[9], c[10]
        body = raw.to_pybytes()
        lines, words = body.split(b"\n") if breaks else [b""], body.split()
        twice = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
        out[k, :len(MARKS)] = np.log1p(1000 * c[MARKS] / n)
        out[k, len(MARKS):] = (upper / max(upper + lower, 1), digits / n, beyond / n, gaps / n, np.log1p(1000 * breaks / n), np.log1p(n),
                               np.log1p((n - gaps - breaks) / (gaps + breaks + 1)), 1 - len(set(lines)) / len(lines),
                               np.log1p(n / (breaks + 1)), np.log1p(c[:32].sum() - breaks - c[9]),
                               np.log1p(100 * twice), len(set(words)) / max(len(words), 1))
    return out


@dataclass
class Model:
    """score = 1 / (1 + exp(-(weights . standardised features + weights[-1])))"""
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.c_[z, np.ones(len(z))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def held_out(doc_id: str) -> Column:
    """True for ids whose labels are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trusted(labels: DataFrame) -> DataFrame:
    """(id, quality): learnable labels, one row an id; an id with both labels is not trusted."""
    return labels.where(~held_out("doc_id") & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("id")).agg(F.min("quality").alias("quality"))


def feature_table(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, positive, x) of every row of ``docs``, written once."""
    def run(batches):
        for b in batches:
            x = features(b.column(1).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N).cast(pa.list_(pa.float32()))], ["doc_id", "x"])
    x = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id bigint, x array<float>")
    known = trusted(labels).where("quality = 1").select("id", F.lit(True).alias("positive"))
    return written(x.join(known, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", held_out("doc_id").alias("held_out"), F.coalesce("positive", F.lit(False)).alias("positive"), "x"), "features")


def _sums(table: DataFrame, fn, n: int) -> np.ndarray:
    """Sum of the vectors (of n numbers) that ``fn`` gives for (positive, x) of each batch."""
    def run(batches):
        total = np.zeros(n)
        for b in batches:
            total += fn(np.asarray(b.column(0)), b.column(1).values.to_numpy().reshape(-1, N).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])
    rows = (table.select("positive", "x").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v"))
            .groupBy("k").agg(F.sum("v").alias("v")).collect())      # n rows
    out = np.zeros(n)
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def estimated_prior(labels: DataFrame) -> float:
    """Share of good documents: that among the learnable labels (0.5 if there are none)."""
    r = trusted(labels).agg(F.avg((F.col("quality") == 1).cast("double")), F.count("*")).first()
    return min(max(r[0], 0.01), 0.99) if r[1] else 0.5


def fit(table: DataFrame, prior: float) -> Model:
    """Minimise the non-negative risk over the whole feature table."""
    def moments(pos, x):
        return np.r_[len(x), pos.sum(), x.sum(0), (x * x).sum(0)]
    m = _sums(table, moments, 2 + 2 * N)
    n, n_pos = max(m[0], 1), m[1]
    mean = m[2:2 + N] / n
    deviation = np.sqrt(np.maximum(m[2 + N:] / n - mean ** 2, 0))
    model = Model(mean, np.where(deviation > 1e-6, deviation, 1), np.r_[np.zeros(N), np.log(prior / (1 - prior))])
    if not n_pos:
        return model            # nothing to learn from: the prior for every text
    d = N + 1

    def at(w):
        here = Model(model.mean, model.deviation, w)

        def part(pos, x):
            z = here.inputs(x)
            f = np.clip(z @ w, -30, 30)
            s, up = 1 / (1 + np.exp(-f)), np.log1p(np.exp(f))       # up: l(-f), up - f: l(f)
            zp, sp = z[pos], s[pos]
            return np.r_[up.sum(), up[pos].sum(), (up[pos] - f[pos]).sum(), z.T @ s, zp.T @ sp, zp.sum(0), ((z.T * (s * (1 - s))) @ z).ravel()]
        v = _sums(table, part, 3 + 3 * d + d * d)
        negative = v[0] / n - prior * v[1] / n_pos
        risk = prior * v[2] / n_pos + max(0, negative) + RIDGE / 2 * (w[:-1] ** 2).sum()
        u, p, ones = (v[3 + k * d:3 + (k + 1) * d] for k in range(3))
        slope = prior * (p - ones) / n_pos + (u / n - prior * p / n_pos if negative > 0 else 0) + RIDGE * np.r_[w[:-1], 0]
        return risk, slope, v[3 + 3 * d:].reshape(d, d) / n + (RIDGE + 1e-6) * np.eye(d)

    w = model.weights
    risk, slope, curve = at(w)
    step, passes = np.linalg.solve(curve, -slope), 1
    while passes < PASSES and np.abs(step).max() > 1e-3:
        new = at(w + step)
        passes += 1
        if new[0] <= risk:
            done, w = risk - new[0] < 1e-6, w + step
            risk, slope, curve = new
            if done:
                break
            step = np.linalg.solve(curve, -slope)
        else:
            step = step / 2
    return Model(model.mean, model.deviation, w)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    ``labels``: (doc_id, quality); the labels of held-out ids are not looked at. Null counts as the
    empty text, which is scored like any other; repeated rows come back as often as given; a null
    doc_id is not held out and has no label; without labels every score is the prior; an empty
    table gives an empty table; other columns are not read."""
    table = feature_table(docs, labels, doc_id, text)
    model = fit(table, estimated_prior(labels) if prior is None else prior)

    def run(batches):
        for b in batches:
            s = model.score(b.column(2).values.to_numpy().reshape(-1, N).astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])
    return table.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier learnt from them accepts, all columns as they are."""
    model = fit(feature_table(docs, labels, doc_id, text), estimated_prior(labels))
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            s = model.score(features(b.column(place).fill_null("").cast(pa.large_binary())).astype(float))
            yield b.filter(pa.array(s >= 0.5))
    return docs.mapInArrow(run, docs.schema)
