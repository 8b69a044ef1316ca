"""Vector expressions: the default hashed bag-of-words embedder and distances.

The default embedder is a stand-in, not a language model: each token goes to slot
``int(md5(token)[:8], 16) % dim``, slot counts are L2-normalised. It is plain SQL, so it
runs inside codegen and the same function can be written in any SQL engine. A real model
plugs in through :func:`folio.operators.chunks.model_embedder` (a pandas UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import col_, tokens

DEFAULT_DIM = 64


def token_slots(tok_array: Column, dim: int = DEFAULT_DIM) -> Column:
    return F.transform(
        tok_array,
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)),
    )


MARKS = "".join(chr(i) for i in range(48, 127))   # one byte a slot


def slot_marks(slots: Column) -> Column:
    """The slots as one text, a letter of :data:`MARKS` each (for a ``dim`` of ``len(MARKS)`` at most)."""
    return F.array_join(F.transform(slots, lambda s: F.char(s + ord(MARKS[0]))), "")


def mark_counts(marks: Column, dim: int = DEFAULT_DIM) -> Column:
    """:func:`slot_counts` from :func:`slot_marks`: bytes that go when a letter is taken out. ``marks`` is referenced twice, as
    ``slots`` there; texts are searched by the byte, arrays by boxed elements."""
    return F.transform(F.array(*[F.lit(m) for m in MARKS[:dim]]),
                       lambda m: F.octet_length(marks) - F.octet_length(F.replace(marks, m, F.lit(""))))


def slot_counts(slots: Column, dim: int = DEFAULT_DIM) -> Column:
    """``array<int>`` of length ``dim`` from an already computed slot array.

    ``size(slots) - size(array_remove(slots, i))`` keeps the inner loop in native array code;
    ``slots`` is referenced twice, so Catalyst keeps it in its own projection and it is
    computed once per row (a lambda that re-read an inlined ``md5`` expression would hash
    every token ``dim`` times).
    """
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.size(slots) - F.size(F.array_remove(slots, i)))


def with_slot_counts(df: DataFrame, text_col: str, out_col: str = "counts", dim: int = DEFAULT_DIM) -> DataFrame:
    tmp = f"__slots_{out_col}"
    slots = token_slots(tokens(F.col(text_col)), dim)
    if dim <= len(MARKS):
        return df.withColumn(tmp, slot_marks(slots)).withColumn(out_col, mark_counts(F.col(tmp), dim)).drop(tmp)
    return df.withColumn(tmp, slots).withColumn(out_col, slot_counts(F.col(tmp), dim)).drop(tmp)


def with_hashed_embedding(df: DataFrame, text_col: str, out_col: str = "embedding",
                          dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds the default embedding of ``text_col`` (``array<float>``, null when no tokens)."""
    tmp = f"__counts_{out_col}"
    return with_slot_counts(df, text_col, tmp, dim).withColumn(out_col, normalize(F.col(tmp))).drop(tmp)


def sum_squares(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, v: a + (v * v).cast("bigint"))


def normalize(counts: Column) -> Column:
    """Unit-length ``array<float>``; null for a zero vector (no tokens).

    The square sum is folded once and handed to the finish lambda, so the norm is not
    recomputed per element.
    """
    return F.aggregate(
        counts, F.lit(0).cast("bigint"), lambda a, v: a + (v * v).cast("bigint"),
        lambda s: F.when(s > 0, F.transform(counts, lambda v: (v / F.sqrt(s)).cast("float"))),
    )


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b, metric: str = "cosine") -> Column:
    """Distance as the store reports it: cosine ``1-cos``, ``l2sq`` squared L2, ``ip`` ``1-a.b``."""
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
    if metric == "l2sq":
        return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                           F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def confidence(dist) -> Column:
    """``round(max(0, 1 - distance), 4)``."""
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - col_(dist)), 4)
