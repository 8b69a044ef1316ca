"""Cross-tokenizer alignment of each different text once.

Texts are shuffled whole, so that equal ones meet (repeats within a task are counted before that),
and each different text goes through both tokenizers once. Token ends in bytes that both have cut it
into groups, and the tokens that end there are linked. Pair counts weigh a text's links by the
number of its documents; its measures then go back to its documents over the text's SHA-256.

Linked tokens end at the same byte, so the bytes of one are the end of the other's. This leaves one
possible pair for each end of each token, a list that the two vocabularies fix whatever the corpus
(:class:`Pair`), so pair counts are an array of known size that may be collected and broadcast.
"""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import hot_join, slices, text_of, written
from folio.llm.token_ids import Encoder, ragged

SLICE = 2 << 20         # bytes of text that are aligned at once
MOST_PAIRS = 4_000_000  # possible pairs; two vocabularies of 50,000 and 32,000 have some 300,000
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others, in order, for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Spelling:
    """The bytes of a vocabulary's tokens, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(x) for x in tokens], np.int64)
        if not self.size.all():
            raise ValueError("a token without bytes would end where the one before it does")
        self.at, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.at[ids], self.size[ids])]


class Pair:
    """Two tokenizers: (A) a byte-level one of the tokenizers library, which gets a space and the text, and
    (B) a sentencepiece model, which adds the space itself; and all pairs their tokens can form."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        self.a = Encoder(a_path)
        self.a.library.encode_special_tokens = True     # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own = byte_level()
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.a_table, self.b_table = Spelling(self.a_bytes), Spelling(self.b_bytes)
        named = [defaultdict(list) for _ in range(2)]
        for names, table in zip(named, (self.a_bytes, self.b_bytes)):
            for k, x in enumerate(table):
                names[x].append(k)
        n = len(self.b_bytes)
        keys = {a * n + b for a, x in enumerate(self.a_bytes) for i in range(len(x)) for b in named[1].get(x[i:], ())}
        keys |= {a * n + b for b, x in enumerate(self.b_bytes) for i in range(len(x)) for a in named[0].get(x[i:], ())}
        if len(keys) > MOST_PAIRS:
            raise ValueError(f"{len(keys)} possible pairs of tokens: too many to broadcast their counts")
        self.keys = np.sort(np.fromiter(keys, np.int64, len(keys)))
        self.b_of = (self.keys % n).astype(np.int64)
        # ids as text behind which comes another of the same side, the other side, another group
        self.spelt = [str(k) + end for size in (len(self.a_bytes), n) for k in range(size) for end in (",", "|", ";")]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of pairs of ids in the list of possible ones."""
        return np.searchsorted(self.keys, a.astype(np.int64) * len(self.b_bytes) + b)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many each text has, and the same of B; none where the bytes are not the text's."""
        given = [" " + t for t in texts]
        a, na = self.a.texts(pa.array(given, pa.string()), 0)
        ends = np.cumsum(na)
        a, na = np.delete(a, ends - 1).astype(np.int64), na - 1
        lists = self.b.encode(texts, num_threads=1)
        nb = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(nb.sum()))
        raw = [x.encode() for x in given]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        right = size > 1
        whole = np.frombuffer(b"".join(raw), np.uint8)
        for table, ids, n in ((self.a_table, a, na), (self.b_table, b, nb)):
            got = table.spell(ids)
            sizes = np.diff(np.r_[0, np.cumsum(table.size[ids])][np.cumsum(n)], prepend=0)
            some = right & (sizes == size)
            if not (some.all() and np.array_equal(got, whole)):     # text by text
                at, to = np.cumsum(sizes) - sizes, np.cumsum(size) - size
                some &= [bool(ok) and np.array_equal(got[i:i + k], whole[j:j + k]) for ok, i, j, k in zip(some, at, to, size)]
            right = some
        if not right.all():
            a, b = a[np.repeat(right, na)], b[np.repeat(right, nb)]
            na, nb = np.where(right, na, 0), np.where(right, nb, 0)
        return a, na, b, nb

    def align(self, texts: list[str]) -> tuple:
        """Of each text: n_a, n_b, n_groups, number of links and groups_sha256; and all links, one text after
        the other, as places in the list of possible pairs."""
        a, na, b, nb = self.tokens(texts)
        enda, endb = np.cumsum(self.a_table.size[a]), np.cumsum(self.b_table.size[b])     # the texts' bytes are the same on both sides
        cut = enda[np.isin(enda, endb, assume_unique=True)]
        after_a, after_b = np.searchsorted(enda, cut) + 1, np.searchsorted(endb, cut) + 1
        link = self.pairs(a[after_a - 1], b[after_b - 1])       # no token is empty, so one of each side ends there
        # groups as text: A's ids of a group, then B's
        codes_a, codes_b = 3 * a, 3 * (b + len(self.a_bytes))
        codes_a[after_a - 1] += 1
        codes_b[after_b - 1] += 2
        group_a, group_b = np.searchsorted(cut, enda), np.searchsorted(cut, endb)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.r_[0, after_b][group_a]] = codes_a
        codes[np.arange(len(b)) + after_a[group_b]] = codes_b
        spelt, shas = map(self.spelt.__getitem__, codes.tolist()), []
        for n in (na + nb).tolist():
            shas.append(hashlib.sha256("".join(islice(spelt, n))[:-1].encode()).hexdigest() if n else "")
        upto = np.searchsorted(after_a, np.cumsum(na), side="right")    # groups up to each text's end
        groups = np.diff(upto, prepend=0)
        return na, nb, groups, groups, shas, link


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, n_docs): each different text and how many rows have it; null is the empty text."""
    return docs.select(text_of(text).alias("text")).groupBy("text").agg(F.count("*").alias("n_docs"))


def aligned_texts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(text_sha, n_docs, n_a, n_b, n_groups, n_links, groups_sha256, links) of distinct texts; ``links``: the
    places of the linked pairs in the list of possible pairs, as little-endian 32-bit numbers."""
    names = ["text_sha", "n_docs", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches):
        p = pair(a_path, b_path)
        for batch in batches:
            for some in slices(batch, 2, SLICE):
                na, nb, groups, n_links, shas, link = p.align(some.column(2).to_pylist())
                ends = np.cumsum(n_links)
                raw = [link[i:j].astype("<i4").tobytes() for i, j in zip(ends - n_links, ends)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *map(pa.array, (na, nb, groups, n_links)), pa.array(shas, pa.string()), pa.array(raw, pa.binary())], names)

    return texts.select(F.sha2("text", 256).alias("text_sha"), "n_docs", "text").mapInArrow(
        run, "text_sha string, n_docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary")


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, links): how many links of all documents each pair of ids has; a task adds up its own first."""
    def run(batches):
        total = np.zeros(len(pair(a_path, b_path).keys), np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                np.add.at(total, np.frombuffer(raw.as_buffer(), "<i4"), n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "links"])

    return aligned.select("n_docs", "links").mapInArrow(run, "pair int, links bigint").groupBy("pair").agg(F.sum("links").alias("links"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``a_path``, ``b_path``: files every executor has. A text that is null, empty or not given back by
    either tokenizer's bytes has no tokens (zeros, and an empty string for the hash). Rows without a doc_id
    stay without, repeated rows come back as often as given, an empty table gives an empty table, other
    columns are not read. A task holds some texts of together 2 MB, or one, with their tokens, and the pair counts."""
    spark = docs.sparkSession
    table = written(aligned_texts(distinct_texts(docs, text), a_path, b_path), "aligned")
    p = pair(a_path, b_path)
    counts = np.zeros(len(p.keys), np.int64)
    found = pair_counts(table, a_path, b_path).toArrow()       # at most all possible pairs
    counts[found.column("pair").to_numpy()] = found.column("links").to_numpy()
    best = np.zeros(len(p.b_bytes), np.int64)
    np.maximum.at(best, p.b_of, counts)
    shared = spark.sparkContext.broadcast((counts, counts == best[p.b_of]))
    names = ["text_sha", "matches", *MEASURES, "groups_sha256"]

    def measure(batches):
        count, top = shared.value
        for batch in batches:
            links = [np.frombuffer(raw.as_buffer(), "<i4") for raw in batch.column(7)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([int(top[x].sum()) for x in links], pa.int64()), pa.array([int(count[x].sum()) for x in links], pa.int64()),
                                              batch.column(6)], names)

    longs = ", ".join(f"{x} bigint" for x in MEASURES)
    measured = written(table.mapInArrow(measure, f"text_sha string, matches bigint, {longs}, groups_sha256 string"), "measured")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.sha2(text_of(text), 256).alias("text_sha"))
    total = measured.agg(F.sum("matches")).first()[0] or 0
    return hot_join(rows, measured, ["text_sha"], total).select("doc_id", *MEASURES, "groups_sha256")
