"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie one after the other in flat numpy arrays. Each round looks up the
rank of every adjacent pair, takes each pre-token's lowest rank, joins all places of that pair
in all pre-tokens at once and drops the pre-tokens without a pair left. What survives is
counted; an unknown character counts its UTF-8 bytes, as byte fallback spells it.

A sentencepiece BPE model joins over the whole text, yet none of its pieces holds a space mark
behind another character, and none holds a line break with another character. So no join
crosses the start of a run of space marks or a line break, and what lies between are exact
pre-tokens (a line break stays in front of the word it is followed by: it joins with nothing). :func:`merger` checks these facts of the model file it is given.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import slices, text_of

SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max
CACHE_WORDS = 400_000       # pre-tokens whose counts a Python worker remembers
BATCH_CHARS = 1 << 21       # characters merged at once
ODD = rf"^ |  | \n| $|{SPACE}"     # texts whose space marks are not one in front of each word
PIECES = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")


class Merger:
    """Pair ranks of a sentencepiece BPE model, and the counts of words seen lately."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in pieces):
            raise ValueError("the model joins over spaces or line breaks: pre-tokens would not be exact")
        if sp.encode("ﬁ  x", out_type=str)[0][0] != SPACE or "".join(sp.encode("ﬁ  x", out_type=str)) != f"{SPACE}ﬁ{SPACE}{SPACE}x":
            raise ValueError("only models that keep the text as it is and add a space in front are counted")
        score = np.array([sp.get_score(i) for i in plain])
        rank = np.unique(-score, return_inverse=True)[1]
        index = {p: k for k, p in enumerate(pieces)}
        self.n = len(pieces)
        keys, ranks, made = [], [], []
        for k, p in enumerate(pieces):
            for cut in range(1, len(p)):
                a, b = index.get(p[:cut]), index.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    ranks.append(rank[k])
                    made.append(k)
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.r_[np.array(ranks, np.int32)[order], np.int32(NO_RANK)]
        self.made = np.r_[np.array(made, np.int32)[order], np.int32(0)]
        code = np.arange(0x110000)
        self.char = (self.n + 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).astype(np.int32)
        if not any(sp.is_byte(i) for i in range(sp.get_piece_size())):
            self.char[:] = self.n + 1
        for p, k in index.items():
            if len(p) == 1:
                self.char[ord(p)] = k
        self.seen: dict[str, int] = {}

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the table; the last place if it is none."""
        key = np.where((a < self.n) & (b < self.n), a.astype(np.int64) * self.n + b, -1)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Number of tokens of each (non-empty) pre-token."""
        size = np.array([len(p) for p in pretokens])
        sym = self.char[np.frombuffer("".join(pretokens).encode("utf-32-le"), np.uint32)]
        out = np.zeros(len(pretokens), np.int64)
        who = np.arange(len(pretokens))                   # the pre-tokens still merging
        pair = np.r_[self.look(sym[:-1], sym[1:]), len(self.keys)]
        pair[np.cumsum(size) - 1] = len(self.keys)        # a pre-token's last symbol has no right neighbour
        while who.size:
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(self.ranks[pair], first)
            done = low == NO_RANK
            if done.any():
                weight = np.maximum(sym - self.n, 1)
                out[who[done]] = np.add.reduceat(weight, first)[done]
                keep = np.repeat(~done, size)
                sym, pair, who, size, low = sym[keep], pair[keep], who[~done], size[~done], low[~done]
                if not who.size:
                    break
                first = np.cumsum(size) - size
            seq = np.repeat(np.arange(len(who)), size)
            hit = self.ranks[pair] == low[seq]
            at = np.flatnonzero(hit)
            fresh = np.r_[True, at[1:] != at[:-1] + 1]    # places that overlap: every second one from the left
            run = at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            take = at[run % 2 == 0]
            joined = self._join(sym, pair, seq, size, take)
            # one place after the other would go on with a new pair of a lower rank first
            early = np.minimum.reduceat(self.ranks[joined[1]], np.cumsum(joined[2]) - joined[2]) < low
            several = np.bincount(seq[take], minlength=len(who)) > 1
            if (early & several).any():
                head = np.r_[True, seq[take][1:] != seq[take][:-1]]
                joined = self._join(sym, pair, seq, size, take[head | ~(early & several)[seq[take]]])
            sym, pair, size = joined
        return out

    def _join(self, sym, pair, seq, size, take):
        sym, pair = sym.copy(), pair.copy()
        sym[take] = self.made[pair[take]]
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        old, (sym, seq, pair) = keep.nonzero()[0], (sym[keep], seq[keep], pair[keep])
        new = np.searchsorted(old, take)
        touched = np.unique(np.r_[new, new[new > 0] - 1])
        inner = touched[(touched < len(sym) - 1)]
        inner = inner[seq[inner] == seq[inner + 1]]
        pair[touched] = len(self.keys)
        pair[inner] = self.look(sym[inner], sym[inner + 1])
        return sym, pair, size - np.bincount(seq_of(take, size), minlength=len(size))

    def learn(self, words) -> None:
        """Count words that are not remembered, in bounded batches. A word that starts with a line
        break stands for itself, any other for itself behind one space mark."""
        new, chars = [], 0
        for w in words:
            new.append(w)
            chars += len(w)
            if chars >= BATCH_CHARS:
                self._remember(new)
                new, chars = [], 0
        if new:
            self._remember(new)

    def _remember(self, words: list[str]) -> None:
        self.seen.update(zip(words, self.counts([w if w[:1] == "\n" else SPACE + w for w in words]).tolist()))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        out = np.zeros(len(texts), np.int64)
        slow = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        fast = texts.filter(pa.array(~slow))
        lists = pc.split_pattern(pc.replace_substring(fast, "\n", " \n"), " ")
        out[~slow] = self._sums(pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        cut = [[w.removeprefix(SPACE) for w in PIECES.findall(SPACE + t.replace(" ", SPACE))] for t in texts.filter(pa.array(slow)).to_pylist()]
        out[slow] = self._sums(pa.array([w for c in cut for w in c], pa.string()), [len(c) for c in cut])
        return np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, out, 0)

    def _sums(self, words: pa.Array, sizes) -> np.ndarray:
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        self.learn([w for w in own if w not in self.seen])
        each = np.fromiter(map(self.seen.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        return np.diff(np.r_[0, np.cumsum(each)][np.cumsum(np.asarray(sizes, np.int64))], prepend=0)


def seq_of(take: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pre-token each flat place belongs to."""
    return np.searchsorted(np.cumsum(size), take, side="right")


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, for the sentencepiece BPE model
    file ``model`` (a path every executor has).

    Null counts as the empty text, which has no token. A null doc_id stays null, repeated rows come
    back as often as given, an empty table gives an empty table, other columns are not read. Memory
    is bounded by an Arrow batch, one text's pre-tokens and the remembered pre-tokens."""
    def run(batches):
        m = merger(model)
        for b in batches:
            for part in slices(b, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(m.texts(part.column(2)), pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])
    t = text_of(text)
    counted = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.octet_length(t).cast("bigint").alias("n_bytes"), t.alias("text")).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
