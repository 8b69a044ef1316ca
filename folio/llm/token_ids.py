"""Token-id files in a static range asymmetric numeral system (rANS).

Documents are written in ascending doc_id order. A segment holds up to SEGMENT_IDS ids with one
frequency table over all of them, which its blocks share. A block holds whole documents; its ids
are dealt out in turn to interleaved lanes, each lane a 64-bit rANS state that renormalises by
32-bit words, and all lanes step together as one numpy operation. Each block has the lanes' final
states (its checkpoint), its words and a CRC-32 over these and its documents' ids and lengths: any
block decodes alone, given its segment's table.

The files are Parquet (so that every store Spark writes will do), one row a segment: see SEGMENT.

Texts are cut before a space or line break that follows a character other than white space.
Byte-level BPE pre-tokens never span such a place, so the cuts encode exactly as the whole text
does, and each different piece goes through the tokenizers library once while it is remembered.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from folio.llm.common import slices, text_of
from folio.session import scratch_path

SCALE = 18                      # the table's frequencies sum to 2^18, which bounds the number of ids
LOW = 1 << 31                   # a lane's state stays in [2^31, 2^63)
BLOCK_IDS = 1 << 18             # a block is closed by the document that reaches so many ids
SEGMENT_IDS = 1 << 22           # and a segment by the block that reaches so many
LANES = 1024
STEPS = 128                     # a block of fewer than LANES * STEPS ids gets fewer lanes
SLICE = 4 << 20                 # bytes of text that are encoded at once
CACHE_PIECES = 700_000         # pieces a Python worker remembers
BLOCK = pa.struct([("n_docs", pa.int64()), ("n_ids", pa.int64()), ("states", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())])
ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("freqs", pa.list_(pa.int32())),
                   ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(BLOCK))])
SEGMENT = ("part int, segment int, first bigint, n_ids bigint, ids array<int>, freqs array<int>, doc_ids array<bigint>, lengths array<bigint>, "
           "blocks array<struct<n_docs:bigint,n_ids:bigint,states:binary,words:binary,crc32:bigint>>")
ROW_GROUPS = {"parquet.block.size": str(16 << 20), **{f"parquet.{x}.size.row.check.{y}": "1" for x in ("block", "page") for y in ("min", "max")}}
PLAIN = re.compile(r"(?!\0\Z)[\0\n]?\S+").fullmatch     # a mark alone is the empty piece, which would be an empty line
INSIDE = r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}][ \n]|\x00"     # white space before a cut, or our own mark
CUT = re.compile(r"(?<=\S)(?=[ \n])")


# ---------------------------------------------------------------- ids

class Encoder:
    """Ids of whole texts through the tokenizers library, with the pieces seen lately remembered."""

    def __init__(self, path: str, remember: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        self.library, self.remember = Tokenizer.from_file(path), remember
        self.line_break = self._each(["\n"])[0]
        if len(self.line_break) != 1 or [i for w in (" a", "b", " c") for i in [*self._each([w])[0], *self.line_break]] != self._each([" a\nb\n c\n"])[0]:
            raise ValueError("line breaks do not part pre-tokens in this tokenizer")
        self.clear()

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.size, self.at = np.empty(1 << 19, np.int64), np.empty(1 << 19, np.int64)
        self.hits = np.zeros(1 << 19, np.int32)     # batches that held the piece since the last forget()

    def forget(self) -> None:
        """Keep the pieces that several batches held, at most half of what may be remembered."""
        pieces, hits, least = list(self.seen), self.hits[:len(self.seen)], 2
        while np.count_nonzero(hits >= least) > self.remember // 2:
            least *= 2
        keep = np.flatnonzero(hits >= least)
        ids, sizes = self.flat[ragged(self.at[keep], self.size[keep])], self.size[keep]
        self.clear()
        self._add([pieces[k] for k in keep], ids, sizes)
        release()

    def learn(self, pieces: list[str]) -> None:
        """A piece with NUL in front stands for what follows it, one with a line break in front for
        itself, any other for itself behind a space. Pieces without further white space go through
        the library many at a time, one a line."""
        plain, odd = [], []
        for p in pieces:
            (plain if PLAIN(p) and "<|" not in p else odd).append(p)
        for k in range(0, len(plain), 1 << 16):
            some = plain[k:k + (1 << 16)]
            lines = [p[1:] if p[0] in "\0\n" else " " + p for p in some]
            got = self._each(["\n".join(lines[j:j + 2048]) + "\n" for j in range(0, len(lines), 2048)])
            ids = np.fromiter(chain.from_iterable(got), np.int32, sum(map(len, got)))
            ends = np.flatnonzero(ids == self.line_break[0])
            self._remember(some, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1, [p[0] == "\n" for p in some])
        for k in range(0, len(odd), 4096):
            some = odd[k:k + 4096]
            behind = [p[:1] == "\n" and PLAIN(p) is not None for p in some]
            got = self._each([p[1:] if p[:1] == "\0" or b else p if p[:1] == "\n" else " " + p for p, b in zip(some, behind)])
            sizes = np.array([len(g) for g in got], np.int64)
            self._remember(some, np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes, behind)

    def _remember(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, behind: list[bool]) -> None:
        """``behind``: which plain pieces stand behind a line break, without which they were encoded."""
        breaks = np.array(behind, bool)
        if breaks.any():
            ids = np.insert(ids, (np.cumsum(sizes) - sizes)[breaks], self.line_break[0])
            sizes = sizes + breaks
        self._add(pieces, ids, sizes)

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, many = len(self.seen), len(ids)
        while n + len(pieces) > len(self.size):
            self.size, self.at, self.hits = np.r_[self.size, self.size], np.r_[self.at, self.at], np.r_[self.hits, self.hits * 0]
        while self.used + many > len(self.flat):
            self.flat = np.r_[self.flat, self.flat]
        self.flat[self.used:self.used + many] = ids
        self.size[n:n + len(pieces)] = sizes
        self.at[n:n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.used += many
        self.seen.update(zip(pieces, range(n, n + len(pieces))))

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is remembered; pieces not remembered are encoded first."""
        coded = pieces.dictionary_encode()
        own = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.seen.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(at < 0)
        if new.size:
            missing = [own[k] for k in new]
            self.learn(missing)
            at[new] = [self.seen[p] for p in missing]
        self.hits[at] += 1
        return at[coded.indices.to_numpy()]

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``, and how many each has."""
        if len(self.seen) > self.remember:
            self.forget()
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        slow = pc.match_substring_regex(texts, INSIDE)
        fast = texts.filter(pc.invert(slow))
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\0", fast, ""), "\n", " \n"), " ")
        pieces, sizes = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        which = self.places(pieces)
        if len(fast) < len(texts):      # the others, cut in Python, and all in order again
            cut = [["\0" + p for p in CUT.split(t)] for t in texts.filter(slow).to_pylist()]
            which = np.r_[which, self.places(pa.array([p for c in cut for p in c], pa.string()))]
            order = np.argsort(slow.to_numpy(zero_copy_only=False), kind="stable")
            size = np.empty(len(texts), np.int64)
            size[order] = both = np.r_[sizes, [len(c) for c in cut]].astype(np.int64)
            first = np.empty(len(texts), np.int64)
            first[order] = np.cumsum(both) - both
            which, sizes = which[ragged(first, size)], size
        size = self.size[which]
        ids = self.flat[ragged(self.at[which], size)]
        upto = np.cumsum(np.r_[0, size])[np.cumsum(sizes)]
        return np.insert(ids, upto, end), np.diff(upto, prepend=0) + 1


def release() -> None:
    """Give back what Arrow holds of the memory that is free: a worker is kept between tasks, and its pool with it."""
    pa.default_memory_pool().release_unused()


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after the other."""
    total = np.cumsum(size)
    out = np.repeat((first - total + size).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


@lru_cache(maxsize=2)
def encoder(path: str, remember: int = CACHE_PIECES) -> Encoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, remember)


# ---------------------------------------------------------------- rANS

def scaled(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^SCALE, in proportion to the counts."""
    total = 1 << SCALE
    if len(ids) > total:
        raise ValueError(f"{len(ids)} ids do not fit a table of {total}")
    freq = np.maximum(counts * (total - len(ids)) // max(int(counts.sum()), 1) + 1, 1)
    freq[np.argmax(freq)] += total - freq.sum()
    return freq


class Table:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.argsort(ids)
        ids, freq = ids[order], freq[order]
        size = int(ids[-1]) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids], self.start[ids] = freq, np.cumsum(freq) - freq
        self.slot = np.repeat(ids, freq).astype(np.int32)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """(final states, words in the order the decoder reads them)."""
        x, words = np.full(lanes, LOW, np.uint64), []
        freq, start = self.freq[ids], self.start[ids]
        high, down, half = np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
        for k in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, s = freq[k:k + lanes], start[k:k + lanes]
            y = x[:len(f)]
            full = y >= f << high
            if full.any():
                words.append(y[full].astype(np.uint32))
                y[full] >>= half
            q = y // f
            y[:] = (q << down) + (y - q * f) + s
        return x, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        x, lanes, at, out = states.copy(), len(states), 0, np.empty(n, np.int32)
        mask, down, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for k in range(0, n, lanes):
            y = x[:min(lanes, n - k)]
            low = y & mask
            ids = self.slot[low]
            out[k:k + len(y)] = ids
            y[:] = self.freq[ids] * (y >> down) + low - self.start[ids]
            short = np.flatnonzero(y < LOW)
            if short.size:
                y[short] = (y[short] << half) | words[at:at + short.size]
                at += short.size
        if at != len(words) or (x != LOW).any():
            raise ValueError("the block's words do not end where its ids do")
        return out


def pack(part: int, segment: int, first: int, doc_ids: list, lengths: list[int], ids: list[np.ndarray], ends: list[int]) -> dict:
    """The row of a segment; ``ids`` by document, ``ends``: the number of documents up to each block's end."""
    every = np.concatenate(ids)
    counts = np.bincount(every)
    values = np.flatnonzero(counts)
    freqs = scaled(values, counts[values])
    table, blocks = Table(values, freqs), []
    upto = np.cumsum([0, *lengths])
    for i, j in zip([0, *ends], ends):
        own = every[upto[i]:upto[j]]
        states, words = table.encode(own, min(LANES, max(1, len(own) // STEPS)))
        block = {"n_docs": j - i, "n_ids": len(own), "states": states.astype("<u8").tobytes(), "words": words.astype("<u4").tobytes()}
        blocks.append(block | {"crc32": checksum(block, doc_ids[i:j], lengths[i:j])})
    return {"part": part, "segment": segment, "first": first, "n_ids": sum(lengths), "ids": values, "freqs": freqs,
            "doc_ids": doc_ids, "lengths": lengths, "blocks": blocks}


def checksum(block: dict, doc_ids: list, lengths: list) -> int:
    crc = zlib.crc32(repr((block["n_docs"], block["n_ids"], list(doc_ids), list(lengths))).encode())
    return zlib.crc32(block["words"], zlib.crc32(block["states"], crc))


def unpack(row: dict):
    """(doc_ids, lengths, ids) of each block of a segment's row."""
    table, at = Table(np.array(row["ids"], np.int64), np.array(row["freqs"], np.int64)), 0
    for k, block in enumerate(row["blocks"]):
        docs, lengths = row["doc_ids"][at:at + block["n_docs"]], row["lengths"][at:at + block["n_docs"]]
        if checksum(block, docs, lengths) != block["crc32"]:
            raise ValueError(f"checksum of block {row['part']}/{row['segment']}/{k} does not match")
        yield docs, lengths, table.decode(block["n_ids"], np.frombuffer(block["states"], "<u8").astype(np.uint64), np.frombuffer(block["words"], "<u4").astype(np.uint64))
        at += block["n_docs"]


# ---------------------------------------------------------------- jobs

def write_ids(docs: DataFrame, tokenizer: str, folder: str, end: int = 0, doc_id: str = "doc_id", text: str = "text",
              remember: int = CACHE_PIECES, slice_bytes: int = SLICE) -> None:
    """Write the ids of every whole text, each followed by ``end``, in ascending doc_id order.

    ``tokenizer``: a tokenizers file every executor has. Null counts as the empty text (one id: the
    end), rows of one doc_id are ordered by their text, a null doc_id comes first, an empty table
    gives files without rows, other columns are not read. A task holds one segment's ids, the
    remembered pieces and one Arrow batch; ``remember`` pieces and ``slice_bytes`` of text at once trade memory for time, the
    ids are the same."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))

    def encode(batches):
        e, part = encoder(tokenizer, remember), TaskContext.get().partitionId()
        segment, first, inside, open_, ids, doc_ids, lengths, ends = 0, 0, 0, 0, [], [], [], []

        def close():
            return pa.RecordBatch.from_pylist([pack(part, segment, first, doc_ids, lengths, ids, ends)], ARROW)
        for b in batches:
            for piece in slices(b, 1, slice_bytes):
                got, sizes = e.texts(piece.column(1), end)
                for d, n, own in zip(piece.column(0).to_pylist(), sizes.tolist(), np.split(got, np.cumsum(sizes)[:-1])):
                    ids.append(own)
                    doc_ids.append(d)
                    lengths.append(n)
                    inside, open_ = inside + n, open_ + n
                    if open_ >= BLOCK_IDS:
                        ends.append(len(ids))
                        open_ = 0
                        if inside >= SEGMENT_IDS:
                            yield close()
                            segment, first, inside, ids, doc_ids, lengths, ends = segment + 1, first + inside, 0, [], [], [], []
        if ids:
            if open_:
                ends.append(len(ids))
            yield close()
        release()

    # a row is megabytes: Parquet looks at its size row by row (it would after 100), and a reader holds a row group of few of them
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SEGMENT).write.options(**ROW_GROUPS).parquet(folder)


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, decoded block by block;
    with ``keep_ids`` the ids too. ``start`` counts the ids of all documents before it."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # one row for each write task
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def decode(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                at = row["first"]
                for docs, lengths, ids in unpack(row):
                    raw, ends = ids.astype("<u4"), np.cumsum(lengths)
                    starts = ends - lengths
                    out = [pa.array([row["part"]] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(at + starts), pa.array(lengths, pa.int64()),
                           pa.array([zlib.crc32(raw[i:j]) for i, j in zip(starts, ends)], pa.int64())]
                    if keep_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids)))
                    at += len(ids)
                    yield pa.RecordBatch.from_arrays(out, ["part", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)
        release()

    got = segments.mapInArrow(decode, schema).join(F.broadcast(bases), F.col("part") == F.col("of"))
    return got.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0, doc_id: str = "doc_id", text: str = "text",
               remember: int = CACHE_PIECES, slice_bytes: int = SLICE) -> DataFrame:
    """Write the files into the shared checkpoint folder and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"token-ids-{uuid.uuid4().hex}")
    write_ids(docs, tokenizer, folder, end, doc_id, text, remember, slice_bytes)
    return read_ids(spark, folder)
