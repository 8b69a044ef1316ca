"""Chat formatting over a prefix tree.

A node is a turn behind all the turns before it; conversations that share initial turns share
nodes. Nodes are laid out depth first in one global token stream, each exactly once:

* ``stream`` (block, ids, loss): the tokens in blocks of BLOCK_TOKENS, and which of them are trained on;
* ``nodes``: each node's place [start, end) in the stream, the ``position`` id of its first token (the
  tokens of its ancestors come before it) and ``ancestors``: the intervals of the stream its tokens
  may attend to besides those before them in the node itself. Ancestors that lie one behind the
  other share an interval, so a conversation without branches has one however long it is;
* ``conversations``: each conversation's last node.

A turn reads ``<|turn|>role<|says|>text<|done|>``; control strings inside roles and texts get a
backslash behind their first character, one more if they have some, so that the way back is exact.
The three parts are tokenised each for itself, which puts the loss mask on the text of assistant
turns alone.

Order: conversations are sorted by their turns' chained digests. A node is new where a conversation
leaves the one before it, so one pass over the sorted turns yields the depth-first order. Equal
conversations are one row before the sort, and of the range before, a range needs its last
conversation only: hot first turns and copies cost no more than others.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import written

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
ESCAPE = r"([<\[])(\\*)(\||/s>|s>|/?INST\]|/?SYS>)"
UNESCAPE = re.compile(r"([<\[])\\(\\*)(\||/s>|s>|/?INST\]|/?SYS>)")
LEARNT = "assistant"
DIGEST = 16
BLOCK_TOKENS = 4096


class Packed(NamedTuple):
    stream: DataFrame
    nodes: DataFrame
    conversations: DataFrame


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


@lru_cache(maxsize=2)
def library(path: str):
    import os

    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True      # their strings in a text are ordinary text
    return t


def _in_batches(rows, schema, most=4096):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, (bytes, str, list)))
        if len(held) >= most or size > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def turn_nodes(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, role, text, last) of turns (conv, turn, role, text): ``node`` is the digest of the
    turn and all before it."""
    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("role", pa.string()), ("text", pa.string()), ("last", pa.bool_())])

    def chained(batches):
        here, node, held = None, b"", None
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                fresh = here != (conv,)
                if held:
                    yield held | {"last": fresh}
                here = (conv,)
                depth, node = (0, b"") if fresh else (held["depth"] + 1, node)
                node = hashlib.sha256(node + len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode()).digest()[:DIGEST]
                held = {"conv": conv, "depth": depth, "node": node, "role": role, "text": text}
        if held:
            yield held | {"last": True}
    dealt = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return dealt.mapInArrow(lambda batches: _in_batches(chained(batches), schema), "conv bigint, depth int, node binary, role string, text string, last boolean")


def _ranked(own: DataFrame) -> DataFrame:
    """(rep, rank, part): one conversation of each kind, ``rank`` ascending in the order of the digests,
    ``part`` the range it was sorted in."""
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: F.hex(x["node"])), "")
    kinds = own.groupBy("conv").agg(path.alias("path")).groupBy("path").agg(F.min("conv").alias("rep"))
    kinds = written(kinds, "chat_kinds")
    ranked = kinds.repartitionByRange("path").sortWithinPartitions("path").select("rep", F.monotonically_increasing_id().alias("rank"))
    return written(ranked.withColumn("part", F.shiftright("rank", 33)), "chat_ranks")


def _encode(lib, rows: list[dict]) -> list[dict]:
    """Adds n, ids, loss_from and loss_to to rows with (escaped) role and text."""
    heads, bodies = ([e.ids for e in lib.encode_batch_fast(x, add_special_tokens=False)] for x in ([TURN + r["role"] + SAYS for r in rows], [r.pop("text") for r in rows]))
    tail = lib.encode(DONE, add_special_tokens=False).ids
    for r, h, t in zip(rows, heads, bodies):
        ids = h + t + tail
        r |= {"n": len(ids), "ids": ids, "loss_from": len(h), "loss_to": len(h) + (len(t) if r["role"] == LEARNT else 0)}
    return rows


def _layout(turns: DataFrame, tokenizer: str) -> DataFrame:
    """New nodes of the ranges, in order, with their tokens and ``at``, their place in the range's stream.
    ``turns``: (part, rank, depth, node, role, text, carried)."""
    schema = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("role", pa.string()),
                        ("ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32())])

    def run(batches):
        lib, part, rank, before, now, at, at_part = library(tokenizer), None, None, [], [], 0, None
        for b in batches:
            new = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(b.schema.names, row))
                if row["part"] != part:
                    part, rank, now = row["part"], None, []
                if row["rank"] != rank:
                    rank, before, now = row["rank"], now, []
                now.append(row["node"])
                shared = len(before) >= len(now) and before[len(now) - 1] == row["node"]
                if not shared and not row["carried"]:
                    new.append({k: row[k] for k in ("part", "depth", "node", "role", "text")})
            for k in range(0, len(new), 1024):
                some = _encode(lib, new[k:k + 1024])
                for r in some:
                    if r["part"] != at_part:
                        at_part, at = r["part"], 0
                    r["at"] = at
                    at += r["n"]
                yield from _in_batches(some, schema)
    dealt = turns.repartition("part").sortWithinPartitions("part", "rank", "depth")
    return dealt.mapInArrow(run, "part bigint, at bigint, n bigint, depth int, node binary, role string, ids array<int>, loss_from int, loss_to int")


def _intervals(nodes: DataFrame) -> DataFrame:
    """Adds position and ancestors to (part, start, n, depth, node, role, carried), a range's nodes and,
    carried, the ancestors of its first one."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("ancestors", pa.list_(span)), ("node", pa.binary())])

    def walked(batches):
        part, open_ = None, []      # the path to the node before: (start, end, position, ancestors)
        for b in batches:
            for part_, start, n, depth, node, role, carried in zip(*(c.to_pylist() for c in b.columns)):
                if part_ != part:
                    part, open_ = part_, []
                del open_[depth:]
                position, above = 0, []
                if depth:
                    s, e, p, own = open_[-1]
                    position = p + e - s
                    above = [*own[:-1], {"start": own[-1]["start"], "end": e}] if own and own[-1]["end"] == s else [*own, {"start": s, "end": e}]
                open_.append((start, start + n, position, above))
                if not carried:
                    yield {"start": start, "end": start + n, "position": position, "role": role, "ancestors": above, "node": node}
    dealt = nodes.repartition("part").sortWithinPartitions("part", "start").select("part", "start", "n", "depth", "node", "role", "carried")
    return dealt.mapInArrow(lambda batches: _in_batches(walked(batches), schema),
                            "start bigint, end bigint, position bigint, role string, ancestors array<struct<start:bigint,end:bigint>>, node binary")


def pack(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Packed:
    """The prefix tree of all conversations: stream, nodes (start, end, position, role, ancestors) and
    conversations (conv_id, n_turns, leaf: the start of its last node).

    Turns go by ``turn`` (null first; equal ones by role and text, repeated rows are repeated turns). A
    null role or text counts as empty, rows with a null conv_id are one conversation, an empty table
    gives empty tables, other columns are not read. A task holds one conversation's digests and
    intervals besides a batch."""
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
                        escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    own = written(turn_nodes(rows), "chat_turns")
    ranks = _ranked(own)
    mine = own.join(ranks, F.col("conv").eqNullSafe(F.col("rep"))).select("part", "rank", "depth", "node", "role", "text")
    # a row for each range: as many as the sort had partitions
    ends = sorted(ranks.groupBy("part").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).collect(), key=lambda r: r["part"])
    lasts = spark.createDataFrame([(b["part"], a["high"]) for a, b in zip(ends, ends[1:])], "to_part bigint, rank bigint")
    firsts = spark.createDataFrame([(r["part"], r["low"]) for r in ends], "to_part bigint, rank bigint")
    carried = mine.join(F.broadcast(lasts), "rank").select(F.col("to_part").alias("part"), F.lit(-1).cast("bigint").alias("rank"), "depth", "node", "role", "text", F.lit(True).alias("carried"))
    local = written(_layout(mine.withColumn("carried", F.lit(False)).unionByName(carried), tokenizer), "chat_nodes")
    sums = local.groupBy("part").agg(F.sum("n").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = local.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("at"))
    spans = placed.select("part", "start", "n", "depth", "node", "role")
    first = mine.join(F.broadcast(firsts), "rank").select("to_part", F.col("node").alias("of"))
    above = spans.join(first, (F.col("node") == F.col("of")) & (F.col("part") < F.col("to_part"))).select(
        F.col("to_part").alias("part"), "start", "n", "depth", "node", "role", F.lit(True).alias("carried"))
    nodes = written(_intervals(spans.withColumn("carried", F.lit(False)).unionByName(above)), "chat_spans")
    leaves = own.where("last").select("conv", "node", (F.col("depth") + 1).cast("bigint").alias("n_turns"))
    conversations = leaves.join(nodes.select("node", "start"), "node").select(F.col("conv").alias("conv_id"), "n_turns", F.col("start").alias("leaf"))
    # the stream: each node's tokens cut at the block borders, a block's pieces put together
    loss = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i >= F.col("loss_from")) & (i < F.col("loss_to")))
    cut = placed.select("start", "n", "ids", loss.alias("loss"), F.explode(_blocks(F.col("start"), F.col("start") + F.col("n"))).alias("block"))
    off, size = _part_of("start", F.col("start") + F.col("n"))
    pieces = cut.select("block", F.struct("start", F.slice("ids", off, size).alias("ids"), F.slice("loss", off, size).alias("loss")).alias("piece"))
    blocks = pieces.groupBy("block").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    stream = blocks.select("block", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("p", lambda x: x["loss"])).alias("loss"))
    return Packed(written(stream, "chat_stream"), nodes.drop("node"), conversations)


def _blocks(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BLOCK_TOKENS), F.floor((end - 1) / BLOCK_TOKENS))


def _part_of(start: str, end: Column) -> tuple[Column, Column]:
    """(first place counted from 1, length) of what [start, end) has in its ``block``, from ``start``."""
    low = F.greatest(F.col(start), F.col("block") * BLOCK_TOKENS)
    return (low - F.col(start) + 1).cast("int"), (F.least(end, (F.col("block") + 1) * BLOCK_TOKENS) - low).cast("int")


def read_back(packed: Packed, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation,
    decoded from the stream: the tokens of its last node's ancestor intervals and of the node."""
    stream, nodes, conversations = packed
    leaves = conversations.select("leaf").distinct()
    spans = leaves.join(nodes.select(F.col("start").alias("leaf"), F.concat("ancestors", F.array(F.struct("start", "end"))).alias("spans")), "leaf")
    spans = spans.select("leaf", F.explode("spans").alias("x")).select("leaf", F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    cut = spans.select("leaf", "start", "end", F.explode(_blocks(F.col("start"), F.col("end"))).alias("block"))
    _, size = _part_of("start", F.col("end"))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK_TOKENS)
    place = (low - F.col("block") * BLOCK_TOKENS + 1).cast("int")
    pieces = cut.join(stream, "block").select("leaf", low.alias("low"), F.slice("ids", place, size).alias("ids"), F.slice("loss", place, size).alias("loss"))
    schema = pa.schema([("leaf", pa.int64()), ("turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def decoded(batches):
        lib, here, ids, loss = library(tokenizer), None, [], []
        for b in batches:
            leaves_, more, marks = b.column(0).to_pylist(), b.column(1), b.column(2)
            for k, leaf in enumerate(leaves_):
                if leaf != here:
                    if ids:
                        yield _digest(lib, here, np.concatenate(ids), np.concatenate(loss))
                    here, ids, loss = leaf, [], []
                ids.append(more[k].values.to_numpy())
                loss.append(marks[k].values.to_numpy(zero_copy_only=False))
        if ids:
            yield _digest(lib, here, np.concatenate(ids), np.concatenate(loss))
    digests = pieces.repartition("leaf").sortWithinPartitions("leaf", "low").select("leaf", "ids", "loss").mapInArrow(
        lambda batches: _in_batches(decoded(batches), schema), "leaf bigint, turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return conversations.join(digests, "leaf").select("conv_id", F.col("turns").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digest(lib, leaf: int, ids: np.ndarray, loss: np.ndarray) -> dict:
    text = lib.decode(ids.tolist(), skip_special_tokens=False)
    turns, said, learnt = text.split(TURN)[1:], hashlib.sha256(), hashlib.sha256()
    for t in turns:
        role, body = t.removesuffix(DONE).split(SAYS)
        said.update((unescape(role) + "\n" + unescape(body) + "\n").encode())
    edges = np.flatnonzero(np.diff(np.r_[0, loss.astype(np.int8), 0]))      # the runs of trained tokens
    texts = [unescape(x) for x in lib.decode_batch([ids[i:j].tolist() for i, j in zip(edges[::2], edges[1::2])], skip_special_tokens=False)]
    learnt.update("".join(texts).encode())
    return {"leaf": leaf, "turns": len(turns), "turns_sha256": said.hexdigest(), "loss_chars": sum(map(len, texts)), "loss_sha256": learnt.hexdigest(), "formatted_chars": len(text)}
