"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a sequence of first turns that some conversation starts with. Its key is a polynomial
hash of the turns' SHA-256 values in four prime fields (124 bits together). Such hashes are prefix
sums, so a conversation of any length is hashed in parts: a task scans its own sorted rows, and the
few conversations that reach over several tasks get their parts' offsets added afterwards.

Sums over subtrees come from a centroid decomposition of the parent edges. The number of rows
(conversation, turn) below a node needs no rollup, as it follows from its members' lengths: it
weighs the nodes. Each round takes the deepest node of a component that still has half of the
component's weight below it. What hangs below that centroid is totalled, the total is added to the
nodes on the path from the centroid to the component's top, and the centroid leaves: its children's
subtrees become components, and so does the rest. Weights halve, so a path of a billion turns takes
some thirty rounds and no more. Components of a bounded number of nodes go on with the same steps
inside a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import hot_join, text_of, written

# primes below 2^31, and an element of each field
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525013, 1140671485, 1597334677)
FIT = 1 << 14           # nodes of a component that one task finishes
MOST_LARGE = 100_000    # larger components at a time: a component is large if it has over one in so many of all nodes
RUN = 4096              # turns of a conversation that meet under one join key
BLOB = 4096             # bytes of joined ids in one row
KEY = ["depth", "h1", "h2"]


# ---------------------------------------------------------------- turns and their hashes

def powers(base: int, prime: int, exponent: np.ndarray) -> np.ndarray:
    out, square, e = np.ones(len(exponent), np.int64), base % prime, exponent.astype(np.int64)
    while e.any():
        out = np.where(e & 1, out * square % prime, out)
        square, e = square * square % prime, e >> 1
    return out


def _scan(batches):
    """Rows in order -> their place in the task's part of the conversation (r), hash of that part so
    far (g), and what the row adds to it (e)."""
    part, conv, at, sums = TaskContext.get().partitionId(), None, 0, [0] * 4
    for b in batches:
        if not b.num_rows:
            continue
        own = b.column(0).to_numpy()
        start = np.r_[own[0] != conv, own[1:] != own[:-1]]
        first = np.maximum.accumulate(np.where(start, np.arange(len(own)), -1))
        r = np.arange(len(own)) - np.where(first < 0, -at, first)
        g, e = [], []
        for k, p in enumerate(PRIMES):
            term = b.column(2 + k).to_numpy() % p * powers(BASES[k], p, r) % p
            total = np.cumsum(term)         # of up to some ten thousand numbers below 2^31
            before = np.where(first < 0, -sums[k], total[first] - term[first])
            e.append(term)
            g.append((total - before) % p)
        conv, at, sums = own[-1], int(r[-1]) + 1, [int(x[-1]) for x in g]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), b.column(0), pa.array(r), b.column(1), *map(pa.array, g), *map(pa.array, e)],
                                         ["part", "conv", "r", "bytes", *[f"g{k}" for k in range(4)], *[f"e{k}" for k in range(4)]])


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv, r, bytes, g0-3, e0-3): every turn with its place and its conversation's hash up to it."""
    spark = turns.sparkSession
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.withColumn("digest", digest).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))     # equal rows, in any order, go to several tasks
    order = ["conv", "turn", "role", "text", "salt"]
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.octet_length("text").cast("bigint").alias("bytes"),
        *[F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"t{k}") for k in range(4)])
    longs = ", ".join(f"{x}{k} bigint" for x in "ge" for k in range(4))
    scanned = written(ready.mapInArrow(_scan, f"part bigint, conv bigint, r bigint, bytes bigint, {longs}"), "trie_turns")
    # only a task's first and last conversation can reach over several tasks: two rows a task at most
    runs = scanned.groupBy("conv", "part").agg(F.max("r").alias("r"), *[F.max_by(f"g{k}", "r").alias(f"g{k}") for k in range(4)])
    several = runs.groupBy("conv").agg(F.collect_list(F.struct("part", "r", "g0", "g1", "g2", "g3")).alias("runs")).where(F.size("runs") > 1).collect()
    fixes = []
    for row in several:
        off, sums = 0, [0] * 4
        for x in sorted(row["runs"]):
            scale = [pow(b, off, p) for b, p in zip(BASES, PRIMES)]
            fixes.append((row["conv"], x["part"], off, *sums, *scale))
            sums = [(s + f * x[f"g{k}"]) % p for k, (s, f, p) in enumerate(zip(sums, scale, PRIMES))]
            off += x["r"] + 1
    names = ["conv", "part", "off", *[f"c{k}" for k in range(4)], *[f"b{k}" for k in range(4)]]
    fix = spark.createDataFrame(fixes, ", ".join(f"{n} bigint" for n in names))
    by = [F.coalesce(f"b{k}", F.lit(1)) for k in range(4)]
    return scanned.join(F.broadcast(fix), ["conv", "part"], "left").select(
        "conv", (F.col("r") + F.coalesce("off", F.lit(0))).alias("r"), "bytes",
        *[((F.coalesce(f"c{k}", F.lit(0)) + by[k] * F.col(f"g{k}")) % p).alias(f"g{k}") for k, p in enumerate(PRIMES)],
        *[(by[k] * F.col(f"e{k}") % p).alias(f"e{k}") for k, p in enumerate(PRIMES)])


def _keys(h: list, e: list) -> list:
    """The key of a node of hashes ``h`` and that of its parent, from what the last turn added."""
    up = [(x - y + p) % p for x, y, p in zip(h, e, PRIMES)]
    pair = lambda a, b, name: (a * F.lit(1 << 31) + b).alias(name)
    return [pair(h[0], h[1], "h1"), pair(h[2], h[3], "h2"), pair(up[0], up[1], "p1"), pair(up[2], up[3], "p2")]


def paths(turns: DataFrame, shared: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, len), and (conv, len, depth, h1, h2, p1, p2, bytes) for each of
    their turns. Conversation c starts with the first h turns of conversation c - c % ``shared`` and
    goes on with its own behind its first h; h is the crc32 of its number modulo ``most``."""
    own = written(_ordered(turns), "trie_ordered")
    head = own.where(F.col("r") < most - 1).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "r", "bytes", F.array(*[f"g{k}" for k in range(4)]).alias("g"), F.array(*[f"e{k}" for k in range(4)]).alias("e")))).alias("head"))
    convs = written(own.groupBy("conv").agg((F.max("r") + 1).alias("n")).join(head, "conv"), "trie_convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"), F.col("head").alias("base_head"))
    c = convs.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(shared))).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    c = c.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = c.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    zeros = F.array(*[F.lit(0).cast("bigint")] * 4)
    c = c.withColumn("hb", F.when(F.col("k") > 0, F.get("base_head", F.col("k").cast("int") - 1)["g"]).otherwise(zeros))
    c = c.withColumn("gh", F.when((F.col("h") > 0) & (F.col("n") > F.col("h")), F.get("head", F.col("h").cast("int") - 1)["g"]).otherwise(zeros))
    back = [F.array(*[F.lit(pow(b, -j, p)) for j in range(most)]) for b, p in zip(BASES, PRIMES)]
    c = written(c.select("conv", "n", "h", "k", "len", "hb", "gh", "base_head", F.array(*[F.get(x, (F.col("h") - F.col("k")).cast("int")) for x in back]).alias("back")), "trie_rebuilt")

    lead = c.where("k > 0").select("conv", "len", F.posexplode(F.slice("base_head", F.lit(1), F.col("k").cast("int"))).alias("pos", "x"))
    lead = lead.select("conv", "len", (F.col("pos") + 1).cast("bigint").alias("depth"), *_keys([F.col("x")["g"][k] for k in range(4)], [F.col("x")["e"][k] for k in range(4)]),
                       F.col("x")["bytes"].alias("bytes"))
    of = c.where("n > h").select("conv", "h", "k", "len", "hb", "gh", "back", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div " + str(RUN)))).alias("run"))
    rest = own.withColumn("run", F.expr(f"r div {RUN}")).join(of, ["conv", "run"]).where("r >= h")
    h = [(F.col("hb")[k] + (F.col(f"g{k}") - F.col("gh")[k] + p) % p * F.col("back")[k]) % p for k, p in enumerate(PRIMES)]
    e = [F.col(f"e{k}") * F.col("back")[k] % p for k, p in enumerate(PRIMES)]
    rest = rest.select("conv", "len", (F.col("r") - F.col("h") + F.col("k") + 1).alias("depth"), *_keys(h, e), "bytes")
    return c.select("conv", "len"), written(lead.unionByName(rest), "trie_paths")


# ---------------------------------------------------------------- rollup

def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a column each) over the subtrees of a forest, by recursive centroids.

    ``parent``: a node's parent's place, or -1; ``weight``: a positive weight summed over the node's
    subtree. All components of a round are split at once; the way to the top is taken in doubled
    steps, so a round costs the logarithm of the depth."""
    n = len(parent)
    own, sums, w = np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)]), np.zeros_like(values), weight.copy()
    up = np.r_[np.where(parent < 0, n, parent), n]
    top = np.r_[np.where(parent < 0, np.arange(n), parent), n]
    while (top != top[top]).any():
        top = top[top]
    left = np.arange(n)
    while left.size:
        most = np.zeros(n + 1, w.dtype)
        np.maximum.at(most, top[left], w[left])
        heavy = left[2 * w[left] >= most[top[left]]]
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        centre = heavy[np.r_[top[heavy][1:] != top[heavy][:-1], True]]
        of = np.full(n + 1, n)
        of[top[centre]] = centre                      # a component's centroid
        is_centre = np.zeros(n + 1, bool)
        is_centre[centre] = True
        below = np.where(is_centre[up], np.arange(n + 1), n)    # the centroid's child above or at the node
        path, whose, jump = centre, centre, up
        while (jump[left] < n).any():
            path, whose = np.r_[path, jump[path]], np.r_[whose, whose]
            path, whose = path[path < n], whose[path < n]
            below = np.where(below < n, below, below[jump])
            jump = jump[jump]
        inside = left[below[left] < n]
        total = own.copy()
        np.add.at(total, of[top[inside]], own[inside])
        sums[path] += total[whose]
        above = path != whose
        w[path[above]] -= w[whose[above]]
        top[inside] = below[inside]
        up[inside[below[inside] == inside]] = n
        left = left[~is_centre[left]]
    return sums


def _finish(batches):
    """Components, each in one piece, -> (depth, h1, h2, n_leaves, saved) of their nodes."""
    names = ["depth", "h1", "h2", "n_leaves", "saved_tokens"]

    def rolled(cols):
        c1, c2, depth, h1, h2, p1, p2, w, leaf, saved, s_leaf, s_saved = cols
        place = {x: k for k, x in enumerate(zip(depth.tolist(), h1.tolist(), h2.tolist(), c1.tolist(), c2.tolist()))}
        parent = np.array([place.get(x, -1) for x in zip((depth - 1).tolist(), p1.tolist(), p2.tolist(), c1.tolist(), c2.tolist())], np.int64)
        sums = decompose(parent, depth, w, np.stack([leaf, saved], 1)) + np.stack([s_leaf, s_saved], 1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (depth, h1, h2, sums[:, 0], sums[:, 1])], names)

    held = None
    for b in batches:
        cols = [x.to_numpy() for x in b.columns]
        held = cols if held is None else [np.r_[x, y] for x, y in zip(held, cols)]
        if len(held[0]) < FIT:
            continue
        change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if change.size:     # the last component may go on in the next batch
            cut = change[-1] + 1
            yield rolled([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield rolled(held)


def rollup(nodes: DataFrame, path_rows: DataFrame, fit: int = FIT) -> DataFrame:
    """(depth, h1, h2, n_leaves, saved_tokens): the sums of ``leaf`` and ``saved`` over each node's subtree."""
    large = f"n > greatest({fit}, {nodes.count()} div {MOST_LARGE})"      # so there are MOST_LARGE at most, and they may be broadcast
    state = nodes.select(*[F.col("top").alias(c) for c in ("c1", "c2")], *KEY, "p1", "p2", "conv", "w", "leaf", "saved", *[F.col("top").alias(c) for c in ("s_leaf", "s_saved")])
    done = []
    while True:
        sizes = written(state.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("w").alias("most")).where(large), "trie_large")
        if sizes.isEmpty():
            break
        heavy = state.join(F.broadcast(sizes), ["c1", "c2"]).where("2 * w >= most")
        centre = F.max(F.struct(F.col("depth").alias("zd"), F.col("h1").alias("z1"), F.col("h2").alias("z2"), F.col("conv").alias("zc"), F.col("w").alias("zw"))).alias("z")
        centres = written(heavy.groupBy("c1", "c2").agg(centre).select("c1", "c2", "z.*"), "trie_centres")
        marked = state.join(F.broadcast(centres), ["c1", "c2"], "left").withColumn("run", F.expr(f"depth div {RUN}"))
        # below the centroid: a member's turn behind the centroid's depth has it as its parent
        asked = marked.where("depth > zd").select("c1", "c2", "conv", "run", "zd", "z1", "z2").distinct()
        turn = path_rows.select(F.col("conv").alias("of"), F.col("depth").alias("at"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), "p1", "p2").join(
            F.broadcast(centres.select((F.col("zd") + 1).alias("at")).distinct()), "at", "left_semi")
        below = asked.join(turn, (F.col("conv") == F.col("of")) & (F.col("zd") + 1 == F.col("at"))).where("p1 = z1 AND p2 = z2").select("c1", "c2", "conv", "run", "b1", "b2")
        # above it: on the path of one of its members
        way = path_rows.select(*KEY, F.col("conv").alias("zc"), F.lit(True).alias("way")).join(F.broadcast(centres.select("zc").distinct()), "zc", "left_semi")
        moved = marked.join(below, ["c1", "c2", "conv", "run"], "left").join(way, [*KEY, "zc"], "left").select(
            *state.columns, "b1", "b2", "zw", F.expr("coalesce(depth = zd AND h1 = z1 AND h2 = z2, false)").alias("is_centre"),
            F.expr("coalesce(depth > zd AND b1 IS NOT NULL, false)").alias("is_below"), F.expr("coalesce(depth < zd AND (way OR depth = 0), false)").alias("is_above"))
        moved = written(moved, "trie_moved")
        total = moved.where("is_centre OR is_below").groupBy("c1", "c2").agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
        new = moved.join(F.broadcast(written(total, "trie_totals")), ["c1", "c2"], "left").withColumns({
            "s_leaf": F.expr("s_leaf + IF(is_centre OR is_above, t_leaf, 0)"), "s_saved": F.expr("s_saved + IF(is_centre OR is_above, t_saved, 0)"),
            "w": F.expr("w - IF(is_above, zw, 0)"), "c1": F.expr("IF(is_below, b1, c1)"), "c2": F.expr("IF(is_below, b2, c2)")})
        done.append(new.where("is_centre").select(*KEY, F.col("s_leaf").alias("n_leaves"), F.col("s_saved").alias("saved_tokens")))
        state = new.where("NOT is_centre").select(*state.columns)
    out = state.drop("conv").repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(
        _finish, "depth bigint, h1 bigint, h2 bigint, n_leaves bigint, saved_tokens bigint")
    for d in done:
        out = out.unionByName(d)
    return out


# ---------------------------------------------------------------- conversations that end at a node

def _blobs(batches):
    """Ordered (depth, h1, h2, conv) -> the numbers of a node's conversations joined in pieces."""
    names, key, held = ["depth", "h1", "h2", "first", "ids"], None, []
    for b in batches:
        out = []
        for *k, conv in zip(*[c.to_pylist() for c in b.columns]):
            if k != key or sum(map(len, held)) + len(held) > BLOB:
                if held:
                    out.append((*key, first, ",".join(held)))
                key, first, held = k, conv, []
            held.append(str(conv))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip((*key, first, ",".join(held)))], names)


def _digests(batches):
    names, key, sha = [*KEY, "ends_sha256"], None, None
    for b in batches:
        out = []
        for *k, _, ids in zip(*[c.to_pylist() for c in b.columns]):
            if k != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip((*key, sha.hexdigest()))], names)


def ends(convs: DataFrame, path_rows: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of the nodes at which conversations end. A digest must see its
    numbers one after the other; the task that makes it gets some thousand of them a row and keeps none."""
    zero = F.lit(0).cast("bigint")
    last = path_rows.where("depth = len").select(*KEY, "conv").union(convs.where("len = 0").select(zero, zero, zero, "conv"))
    order = [*KEY, "conv"]
    blobs = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blobs, "depth bigint, h1 bigint, h2 bigint, first bigint, ids string")
    return blobs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth bigint, h1 bigint, h2 bigint, ends_sha256 string")


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fit: int = FIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each
    node of the rebuilt conversations (:func:`paths`); (conv_id, depth) names a node.

    Null role or text counts as empty, a null turn comes first, turns of one number are ordered by role
    and text, and repeated rows are turns each. Rows without a conv_id belong to no conversation and
    are left out; an empty table gives no node; other columns are not read. No task holds a whole
    conversation, and none more than a component of ``fit`` nodes (or 1 in 100,000 of all) and an Arrow batch."""
    turns = conversations.select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), text_of(role).alias("role"),
                                 text_of(text).alias("text")).where("conv IS NOT NULL")
    convs, rows = paths(turns)
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.sum("len").alias("turns")).where("n_convs > 0").select(
        *[zero.alias(k) for k in KEY], "n_convs", "conv", "turns", F.lit(-1).cast("bigint").alias("p1"), F.lit(-1).cast("bigint").alias("p2"), zero.alias("bytes"))
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.sum("len").alias("turns"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                   F.min("bytes").alias("bytes"))
    bare = written(found.unionByName(root), "trie_bare")
    kids = bare.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    nodes = written(bare.join(kids, KEY, "left").select(
        *KEY, "p1", "p2", "conv", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("n_children").isNull().cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("turns") - F.col("n_convs") * (F.col("depth") - 1)).alias("w"),
        zero.alias("top")), "trie_nodes")       # the component of the root, for a start
    sums = written(rollup(nodes, rows, fit), "trie_sums")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("parent_conv_id"), "n_children").where("n_children > 0")
    total = nodes.count()
    named = hot_join(nodes.where("depth > 0").drop("n_children", "leaf", "saved", "w", "top"), parents.withColumnRenamed("n_children", "matches"), ["depth", "p1", "p2"], total)
    parent = written(named.select(*KEY, "parent_conv_id"), "trie_parents")
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums.withColumnRenamed("saved_tokens", "saved_below"), KEY).join(parent, KEY, "left").join(ends(convs, rows), KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_below").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
