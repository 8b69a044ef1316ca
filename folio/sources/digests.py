"""MD5 of files, with no task that reads more than a range of a large one.

MD5 is sequential, so the ranges of a file are digested one after the other, each in a task of its own; the state (16 bytes)
goes from one to the next by the driver. All large files go on side by side. The ranges are read by Hadoop's
``FixedLengthInputFormat``, which gives bytes as they are and with their offset, of any store that Spark reads.
"""

from __future__ import annotations

import ctypes
import functools
import math
import re
import struct
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file of up to so many bytes is one cell of one task; a larger one is read in ranges of so many (the last may be a tenth longer).
RANGE_BYTES = 128 << 20
_RECORD = 64 << 10
_START = struct.pack("<4I", 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
#: Names of files that Hadoop's readers would unpack or pass over (``_k=1``); those are digested whole.
_WHOLE = re.compile(r"/_[^/]*$|\.(deflate|gz|bz2|lz4|snappy|zst|passthrough)$", re.I)


def python_blocks(state: bytes, data: bytes) -> bytes:
    """MD5's state after further whole blocks of 64 bytes (some MB a second)."""
    mask = 0xFFFFFFFF
    a0, b0, c0, d0 = struct.unpack("<4I", state)
    for at in range(0, len(data), 64):
        x = struct.unpack_from("<16I", data, at)
        a, b, c, d = a0, b0, c0, d0
        for i in range(64):
            if i < 16:
                f, g = (b & c) | (~b & d), i
            elif i < 32:
                f, g = (d & b) | (~d & c), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | (~d & mask)), (7 * i) % 16
            f = (f + a + _SINES[i] + x[g]) & mask
            a, d, c, b = d, c, b, (b + (f << _TURNS[i] | f >> (32 - _TURNS[i]))) & mask
        a0, b0, c0, d0 = (a0 + a) & mask, (b0 + b) & mask, (c0 + c) & mask, (d0 + d) & mask
    return struct.pack("<4I", a0, b0, c0, d0)


@functools.cache
def _library_blocks():
    """:func:`python_blocks` by the libcrypto that Python's own digests use; none where it cannot be reached."""
    try:
        import _hashlib
        update = ctypes.CDLL(_hashlib.__file__).MD5_Update
    except (ImportError, OSError, AttributeError):
        return None
    update.argtypes, update.restype = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t), ctypes.c_int

    def blocks(state: bytes, data: bytes) -> bytes:
        ctx = (ctypes.c_uint32 * 64)(*struct.unpack("<4I", state))      # MD5_CTX: 4 words of state, 2 of length, a block, its fill
        if update(ctx, data, len(data)) != 1:
            raise RuntimeError("MD5_Update failed")
        return struct.pack("<4I", *ctx[:4])

    try:
        right = blocks(_START, b"folio..." * 16) == python_blocks(_START, b"folio..." * 16)
    except RuntimeError:
        right = False
    return blocks if right else None


def blocks(state: bytes, data: bytes) -> bytes:
    return (_library_blocks() or python_blocks)(state, data)


def finish(state: bytes, rest: bytes, length: int) -> str:
    """The digest of ``length`` bytes, of which all but ``rest`` are in the state."""
    return blocks(state, rest + b"\x80" + bytes((55 - length) % 64) + struct.pack("<Q", length * 8 % 2 ** 64)).hex()


def _full_splits(length: int, size: int) -> int:
    """Splits before the last one of a file, as ``FileInputFormat`` cuts it: the last has 0.1 to 1.1 times the size."""
    n = 0
    while (length - n * size) / size > 1.1:
        n += 1
    return n


def _escaped(path: str) -> str:
    return re.sub(r"([\\,])", r"\\\1", re.sub(r"([\\*?\[\]{}])", r"\\\1", path))


def _records(spark: SparkSession, paths: list[str], split: int, record: int):
    """RDD of (offset, bytes), one partition a split, the files in the order given."""
    prefix = "mapreduce.input.fileinputformat."
    return spark.sparkContext.newAPIHadoopRDD(
        "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={prefix + "inputdir": ",".join(map(_escaped, paths)), prefix + "split.minsize": str(split), prefix + "split.maxsize": str(split),
              "fixedlengthinputformat.record.length": str(record)})


def _step(at: dict[int, tuple], last: bool):
    """Partition -> its state with its records, or with the last ones the digest; ``at``: partition -> (state, begin, end)."""
    def run(index, records):
        state, place, end = at[index]
        rest = []
        for offset, data in records:
            if offset != place:
                raise RuntimeError(f"read at {offset}, not {place}")
            place += len(data)
            if last:
                rest.append(bytes(data))
            else:
                state = blocks(state, bytes(data))
        if place != end:
            raise RuntimeError(f"read up to {place}, not {end}")
        yield index, finish(state, b"".join(rest), end) if last else state
    return run


def ranged_md5(spark: SparkSession, lengths: dict[str, int], range_bytes: int) -> dict[str, str]:
    """Path -> MD5 of files given with their lengths; ``range_bytes`` is a power of two, 2**14 at least.

    A reader of fixed records refuses an incomplete one, so a file's last split is cut finer twice, and what
    then remains is read by the byte."""
    sc, paths = spark.sparkContext, list(lengths)
    state, done = dict.fromkeys(paths, _START), dict.fromkeys(paths, 0)
    finest = range_bytes // 256
    for split, record in ((range_bytes, _RECORD), (range_bytes // 16, _RECORD), (finest, _RECORD), (finest, 1)):
        last = record == 1
        records = _records(spark, paths, split, min(split, record))
        full = {p: _full_splits(lengths[p], split) for p in paths}
        first = dict(zip(paths, accumulate((full[p] + 1 for p in paths), initial=0)))
        if records.getNumPartitions() != sum(full.values()) + len(paths):
            raise RuntimeError("files are not cut as expected")
        while todo := [p for p in paths if last or done[p] < full[p] * split]:
            of = {first[p] + done[p] // split: p for p in todo}
            at = {i: (state[p], done[p], lengths[p] if last else done[p] + split) for i, p in of.items()}
            for i, got in sc.runJob(records.mapPartitionsWithIndex(_step(at, last)), lambda rows: rows, list(at)):
                state[of[i]] = got
                done[of[i]] += split
            if last:
                break
    return state


def content_md5(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Rows of :func:`folio.sources.files.scan_files` with ``content_md5`` (lowercase hex) for the content.

    Files of up to ``range_bytes`` (``RANGE_BYTES``) are digested by Spark, larger ones in ranges when this is called."""
    spark, size, length = files.sparkSession, range_bytes or RANGE_BYTES, F.col("length")
    kept = [c for c in files.columns if c != "content"]
    large = {r["path"]: r["length"] for r in files.where(length > size).select("path", "length").collect()}
    ranged = {p: n for p, n in large.items() if not _WHOLE.search(p)}
    by_cell = [*kept, F.md5("content").alias("content_md5")]
    if not ranged:
        return files.select(*by_cell)
    whole = {p: n for p, n in large.items() if p not in ranged}
    cells = functools.reduce(lambda a, n: a | (length == n), sorted(set(whole.values())), length <= size)     # a filter on the length leaves a file unread
    digests = spark.createDataFrame(list(ranged_md5(spark, ranged, size).items()), "path string, content_md5 string")
    return files.where(cells).where((length <= size) | F.col("path").isin(list(whole))).select(*by_cell).unionByName(
        files.where(length > size).select(*kept).join(F.broadcast(digests), "path").select(*kept, "content_md5"))
