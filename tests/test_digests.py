"""MD5 of files: no cell holds a large file, and its ranges give the digest of the whole."""

import hashlib
import random

import pytest

from folio.plans.queries import QUERIES
from folio.sources import digests
from folio.sources.files import scan_files

SIZE = 1 << 14


def _put(folder, lengths, end=".parquet"):
    made = random.Random(5)
    for k, n in enumerate(lengths):
        (folder / f"f{k} {n}{end}").write_bytes(made.randbytes(n) if k % 3 else b"\xef\xbb\xbf" + bytes(n)[3:] if n > 3 else bytes(n))
    return {f.name: (f.stat().st_size, hashlib.md5(f.read_bytes()).hexdigest()) for f in folder.iterdir()}


@pytest.fixture
def short_cells(spark):
    """``binaryFile`` refuses a cell larger than a range."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(SIZE))
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_scan_files_makes_no_cell_of_a_large_file(spark, tmp_path, monkeypatch, short_cells):
    monkeypatch.setattr(digests, "RANGE_BYTES", SIZE, raising=False)
    want = _put(tmp_path, (1, 63, 64, SIZE - 1, SIZE, SIZE + 1, SIZE * 11 // 10, SIZE * 11 // 10 + 1, 2 * SIZE, 3 * SIZE + 55, 3 * SIZE + 56, 5 * SIZE + 63, 5 * SIZE + 64, 7 * SIZE + 13, 104_729))
    got = QUERIES["scan_files"](spark, str(tmp_path)).collect()
    assert {r["name"]: (r["length"], r["content_md5"]) for r in got} == want and len(got) == len(want)
    assert {r["status"] for r in got} == {"ok"}


def test_names_with_signs_of_globs_and_packed_files(spark, tmp_path):
    want = _put(tmp_path, (20, 40_000, 50_001), " [1],{a,b}*?\\x.parquet") | _put(tmp_path, (21, 40_000, 60_001), ".gz")
    (tmp_path / "_k=1.parquet").write_bytes(bytes(70_001))
    want["_k=1.parquet"] = (70_001, hashlib.md5(bytes(70_001)).hexdigest())
    got = digests.content_md5(scan_files(spark, str(tmp_path)), SIZE).collect()
    assert {r["name"]: (r["length"], r["content_md5"]) for r in got} == {f.name: want[f.name] for f in tmp_path.iterdir()} and len(got) == 7


def test_only_large_files_are_left_out_of_the_cells(spark, tmp_path, short_cells):
    want = _put(tmp_path, (3 * SIZE, 4 * SIZE + 1))
    got = digests.content_md5(scan_files(spark, str(tmp_path)), SIZE)
    assert got.columns == ["path", "name", "length", "modificationTime", "status", "content_md5"]
    assert {r["name"]: (r["length"], r["content_md5"]) for r in got.collect()} == want


@pytest.mark.parametrize("step", [digests.python_blocks, digests.blocks])
def test_state_goes_on_after_any_block(step):
    data = random.Random(6).randbytes(64 * 9)
    whole = step(digests._START, data)
    assert all(step(step(digests._START, data[:64 * k]), data[64 * k:]) == whole for k in range(10))
    for n in (0, 1, 55, 56, 63, 64, 119, 120, 500):
        rest = n % 64
        assert digests.finish(step(digests._START, data[:n - rest]), data[n - rest:n], n) == hashlib.md5(data[:n]).hexdigest()


def test_splits_are_bounded():
    for n in (1, 999, 1100, 1101, 2099, 2100, 2101, 123_456):
        full = digests._full_splits(n, 1000)
        assert 0 < n - full * 1000 <= 1100
