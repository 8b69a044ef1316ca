"""Empty texts among the pieces that are encoded together, and segments that do not gather in a row group."""

import glob

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folio.llm import token_ids

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("first, then", [([], ["hat", " x"]), ([], ["hat", ""]), (["a"], ["a b c", ""]), (["The x"], ["", "The cat and"])])
def test_an_empty_piece_is_no_line(first, then):
    e = token_ids.Encoder(BPE)
    e.texts(pa.array(first, pa.string()), 0)
    got, sizes = e.texts(pa.array(then), 0)
    want = [w.ids + [0] for w in e.library.encode_batch(then, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]


def test_a_row_group_holds_few_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_ids, "SEGMENT_IDS", 1000)
    monkeypatch.setitem(token_ids.ROW_GROUPS, "parquet.block.size", "4096")
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 997}" for k in range(400))) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    token_ids.write_ids(docs, BPE, str(tmp_path / "ids"))
    rows = groups = 0
    for f in glob.glob(f"{tmp_path}/ids/*.parquet"):
        m = pq.ParquetFile(f).metadata
        rows, groups = rows + m.num_rows, groups + m.num_row_groups
    assert rows > 20 and groups * 3 > rows
    assert token_ids.read_ids(spark, str(tmp_path / "ids")).count() == 60
