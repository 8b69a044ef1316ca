"""Intervals of any width, and chat sessions whose turns arrive out of order."""

import pytest

from folio.operators import pages
from folio.streaming.sessions import stream_sessions


@pytest.mark.parametrize("k", [0, 1, 7, 500])
def test_interval_of_any_width(spark, k):
    text = {n: f"<{n}>" for n in range(1, 1203)}
    p = spark.createDataFrame([("long", n, t) for n, t in text.items()] + [("short", 1, "only")], "collection string, page_number int, text string")
    counts = spark.createDataFrame([("long", 1202), ("short", 1)], "collection string, n_pages int")
    asked = [("long", n) for n in (1, 2, 600, 600, 1201, 1202)] + [("short", 1)]
    bad = [("long", 0), ("long", 1203), ("none", 1), (None, 1), ("long", None)]
    got = [tuple(r) for r in pages.page_interval(spark.createDataFrame(asked + bad, "collection string, page_number int"), p, counts, k).collect()]
    want = [(c, n, "ok", None, "".join(text[i] for i in range(max(1, n - k), min(1202, n + k) + 1)) if c == "long" else "only") for c, n in asked]
    want += [(c, n, "rejected", r, None) for (c, n), r in zip(bad, ["page number below 1", "invalid page number", "unknown collection", "unknown collection", "invalid page number"])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_an_interval_is_two_rows_whatever_its_width(spark):
    p = spark.createDataFrame([("c", n, "x") for n in range(1, 50)], "collection string, page_number int, text string")
    counts = spark.createDataFrame([("c", 49)], "collection string, n_pages int")
    req = spark.createDataFrame([("c", 25)], "collection string, page_number int")
    plans = {k: spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(pages.page_interval(req, p, counts, k)._jdf.queryExecution(), "simple") for k in (3, 500)}
    assert all("sequence(" not in x and "Cartesian" not in x and "NestedLoop" not in x for x in plans.values())


def test_sessions_in_order(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", "Hello!" if t == 0 else f"turn {t}") for t in range(7)] + [(2, 0, "user", "good  morning"), (2, 2, "user", "waits for 1"), (3, 1, "assistant", "hi"), (3, 0, "user", None)]
    batches = [[t for t in turns if t[1] in (5, 3, 6)], [t for t in turns if t[1] in (1, 4)] + [(1, 3, "assistant", "turn 3")], [t for t in turns if t[1] in (0, 2)] + [(1, 5, "assistant", "turn 5"), (None, 0, "user", "x")]]
    schema = "conv_id bigint, turn bigint, role string, text string"

    def run():
        stream_sessions(spark, str(tmp_path / "in"), "*.parquet", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect()]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run()
        assert k > 0 or got == []                   # every conversation still waits for its first turn
    sent = sorted(got, key=str)
    assert [r[:4] for r in sent if r[0] == 1] == turns[:7] and [r[1] for r in sent if r[0] == 2] == [0] and [r[:4] for r in sent if r[0] == 3] == [(3, 0, "user", None), (3, 1, "assistant", "hi")]
    greeted = {r[:2]: r[5] for r in sent if r[6]}
    assert set(greeted) == {(1, 0)} and "Hello" in greeted[1, 0] and not any(r[4] for r in sent)
    spark.createDataFrame([(2, 1, "assistant", "now"), (1, 2, "user", "another text of a turn that went out")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = {r[:4] for r in run()} - {r[:4] for r in sent}
    assert late == {(2, 1, "assistant", "now"), (2, 2, "user", "waits for 1")}
