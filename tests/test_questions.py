"""Question JSON parsing (strict), quality flags, counts, instruction data."""

import json

import pytest

from folio.operators import generate, instruct


def _q(**over):
    q = {"id": "x", "topic": "t", "type": "MCQ", "question": "q?", "options": ["a", "b", "c", "d"],
         "correct_answer": "A", "page_number": 7, "explanation": "e"}
    q.update(over)
    return q


def test_parse_questions_strict(spark):
    missing = _q()
    del missing["explanation"]
    docs = [
        ("ok", json.dumps({"questions": [_q(), _q(page_number="7")]})),
        ("missing", json.dumps({"questions": [missing]})),
        ("extra", json.dumps({"questions": [_q(source="s")]})),
        ("badpage", json.dumps({"questions": [_q(page_number="seven")]})),
        ("badjson", "{not json"),
        ("empty", json.dumps({"questions": []})),
    ]
    raw = spark.createDataFrame(docs, "doc string, json string")
    good, bad = generate.parse_questions(raw, keys=("doc",))
    g = sorted((r.doc, r.page_number) for r in good.collect())
    assert g == [("ok", 7), ("ok", 7)]
    reasons = {r.doc: r.reason for r in bad.collect()}
    assert reasons["missing"].startswith("missing field") and reasons["extra"].startswith("unexpected field")
    assert reasons["badpage"] == "page_number is not an integer" and reasons["badjson"] == "invalid JSON"
    assert "empty" not in reasons and "ok" not in reasons


def test_quality_flags_not_dropped(spark):
    from pyspark.sql import functions as F
    from folio.operators.questions import question_quality
    df = spark.createDataFrame([("c", "1", "MCQ", ["a", "b", "c"], "A"), ("c", "2", "MCQ", ["a", "b", "c", "d"], "E"),
                                ("c", "3", "TF", ["a", "b", "c", "d"], "B"), ("c", "4", "MCQ", ["a", "b", "c", "d"], "C")],
                               "collection string, id string, type string, options array<string>, correct_answer string")
    flags = {r.id: r.flagged for r in question_quality(df).collect()}
    assert flags == {"1": True, "2": True, "3": True, "4": False}


def test_open_qa_first_answer_and_quarantine(spark):
    rows = spark.createDataFrame([("1", "T", "ctx", "q", (["a1", "a2"],)), ("2", "T", "ctx", "q", ([],))],
                                 "id string, title string, context string, question string, answers struct<text:array<string>>")
    good, bad = instruct.instruct_open(rows)
    g = good.collect()
    assert len(g) == 1 and g[0].output == "\nquestion: q \n\nanswer: a1\n" and g[0].input == "Title: T\nContext: ctx"
    assert [r.id for r in bad.collect()] == ["2"]


def test_merge_keeps_duplicates_and_rejects_empty(spark):
    a = spark.createDataFrame([("i", "x", "o", "1")], "instruction string, input string, output string, id string")
    assert instruct.merge([a, a]).count() == 2
    with pytest.raises(ValueError):
        instruct.merge([])
