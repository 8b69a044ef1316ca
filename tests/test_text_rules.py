"""Hand-written edge rows for names, extensions, blanks, greetings, requests, prompts."""

from pyspark.sql import functions as F

from folio.functions.prompts import render
from folio.functions.text import collection_name, has_extension, normalize_text, not_blank, py_strip
from folio.functions.vector import confidence


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_collection_names(spark):
    names = ["Project Plan.pdf", "Étude n°2 (v1).PDF", "a-b.pdf", "a b.pdf", "日本²Ⅳ.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(collection_name(F.col("n"))).collect()]
    assert got == ["Project_Plan_pdf", "Étude_n_2__v1__PDF", "a_b_pdf", "a_b_pdf", "日本²Ⅳ_pdf"]


def test_extension_case_insensitive(spark):
    df = spark.createDataFrame([("x.PDF",), ("x.pdf",), ("x.png",), ("pdf",)], "n string")
    assert [r[0] for r in df.select(has_extension("n", ".pdf")).collect()] == [True, True, False, False]


def test_blank_test_matches_python_strip(spark):
    samples = ["", "  ", "\n\t", "a", "\x0b\x1c", "\x85", " 　", "​", " x "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(not_blank("s")).collect()]
    assert got == [bool(s.strip()) for s in samples]
    stripped = [r[0] for r in df.select(py_strip(F.col("s"))).collect()]
    assert stripped == [s.strip() for s in samples]


def test_confidence_formula(spark):
    df = spark.createDataFrame([(0.0,), (0.2765552866630148,), (1.0,), (1.7,)], "d double")
    assert [r[0] for r in df.select(confidence(F.col("d"))).collect()] == [1.0, 0.7234, 0.0, 0.0]


def test_greeting_normalisation(spark):
    from folio.operators.chat import route_greetings
    df = spark.createDataFrame([(1, "Hi"), (2, "HELLO!!"), (3, " good morning "), (4, "hi there")],
                               "id int, question string")
    r = {x["id"]: x["is_greeting"] for x in route_greetings(spark, df).collect()}
    assert r == {1: True, 2: True, 3: True, 4: False}
    assert [x[0] for x in df.select(normalize_text(F.col("question"))).orderBy("id").collect()] == \
        ["hi", "hello", "good morning", "hi there"]


def test_request_validation(spark):
    from folio.operators.chat import validate_requests
    df = spark.createDataFrame([("", "what?"), ("c", "  "), ("c", "ok?")], "collection string, question string")
    errs = [r["error"] for r in validate_requests(df).collect()]
    assert errs == ["Collection name is required.", "Question cannot be empty.", None]


def test_prompt_values_not_expanded(spark):
    df = spark.createDataFrame([("has {x} and {topic} inside", "T")], "context string, topic string")
    out = df.select(render("topic={topic}; ctx={context}", topic=F.col("topic"), context=F.col("context"))).first()[0]
    assert out == "topic=T; ctx=has {x} and {topic} inside"
