"""Generation with an injected model: the journal, topics of long collections, n a topic, exports."""

import json
import os
import re
import uuid

from pyspark.sql import functions as F

from folio import api, sinks
from folio.operators import journal, topic_tree
from folio.operators.pages import collection_pieces, collection_text

CHUNKS = "collection string, page_number int, document string"


def counting(folder, fail=None):
    """Answers a prompt by its length and leaves a file for each prompt of each call."""
    os.makedirs(folder, exist_ok=True)

    def make():
        def fn(prompts):
            for p in prompts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(p)
            if fail and any(fail in p for p in prompts):
                raise RuntimeError("no answer to " + fail)
            return [str(len(p)) for p in prompts]
        return fn
    return make


def calls(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def tables(spark, texts, asks):
    t = spark.createDataFrame(texts, "context_id string, context string").withColumn("context_sha", F.sha2(F.coalesce("context", F.lit("")), 256))
    return t, spark.createDataFrame(asks, "context_id string, prompt_id string, before string, after string")


def test_each_prompt_is_asked_once(spark, tmp_path):
    texts, asks = tables(spark, [(str(i), f"text {i % 7}") for i in range(20)], [(str(i), f"{i}:{t}", f"{t}: ", ".") for i in range(20) for t in "xy"] + [("none", "lost", "a", "b")])
    folder, path = str(tmp_path / "calls"), str(tmp_path / "journal")
    got = {r["prompt_id"]: r for r in journal.ask(texts, asks, counting(folder), path, wave=5, per_task=3).collect()}
    assert len(got) == 41 and got["lost"]["error"] == "not asked" and got["3:x"]["response"] == str(len("x: text 3."))
    assert calls(folder) == sorted(f"{t}: text {i}." for i in range(7) for t in "xy")        # equal prompts once
    more_texts, more = tables(spark, [("a", "text 3"), ("b", "new")], [("a", "old", "x: ", "."), ("b", "new", "x: ", ".")])
    again = {r["prompt_id"]: r["response"] for r in journal.ask(more_texts, more, counting(folder), path).collect()}
    assert again == {"old": got["3:x"]["response"], "new": str(len("x: new."))} and len(calls(folder)) == 15


def test_a_wave_leaves_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "WAVE_TASKS", 3)
    texts, asks = tables(spark, [(str(i), f"text {i}") for i in range(40)], [(str(i), f"{i}:{t}", f"{t}: ", ".") for i in range(40) for t in "xy"])
    folder, path = str(tmp_path / "calls"), str(tmp_path / "journal")
    assert all(r["response"] for r in journal.ask(texts, asks, counting(folder), path, wave=40, per_task=1).collect())
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 2 * 3 and len(calls(folder)) == 80


def test_a_topic_goes_to_the_piece_that_names_it_most(spark):
    pieces = spark.createDataFrame([("c", 0, 0, "Äpfel und Birnen"), ("c", 0, 1, "äpfel ÄPFEL birnen"), ("c", 1, 0, "birnen äpfel äpfel"), ("d", 0, 0, "x")], "collection string, block int, sub int, text string")
    topics = spark.createDataFrame([("c", "Äpfel"), ("c", "birnen"), ("c", "kirschen"), ("d", "x")], "collection string, topic string")
    got = {(r["collection"], r["topic"]): (r["block"], r["sub"]) for r in topic_tree.topic_pieces(topics, pieces).collect()}
    assert got == {("c", "Äpfel"): (0, 1), ("c", "birnen"): (0, 0), ("c", "kirschen"): (0, 0), ("d", "x"): (0, 0)}


def test_good_items_pass_whatever_their_id_and_number(spark):
    from folio.operators.generate import parse_questions
    good = {"topic": "t", "type": "MCQ", "question": "q", "options": ["a"], "correct_answer": "A", "page_number": 1, "explanation": "e"}
    odd = [good, good | {"id": 7}, good | {"id": None}, good | {"id": [1, "x"]}, good | {"options": []}, good | {"page_number": "3"}, good | {"page_number": 2.0},
           good | {"page_number": 2.5}, good | {"page_number": True}, good | {"page_number": None}, good | {"options": None}, good | {"topic": None}, good | {"id: STRING, x": "y"}, [1]]
    raw = spark.createDataFrame([(i, json.dumps({"questions": [q]})) for i, q in enumerate(odd)] + [(100, '{"questions": {"a": 1}}'), (101, '{"questions": null}'), (102, "no"), (103, None)], "n int, json string")
    kept, bad = parse_questions(raw, keys=("n",))
    assert {r["n"]: r["page_number"] for r in kept.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 3, 6: 2}
    number, invalid = "page_number is not an integer", "invalid JSON"
    assert {r["n"]: r["reason"] for r in bad.collect()} == {7: number, 8: number, 9: number, 10: "options is not a list of strings", 11: "topic is not a string",
                                                           12: "unexpected field: id: STRING, x", 13: "not a JSON object", 100: invalid, 101: invalid, 102: invalid, 103: invalid}


def test_only_failed_prompts_are_asked_again(spark, tmp_path):
    texts, asks = tables(spark, [(str(i), f"text {i}") for i in range(12)], [(str(i), str(i), "", "") for i in range(12)])
    folder, path = str(tmp_path / "calls"), str(tmp_path / "journal")
    got = {r["prompt_id"]: r for r in journal.ask(texts, asks, counting(folder, "text 11"), path, batch=4, per_task=4).collect()}
    assert [k for k, r in got.items() if r["error"]] == ["11"] and "no answer to text 11" in got["11"]["error"]
    # the bad prompt costs three calls, those of its first batch two, all others one
    made = calls(folder)
    assert made.count("text 11") == 3 and max(made.count(f"text {i}") for i in range(11)) <= 2 and len(made) <= 12 + 3 + 2
    before = len(made)
    mended = {r["prompt_id"]: r for r in journal.ask(texts, asks, counting(folder), path).collect()}
    assert mended["11"]["error"] is None and len(calls(folder)) == before + 1       # a later run asks for what is missing only


def test_pieces_are_the_whole_text(spark):
    rows = [("a", n, f"page {n} " + "word " * (n % 40)) for n in range(1, 200)] + [("long", 1, "é" * 900), ("long", 2, " ".join(f"w{i}" for i in range(500))), ("one", 7, "x"), ("gap", 3, "three"), ("gap", 400, "four hundred")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    pieces = collection_pieces(chunks, 100).collect()
    assert max(len(p["text"]) for p in pieces) <= 100
    whole = {}
    for p in sorted(pieces, key=lambda p: (p["collection"], p["block"], p["sub"])):
        whole[p["collection"]] = whole[p["collection"]] + p["glue"] + p["text"] if p["collection"] in whole else p["text"]
    assert whole == {r["collection"]: r["text"] for r in collection_text(chunks).collect()}


def model(longest=None):
    def make():
        def fn(prompts):
            out = []
            for p in prompts:
                context = p.split("<<<\n", 1)[1].rsplit("\n>>>", 1)[0]
                assert longest is None or len(context) <= longest
                if p.startswith("Read"):
                    found = sorted(set(re.findall(r"topic\d+", context)))
                    out.append("{" if "broken" in context else json.dumps({"book_title": "T" + found[0] if found else "none", "total_topics": len(found), "main_topics": found}))
                elif p.startswith("The lines"):
                    found = list(dict.fromkeys(re.findall(r"topic\d+", "\n".join(x for x in context.split("\n") if x.startswith("Topics")))))
                    out.append(json.dumps({"book_title": re.search("Title: (.*)", context)[1], "total_topics": len(found), "main_topics": found}))
                else:
                    topic = re.search('topic "(.*?)"', p)[1]
                    out.append(json.dumps({"questions": [{"topic": topic, "type": "MCQ", "question": f"{i}{topic in context}", "options": list("abcd"), "correct_answer": "A", "page_number": 1,
                                                          "explanation": "e"} for i in range(9)]}))
            return out
        return fn
    return make


def test_topics_of_long_collections(spark, tmp_path):
    rows = [("long", n, f"page {n} about topic{n // 60} and more " * 5) for n in range(1, 400)] + [("many", 1, " ".join(f"topic{i:02}" for i in range(14)))]
    rows += [("bad", 1, "broken topic1"), ("part", 1, "broken " + "x " * 450), ("part", 2, "topic5 " * 60), ("none", 1, "nothing here")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    lists, pieces, bad = topic_tree.topic_lists(chunks, model(1000), str(tmp_path / "j"), max_chars=1000, fan=4)
    got = {r["collection"]: r for r in lists.collect()}
    assert pieces.where("collection = 'long'").count() > 16 and got["long"]["main_topics"] == [f"topic{i}" for i in range(7)] and got["long"]["book_title"] == "Ttopic0"
    assert got["part"]["main_topics"] == ["topic5"] and {(r["collection"], r["reason"]) for r in bad.collect()} == {
        ("bad", "invalid JSON"), ("bad", "no topics"), ("part", "invalid JSON")}
    topics, over = topic_tree.topic_rows(lists)
    assert topics.where("collection = 'many'").count() == 10 and over.where("collection = 'many'").count() == 4
    assert [tuple(r) for r in over.where("collection = 'none'").collect()] == [("none", "no topics")]
    at = {r["topic"]: r for r in topic_tree.topic_pieces(topics, pieces).where("collection = 'long'").collect()}
    assert at["topic6"]["block"] == 5 or at["topic6"]["block"] == 6


def test_levels_by_a_model_are_cut_and_exported(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "topic1 and topic2"), ("a", 2, "topic2 again"), ("b", 1, "nothing")], CHUNKS)
    store = chunks.select("collection", F.concat(F.lit("page_"), "page_number").alias("chunk_id"), "page_number", "document").join(
        spark.createDataFrame([], "collection string"), "collection", "left")
    from folio.operators.chunks import to_chunks
    store = to_chunks(chunks.withColumnRenamed("document", "text"))
    q, meta, bad = api.generate_level_1(store, n=5, generator=model(), journal=str(tmp_path / "j"))
    assert {(r["topic"], r["question_pos"]) for r in q.collect()} == {(t, i) for t in ("topic1", "topic2") for i in range(1, 6)}
    assert {r["collection"]: (r["total_questions"], r["book_title"]) for r in meta.collect()} == {"a": (10, "Ttopic1"), "b": (0, "none")}
    reasons = sorted((r["collection"], r["reason"]) for r in bad.collect())
    assert reasons == [("a", "more than 5 questions")] * 8 + [("b", "no topics")]
    for by in (False, True):
        path = str(tmp_path / f"out-{by}")
        sinks.export_questions(q, meta, path, by_collection=by)
        back = {r["collection"]: r for r in spark.read.json(path).collect()}
        assert set(back) == {"a", "b"} and [x["topic"] for x in back["a"]["questions"]] == ["topic1"] * 5 + ["topic2"] * 5
        assert os.path.isdir(os.path.join(path, "collection=a")) == by
    q2, meta2, _ = api.generate_level_2(store, n=5, generator=model(), journal=str(tmp_path / "j"), k=2)
    assert {(r["topic"], r["question_pos"], len(r["source"])) for r in q2.collect()} == {(t, i, 2) for t in ("topic1", "topic2") for i in range(1, 6)}
    sinks.export_questions(q2, meta2, str(tmp_path / "out-2"))
    assert spark.read.json(str(tmp_path / "out-2")).count() == 2


def test_instruction_set_returns_its_rejects(spark):
    rows = spark.createDataFrame([("1", "T", "c", "q", (["a"],)), ("2", "T", "c", "q", None)], "id string, title string, context string, question string, answers struct<text:array<string>>")
    good, bad = api.build_instruction_set(rows, None)
    assert [r["id"] for r in good.collect()] == ["1"] and [tuple(r) for r in bad.collect()] == [("2", "no answer")]
