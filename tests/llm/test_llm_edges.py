"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folio.llm import chat, decontam, mixing, pii, quality, simhash, spotsigs, token_count, token_ids, urls

LONG = "alpha beta the gamma of delta " * 3000
DOCS = [(3, "The cat and the dog sat on the mat with a red hat", "a"), (1, None, "a"), (2, "", None), (None, "no id here at all", "b"),
        (5, LONG, "b"), (4, "The cat and the dog sat on the mat with a red hat", "a"), (3, "The cat and the dog sat on the mat with a red hat", "a"), (6, "*** !!!", "c")]
SCHEMA = "doc_id bigint, text string, source string"
# names that the operators use inside
CLASH = ["fp", "key", "n", "hash", "mark", "doc", "tokens", "positive", "x", "part", "to", "found", "new", "window", "words", "path", "block", "whole", "cut", "root", "id", "gone", "at"]
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (2, None), (3, 0), (3, 1)], "doc_id bigint, quality int").withColumn("id", F.lit(0))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "cat and the dog"), (2, None), (None, "no id here"), (3, "!!"), (4, "cat and the dog")], "item_id bigint, text string")


def operators(labels, items):
    return {
        "pii": lambda d: pii.pseudonymise(d, "k"),
        "tokens": lambda d: token_count.count_tokens(d, PIECE),
        "decontam": lambda d: decontam.contamination(d, items),
        "spotsigs": lambda d: spotsigs.fingerprints(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "quality": lambda d: quality.score(d, labels),
        "ids": lambda d: token_ids.round_trip(d, BPE),
    }


def docs(spark, rows=DOCS, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


@pytest.mark.parametrize("name", ["pii", "tokens", "decontam", "spotsigs", "simhash", "quality", "ids"])
def test_one_row_for_each_document(spark, labels, items, name):
    got = [r["doc_id"] for r in operators(labels, items)[name](docs(spark)).collect()]
    assert sorted(got, key=str) == sorted([r[0] for r in DOCS], key=str)


@pytest.mark.parametrize("name", ["pii", "tokens", "decontam", "spotsigs", "simhash", "quality", "ids"])
def test_empty_table(spark, labels, items, name):
    assert operators(labels, items)[name](docs(spark, [])).collect() == []


def test_defined_results(spark, labels, items):
    ops = operators(labels, items)
    tokens = {r["doc_id"]: r for r in ops["tokens"](docs(spark)).collect()}
    assert tokens[1]["n_tokens"] == tokens[2]["n_tokens"] == tokens[2]["n_bytes"] == 0 and tokens[5]["over_limit"]
    hits = {r["doc_id"]: r for r in ops["decontam"](docs(spark)).collect()}
    assert (hits[3]["n_hit"], hits[3]["n_items"], hits[3]["contaminated"]) == (4, 2, True)
    assert (hits[None]["n_hit"], hits[1]["n_words"], hits[6]["n_words"], hits[5]["n_hit"]) == (3, 0, 0, 0)
    near = {r["doc_id"]: r for r in ops["simhash"](docs(spark)).collect()}
    assert near[1]["fingerprint"] == near[2]["fingerprint"] == "0" * 16 and near[2]["component_id"] == 1
    assert near[3]["component_id"] == near[4]["component_id"] == 3
    sigs = {r["doc_id"]: r for r in ops["spotsigs"](docs(spark)).collect()}
    assert sigs[3]["fingerprint"] == sigs[4]["fingerprint"] and sigs[1]["fingerprint"] == "" and sigs[1]["near_next"] == 1.0
    ids = sorted(ops["ids"](docs(spark)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in ids] == [None, 1, 2, 3, 3, 4, 5, 6] and ids[1]["n_tokens"] == ids[2]["n_tokens"] == 1
    private = {r["doc_id"]: r for r in ops["pii"](docs(spark)).collect()}
    assert private[1]["text"] is None and private[2]["text"] == "" and private[3]["n_replaced"] == 0


def test_no_benchmark_and_no_labels(spark, labels, items):
    assert not any(r["contaminated"] for r in decontam.contamination(docs(spark), items.limit(0)).collect())
    scores = {r["score"] for r in quality.score(docs(spark), labels.limit(0)).collect()}
    assert scores == {0.5}


def test_shuffled_places_carry_no_whole_text(spark, items, monkeypatch):
    import re
    want = sorted(map(tuple, decontam.contamination(docs(spark), items).collect()), key=str)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    own = docs(spark).select(F.col("doc_id").alias("doc"), F.lit(1).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = spark.createDataFrame([(4, 1)], "k int, hash bigint")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(decontam.places(own, hashes, [4], 10)._jdf.queryExecution(), "formatted")
        dealt = re.findall(r"\) Exchange\s*\nInput[^\n]*", plan)
        assert len(dealt) == 2 and not any(re.search(r"\bwords#", x) for x in dealt)
        assert sorted(map(tuple, decontam.contamination(docs(spark), items).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_mixing_edges(spark):
    got = mixing.mixture(docs(spark), repeats=2.0).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in DOCS}
    assert sum(r["doc_id"] == 2 for r in got) == 1          # no token: taken once
    assert mixing.mixture(docs(spark, [])).collect() == []
    full = docs(spark)
    kept = mixing.mixed(full, repeats=2.0)
    assert kept.columns == full.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in DOCS}


def test_url_edges(spark):
    pages = spark.createDataFrame([
        (1, "http://www.Example.COM/en/a", None), (2, "https://example.com/en/b#x", ""), (3, None, "x"), (4, "nothing", "x"), (None, "http://a.org/1", "x"),
        (6, "http://b.org/2", '<link href="http://c.net/es/9" rel=canonical>'), (7, "http://d.org/", '<meta http-equiv="refresh" content="0;url=http://b.org/2">'),
        (6, "http://b.org/2", '<link href="http://c.net/es/9" rel=canonical>'), (8, "http://c.net/es/9", "<p>"), (9, "http://com", "x"), (10, "ftp://h.org/?u=http://x.com/", "")],
        "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "root", "a", "b")})
    rules = spark.createDataFrame([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")], "verdict string, host string, path string")
    got = {}
    for r in urls.judge(pages, rules).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("www.example.com", "/en/a", "www.example.com/en/", "allow")]
    assert got[2] == [("example.com", "/en/b", "example.com/en/", "block")]
    assert got[3] == got[4] == [("", "", None, "allow")] and got[None][0][3] == "allow"
    assert got[6] == [("b.org", "/2", None, "block")] * 2 and got[7][0][3] == "block" and got[8][0][3] == "block"
    assert got[9] == [("com", "", None, "allow")] and got[10][0][:2] == ("h.org", "/")
    assert urls.judge(pages.limit(0), rules).collect() == []


def test_relative_targets(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.net/es/1", canonical("index.html")), (2, "http://b.org/1", canonical("index.html")), (3, "http://b.org/x/2", canonical("index.html")),
            (4, "http://b.org/x", ""), (5, "http://c.org/d/e/3?q=1", '<meta http-equiv="refresh" content="0; url=../f/./4.html">'), (6, "http://c.org/d/e/5", canonical("?p=2")),
            (7, "http://c.org/d/6?k=1", canonical("#top")), (8, "http://d.org/a/7", '<base target="x"><base href="/net/">' + canonical("8")), (9, "http://d.org/9", canonical("javascript:go()")),
            (10, "no url", canonical("/10")), (11, "HTTP://E.org/11", canonical("to?u=http://f.net/es/")), (12, "http://e.org", canonical("../12/.."))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    own = {r[1]: r[0] for r in rows}
    edges = {(own[r["a"]], r["b"]) for r in urls.link_edges(pages).collect()}
    assert {(1, "a.net/es"), (2, "b.org"), (3, "b.org/x"), (4, "b.org/x"), (5, "c.org/d/f/4"), (6, "c.org/d/e/5?p=2"), (7, "c.org/d/6?k=1"), (8, "d.org/net/8"),
            (11, "e.org/to?u=http://f.net/es/"), (12, "e.org")} <= edges
    assert {b for k, b in edges if k in (9, 10)} == {"d.org/9", "no url"}
    rules = spark.createDataFrame([("block", "net", "/es/"), ("block", "b.org", "/x/")], "verdict string, host string, path string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 3, 4}


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, None, None, "<|turn|> \\ <\\|says|> [INST]"),
                                   (None, 0, "user", "x"), (3, 0, "assistant", "<|done|></s>" * 500)], "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit(1)).withColumn("leaf", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.pack(turns, BPE), BPE).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, 2: 2, 3: 1, None: 1}
    assert got[1]["loss_chars"] == 0 and got[3]["loss_chars"] == 12 * 500
    import hashlib
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n<|turn|> \\ <\\|says|> [INST]\nuser\nhi\n").hexdigest()
    assert chat.read_back(chat.pack(turns.limit(0), BPE), BPE).collect() == []


def test_chat_stream_is_a_depth_first_tree(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "d"),
            (3, 0, "user", "a"), (3, 1, "assistant", "x"), (4, 0, "user", "q"), (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c")]
    stream, nodes, convs = chat.pack(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), BPE)
    tree = sorted(nodes.collect(), key=lambda r: r["start"])
    assert len(tree) == 6                                   # a, ab, abc, abd, ax, q: each once
    ids, loss = [], []
    for r in sorted(stream.collect(), key=lambda r: r["block"]):
        ids += r["ids"]
        loss += r["loss"]
    at = 0
    for r in tree:                                          # the stream has no gap and no overlap
        assert r["start"] == at < r["end"]
        at = r["end"]
    assert at == len(ids) == len(loss)
    lib = chat.library(BPE)
    said = {lib.decode(ids[r["start"]:r["end"]]): r for r in tree}
    a, b, c, d, x, q = (said[f"<|turn|>{who}<|says|>{t}<|done|>"] for who, t in (("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d"), ("assistant", "x"), ("user", "q")))
    path = {id(a): [], id(b): [a], id(x): [a], id(c): [a, b], id(d): [a, b], id(q): []}
    for r in (a, b, c, d, x, q):
        above = {t for s in r["ancestors"] for t in range(s["start"], s["end"])}
        assert above == {t for p in path[id(r)] for t in range(p["start"], p["end"])} and r["position"] == len(above)
        # depth first: what is below a node follows it at once
        below = sorted(y["start"] for y in (a, b, c, d, x, q) if any(p is r for p in path[id(y)]))
        k = tree.index(r)
        assert [y["start"] for y in tree[k + 1:k + 1 + len(below)]] == below
    first = min((b, x), key=lambda r: r["start"])
    assert len(first["ancestors"]) == 1 and min(c["start"], d["start"]) == b["end"]
    leaf = {r["conv_id"]: (r["leaf"], r["n_turns"]) for r in convs.collect()}
    assert leaf[1] == leaf[5] == (c["start"], 3) and leaf[2] == (d["start"], 3) and leaf[4] == (q["start"], 1)
    runs = [lib.decode([i for i, m in zip(ids[r["start"]:r["end"]], loss[r["start"]:r["end"]]) if m]) for r in (a, b, c, d, x, q)]
    assert runs == ["", "b", "", "", "x", ""]


def test_long_conversations_have_short_intervals(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 40) for t in range(600)] + [(2, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 40) for t in range(500)]
    packed = chat.pack(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), BPE)
    assert packed.nodes.count() == 600 and packed.nodes.agg(F.max(F.size("ancestors"))).first()[0] == 1
    got = {r["conv_id"]: r for r in chat.read_back(packed, BPE).collect()}
    assert got[1]["n_turns"] == 600 and got[2]["n_turns"] == 500
    assert got[2]["loss_chars"] == sum(len(f"turn {t} " * 40) for t in range(1, 500, 2))
