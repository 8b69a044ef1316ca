"""The queries of this subpackage, each over the whole tables it is about."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folio.llm import align, chat, decontam, graph_ann, mixing, pii, quality, simhash, spotsigs, token_count, token_ids, trie, urls
from folio.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark, sf):
    return pii.pseudonymise(table(spark, sf, "documents", "doc_id", "text"), key="corpus-2024")


@query
def op2_token_counts(spark, sf):
    return token_count.count_tokens(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@query
def op3_decontamination(spark, sf):
    return decontam.contamination(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"), width=10, shingle=5)


@query
def op4_spotsigs(spark, sf):
    return spotsigs.fingerprints(table(spark, sf, "documents", "doc_id", "text"))


@query
def op5_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents", "doc_id", "text"), shingle=4, radius=4)


@query
def op6_chat(spark, sf):
    """All conversations and one more (-1) whose texts are control strings."""
    more = [(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    turns = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").union(
        spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string"))
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.pack(turns, tokenizer), tokenizer)


@query
def op7_mixing(spark, sf):
    """Every document at least once, no source over twice as often as the least repeated one."""
    return mixing.mixture(table(spark, sf, "documents", "doc_id", "source", "text"), repeats=2.0)


@query
def op8_url_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urls.judge(table(spark, sf, "pages", "page_id", "url", "html"), rules)


@query
def op9_quality(spark, sf):
    return quality.score(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "quality"))


@query
def op10_token_ids(spark, sf):
    return token_ids.round_trip(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), remember=1_000_000, slice_bytes=6 << 20)


@query
def op11_trie(spark, sf):
    return trie.trie(table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))


@query
def op12_alignment(spark, sf):
    return align.align(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_graph_ann(spark, sf):
    return graph_ann.nearest(table(spark, sf, "embeddings", "vec_id", "embedding"))
