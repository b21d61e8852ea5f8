"""Registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    alignment, chat, decontaminate, fingerprint, importance, jaccard, multi_index, packing, passages, sharding, spelling, url_trust, warc,
)
from quire.llm.common import table

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def vocabulary() -> str:
    """Place of the byte-level BPE as ranks: the ids of ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces() -> str:
    """Place of the piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def good_document() -> Column:
    return (F.col("quality") == 1) & (F.col("toxic") == 0)


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", mask)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark")))


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "labels"), good_document())[0]


def op7_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), RULES).drop("distrust_share")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_probe(table(spark, sf_dir, "documents"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.captures(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"))


def op12_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), vocabulary(), pieces())


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_chat_rotation, op2_vector_packing, op3_suffix_automaton, op4_line_winnowing, op5_label_propagation,
        op6_importance_resampling, op7_url_trust, op8_jaccard_join, op9_multiset_hash, op10_warc_index,
        op11_multi_index, op12_reduced_alphabet, op13_token_alignment,
    )
}
