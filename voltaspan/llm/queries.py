"""The registered queries ``opN_<name>``: each operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltaspan.llm import bpe, dialogue_repair, filter_audit, fingerprint, idstore, language_id, line_dedup, ngram_join, packing, secrets, topk, toxicity, wrapper
from voltaspan.llm.common import shared_dir, table
from voltaspan.llm.oracles import ORACLE_SQL


__all__ = ["ORACLE_SQL", "QUERIES"]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    idstore.write(table(spark, sf_dir, "documents"), store, _tokenizer("byte_bpe_50k.json"))
    return idstore.checksums(spark, store)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.query(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_wrapper": op2_wrapper,
    "op3_bpe": op3_bpe,
    "op4_token_store": op4_token_store,
    "op5_topk": op5_topk,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_fingerprint": op8_fingerprint,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_dialogue_repair": op11_dialogue_repair,
    "op12_language_id": op12_language_id,
    "op13_filter_audit": op13_filter_audit,
}
