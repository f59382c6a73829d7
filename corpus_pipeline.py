"""A corpus pipeline of five operators, each stage written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaspan.llm import line_dedup, ngram_join, packing, secrets, toxicity
from voltaspan.llm.common import table, written

#: What op9 predicts as toxic goes.
REJECT = toxicity.THRESHOLD


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores REJECT or more go; it learns from ``labels``. Null and empty
    texts have a score like others. Without labels of both kinds the network is as drawn."""
    return toxicity.clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")), REJECT)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents of which nothing but white space is left.
    ``n_chars`` follows the text."""
    cut = line_dedup.dedup(docs)
    rest = cut.where("n_removed = 0 or trim(coalesce(text, '')) != ''")
    return rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, at five words and a similarity of 0.8: the one of the
    smallest doc_id. Documents without words are in no group."""
    return ngram_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay. ``n_chars`` follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, mixed from the sources."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram join", without_near_duplicates),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: SQL can't express a trained network, so tests hold the toxicity stage against op9's scores and run the others on made texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each over all that the one before kept.

    Nulls in any column are kept, but for what the packing takes them for: a null text is empty, a
    null source a source of its own. Of repeated rows one is left (near duplicates). Columns beyond
    those of documents go through all stages but the last. An empty table gives no piece.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
