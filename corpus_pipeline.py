"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Its
result is written and read again before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import op3_secrets, op5_bpe, op7_decontaminate, op8_minhash, op9_toxicity
from meterline.llm.tables import Run, small_batches, table

#: Stages pass texts to Python in batches of so many bytes: an executor's JVM holds each several times over, outside its heap.
BATCH_BYTES = 2 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    with small_batches(spark, BATCH_BYTES):
        return Run(spark, "toxicity").keep(op9_toxicity.without_toxic(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five words, similarity 0.8."""
    with small_batches(spark, BATCH_BYTES):
        return op8_minhash.deduplicated(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op7_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    with small_batches(spark, BATCH_BYTES):
        return Run(spark, "secrets").keep(op3_secrets.without_secrets(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of the text decoded from them."""
    with small_batches(spark, BATCH_BYTES):
        return op5_bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: A fitted classifier, MinHash and recursive decoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Run(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
