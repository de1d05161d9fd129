"""The corpus pipeline: documents go through five stages, each written as Parquet and reread by the next.

1. toxicity: documents that the classifier rejects go;
2. n-gram Jaccard join: one document of each group of near copies stays (the smallest id);
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: secrets are masked in the texts, no document goes;
5. packing: the texts' ids in sequences of at most 1024 tokens (its own columns).

Defined cases: rows without an id stay until packing, which leaves them out;
null and empty texts are clean and stay; columns beside those of documents go
through every stage but the last unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from quarry.llm.common import stage, table, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", decontaminated),
    ("secret_scans", mask_secrets),
    ("packing", packed),
]

#: A classifier and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
