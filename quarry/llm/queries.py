"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, lexicon, ngram_join, packing, quality_cnn, secret_scan, spelling, token_counts, token_files, topk, toxicity, url_filter
from .common import table, vocabulary


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"), vocabulary())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_url_filters": op6_url_filters,
    "op7_exact_top_k": op7_exact_top_k,
    "op2_secret_scans": op2_secret_scans,
    "op3_token_files": op3_token_files,
    "op5_token_counts": op5_token_counts,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op4_decontamination": op4_decontamination,
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
}

#: The operators dealt after those ten, and further queries of the same operators.
MORE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_collocations": op11_collocations,
    "op12_bpe_lexicon": op12_bpe_lexicon,
    "op13_spelling_variants": op13_spelling_variants,
    "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op1_ngram_jaccard_links": ngram_join.LINKS_SQL,
    "op6_url_filters": url_filter.sql(),
    "op7_exact_top_k": topk.sql(),
    "op11_collocations": collocations.SQL,
    "op13_spelling_variants": spelling.SQL,
}
