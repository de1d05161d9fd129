"""An inverted index for full-text search (W11, L2): built once, read without the texts.

A posting list holds the documents of one token: their numbers, sorted.  Lists
are cut by ranges of ``RANGE`` numbers, so a token that most documents hold is
many short lists, and no task builds or reads it whole.  The lists are stored
as Parquet, range-partitioned and sorted by token: a search's ``token IN (…)``
reads the row groups whose statistics hold its tokens.  Numbers within a list
are offsets from its range's start, which the file format stores as deltas.

New documents are added as a further segment; a search reads all segments.
Tokens are cut exactly as the ``search`` filter cuts texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import search_terms, text_tokens
from . import sinks

RANGE = 1 << 16


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def add(self, docs: DataFrame, key: str, column: str) -> None:
        """Index the texts of ``docs`` (whole-number ``key``, each once over all segments)."""
        tokens = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.explode(F.array_distinct(text_tokens(F.col(column)))).alias("token")).where("token <> ''")
        part = F.floor(F.col("id") / RANGE).cast("long")
        lists = tokens.groupBy("token", part.alias("part")).agg(F.sort_array(F.collect_list((F.col("id") - part * RANGE).cast("int"))).alias("ids"))
        segment = uuid.uuid4().hex
        lists = lists.withColumn("n", F.size("ids")).repartitionByRange("token", "part").sortWithinPartitions("token", "part")
        lists.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#ids.list.element", "false").parquet(f"{self.root}/s={segment}")
        sinks.switch(self.spark, self.root, {f"segment#{segment}": segment}, None)

    def _lists(self, terms: list[str]) -> DataFrame:
        segments = [v for k, v in sorted(sinks.current_versions(self.spark, self.root).items()) if k.startswith("segment#")]
        if not segments:
            raise KeyError(f"nothing indexed under {self.root}")
        lists = self.spark.read.schema("token string, part long, ids array<int>, n int").parquet(*[f"{self.root}/s={s}" for s in segments])
        return lists.where(F.col("token").isin(terms))

    def search(self, query: str) -> DataFrame:
        """``id`` of the documents that hold every term; without a term, all that were indexed with any word."""
        terms = sorted(set(search_terms(query)))
        if not terms:
            raise ValueError("a search needs a term")
        # a range's lists of one token (one a segment) are one list; then all tokens' lists are intersected
        lists = self._lists(terms).groupBy("part", "token").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        both = lists.groupBy("part").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(terms))
        found = F.aggregate(F.slice("lists", 2, len(terms)), F.col("lists")[0], lambda a, x: F.array_intersect(a, x))
        return both.select("part", F.explode(found).alias("place")).select((F.col("part") * RANGE + F.col("place")).alias("id"))

    def scores(self, query: str) -> DataFrame:
        """``id`` and ``score``, the number of the query's distinct terms in the document, where there is one."""
        terms = sorted(set(search_terms(query)))
        places = self._lists(terms).select("part", F.explode("ids").alias("place"))
        return places.groupBy("part", "place").agg(F.count(F.lit(1)).cast("int").alias("score")).select((F.col("part") * RANGE + F.col("place")).alias("id"), "score")
