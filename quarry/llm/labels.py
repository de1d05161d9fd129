"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stage


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bounds: tuple[int, int]) -> tuple[DataFrame, list[int]]:
    """doc_id, text and y of at most ``bounds[y]`` labelled documents of each class, by the hash of their id,
    and how many labelled ids of each class there are.  Ids in the held-out fold are never taken."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")))
    known = stage(known, "known-labels")
    count = dict(known.groupBy("y").count().collect())
    # at most bounds[0] + bounds[1] ids
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bounds[y]) for y in (0, 1)]
    chosen = stage(ids[0].unionByName(ids[1]), "chosen-labels")
    rows = documents(docs).join(F.broadcast(chosen), "doc_id")
    first = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return stage(first, "training-rows"), [count.get(0, 0), count.get(1, 0)]
