"""Exact top-k search by inner product: a three-phase uniform threshold over slices of the vector.

Equal vectors form one class, which keeps its k + 1 smallest ids; classes lie
in blocks of about ``BLOCK`` rows, queries in blocks of ``QUERY_BLOCK``.  For a
pair of blocks the vector is cut into ``SLICES`` slices, each with its own local
score list.  A query block is repeated for every class block, so pairs always
meet by a merge join: a size estimated before the repeats would let the driver
gather them all.  Matrices travel in the narrowest whole numbers that hold them.

1. Every slice gives its k best classes; their whole scores are lower bounds.
2. The k-th best of them over all blocks is the query's safe cutoff t.  It is
   joined to the query's block (never collected), and every slice gives the
   entries of at least t / SLICES: a score of t or more needs one such slice.
3. The scores that remain open are resolved, and those of at least t ranked.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; shorter vectors count as padded with zeros; an empty table gives
no rows; a repeated row (same id and vector) counts once.  Ties go to the
smaller id.  Scores are exact: products run in float32 while every sum is below
2**24, in float64 below 2**53, else in Python's whole numbers.  Scores and components beyond a long
count as the nearest long (of one sign: ``LARGEST``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, stage

BLOCK = 2048
QUERY_BLOCK = 512
SLICES = 4
LARGEST = 2 ** 63 - 1
LOWEST = -LARGEST


def whole(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) for each component."""
    edge = float(2 ** 63)

    def one(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(y >= edge, F.lit(LARGEST)).when(y <= -edge, F.lit(LOWEST)).otherwise(F.floor(y).cast("long"))
    return F.transform(embedding, one)


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _pack(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    out = np.zeros((len(pdf), dim), dtype=np.int64)
    for i, v in enumerate(pdf["vec"]):
        out[i, :len(v)] = v
    return out


def _narrow(x: np.ndarray) -> bytes:
    """The matrix in the narrowest whole numbers that hold its components."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    return x.astype(next(kind for kind in ("i1", "<i2", "<i4", "<i8") if top <= np.iinfo(kind).max)).tobytes()


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // max(rows * dim, 1) or 8}").astype(np.int64).reshape(rows, dim)


def _blocks(df: DataFrame, key: str, dim: int, extra: str) -> DataFrame:
    """One row a block: ids and (for classes) the class sizes as int64 bytes, and the matrix."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        return pd.DataFrame({key: [pdf[key].iloc[0]], f"{extra}_ids": [pdf["id"].to_numpy(np.int64).tobytes()],
                             f"{extra}_n": [pdf["n"].to_numpy(np.int64).tobytes()], f"{extra}_vecs": [_narrow(_pack(pdf, dim))]})
    return df.groupBy(key).applyInPandas(pack, f"{key} long, {extra}_ids binary, {extra}_n binary, {extra}_vecs binary")


def _scores(row, dim: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Query ids, class ids, the slices' score matrices, and which pairs are a query and its own sole class."""
    qid, vid = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.v_ids, np.int64)
    size = np.frombuffer(row.v_n, np.int64)
    q, v = _matrix(row.q_vecs, len(qid), dim), _matrix(row.v_vecs, len(vid), dim)
    top = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(dim, 1)
    kind = np.float32 if top < 2 ** 24 else np.float64 if top < 2 ** 53 else object
    q, v = q.astype(kind), v.astype(kind)
    cuts = np.linspace(0, dim, SLICES + 1).astype(int)
    parts = [q[:, a:b] @ v[:, a:b].T if b > a else np.zeros((len(qid), len(vid)), kind) for a, b in zip(cuts, cuts[1:])]
    own = (qid[:, None] == vid[None, :]) & (size[None, :] == 1)
    return qid, vid, parts, own


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every row that ``is_query`` marks, against all other rows."""
    spark = vectors.sparkSession
    small_batches(spark)  # a row is a pair of blocks
    rows = (vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), whole(F.col(vec_col), scale).alias("vec"), is_query.alias("is_query")).distinct())
    rows = stage(rows, "vectors")
    dim, n_queries = rows.agg(F.max(F.size("vec")), F.sum(F.col("is_query").cast("long"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # the smallest ids of each class of equal vectors: Spark limits each group before the shuffle
    first = Window.partitionBy("vec").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = stage(kept.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("members"))
                    .select("vec", "members", F.col("members")[0].alias("id"), F.size("members").cast("long").alias("n")), "classes")
    n_v, n_q = max(1, -(-classes.count() // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    v = _blocks(classes.select("id", "n", "vec", F.pmod(F.xxhash64("vec"), F.lit(n_v)).alias("vb")), "vb", dim, "v")
    q = _blocks(rows.where("is_query").select("id", F.lit(1).cast("long").alias("n"), "vec", F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("qb")), "qb", dim, "q")
    v, q = stage(v, "class-blocks"), stage(q.drop("q_n"), "query-blocks")

    def pairs(q: DataFrame) -> DataFrame:
        """Every query block meets every class block: queries stated against all rows, block by block."""
        every = q.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long"))))
        return every.hint("merge").join(v.hint("merge"), "vb")

    def phase_1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if len(best) > 20 * QUERY_BLOCK:  # bounded memory; the window below merges what is given twice
                    yield pd.DataFrame({"id": list(best), "scores": list(best.values())})
                    best = {}
                qid, vid, parts, own = _scores(row, dim)
                total = sum(parts[1:], parts[0])
                near = min(k + 1, len(vid))
                seen = np.concatenate([np.argpartition(-p if p.dtype == np.float32 else -p.astype(float), near - 1, axis=1)[:, :near] for p in parts], axis=1)
                for i, x in enumerate(qid.tolist()):
                    j = np.unique(seen[i])
                    got = [max(LOWEST, min(LARGEST, int(s))) for s in total[i, j[~own[i, j]]]]
                    best[x] = sorted(best.get(x, []) + got, reverse=True)[:k]
        yield pd.DataFrame({"id": list(best), "scores": list(best.values())})

    local = pairs(q).mapInPandas(phase_1, "id long, scores array<bigint>").select("id", F.explode("scores").alias("score"))
    ranked = local.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))).where(F.col("r") <= k)
    cutoff = ranked.groupBy("id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(LOWEST)).alias("cut"))
    cuts = (rows.where("is_query").select("id").join(cutoff, "id", "left")
            .select(F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("qb"), "id", F.coalesce("cut", F.lit(LOWEST)).alias("cut"))
            .groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("id", "cut"))).alias("cuts"))
            .select("qb", F.col("cuts.cut").alias("cuts")))
    cuts = stage(cuts, "cutoffs")
    discard(rows)

    def phase_2_3(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                qid, vid, parts, own = _scores(row, dim)
                cut = np.asarray(row.cuts, dtype=np.int64)
                parts = [p if p.dtype == object else p.astype(np.int64) for p in parts]  # whole numbers, so that no comparison rounds
                enough = np.repeat((cut == LOWEST)[:, None], len(vid), axis=1)
                for p in parts:
                    enough |= (p * SLICES >= cut.astype(p.dtype)[:, None]).astype(bool)
                i, j = np.nonzero(enough & ~own)
                score = np.clip(sum((p[i, j] for p in parts[1:]), parts[0][i, j]), LOWEST, LARGEST)
                keep = (score >= cut[i]).astype(bool)
                yield pd.DataFrame({"query_id": qid[i[keep]], "id": vid[j[keep]], "vb": row.vb, "score": score[keep].astype(np.int64)})

    found = pairs(q.join(cuts, "qb")).mapInPandas(phase_2_3, "query_id long, id long, vb long, score long")
    members = classes.select("id", F.pmod(F.xxhash64("vec"), F.lit(n_v)).alias("vb"), "members")
    found = found.join(members, ["id", "vb"]).select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    return f"""WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
