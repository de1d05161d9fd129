import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import topk


def brute(rows, k, every=20):
    top = 2 ** 63 - 1
    ok = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in ok:
        if q % every == 0:
            s = sorted(((-max(-top, min(top, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q))[:k]
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def rows(n=300, dim=12, seed=1):
    rng = random.Random(seed)
    out = [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    out += [(n + i, list(out[5][1])) for i in range(40)] + [(900 + i, list(out[20][1])) for i in range(40)]  # ties
    return out + [(2000, None), (2020, [None] * dim), (2040, [float("nan")] * dim), (2060, [float("inf")] + [0.0] * (dim - 1)), (None, [1.0] * dim), (2080, [0.0] * dim)]


def run(spark, data, k=5):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS n", "'x' AS score", "0 AS rank", "1 AS label")
    return topk.top_k(df, F.col("vec_id") % 20 == 0, k)


@pytest.mark.parametrize("block", [2048, 37])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    data = rows()
    got = run(spark, data + data[:30])
    assert {tuple(r) for r in got.collect()} == brute(data, 5)


def test_fewer_rows_than_k_and_empty(spark):
    data = rows()[:4]
    assert {tuple(r) for r in run(spark, data, 20).collect()} == brute(data, 20)
    assert run(spark, [(1, [1.0])], 3).collect() == []
    assert run(spark, data, 3).limit(0).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).collect() == []


def test_sums_beyond_float_precision(spark):
    big = 2.0 ** 24  # products of 2 ** 60
    data = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 1.0 + 1 / 64]), (3, [-big, 0.0])]
    assert {tuple(r) for r in run(spark, data, 3).collect()} == brute(data, 3)


def test_cutoffs_beyond_float_precision(spark):
    data = [(0, [(2 ** 27 + 1) / 64] * 4), (1, [(2 ** 27 + 3) / 64] * 4), (2, [(2 ** 27 + 3) / 64] * 3 + [2.0 ** 21])]
    assert {tuple(r) for r in run(spark, data, 1).collect()} == brute(data, 1)


def test_components_and_scores_beyond_a_long(spark):
    data = [(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e17, 0.0]), (3, [0.0, 5.0]), (4, [2.0, 1.0]), (20, [0.5, 0.25])]
    assert {tuple(r) for r in run(spark, data, 5).collect()} == brute(data, 5)
    assert run(spark, data + [(5, [1e300, 1.0]), (40, [-1e300, 3.0])], 5).count() == 3 * 5


def test_repeated_query_blocks_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 37)
    plans, stage = {}, topk.stage
    monkeypatch.setattr(topk, "stage", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), stage(df, name))[1])
    plans["result"] = run(spark, rows())._jdf.queryExecution().executedPlan().toString()
    for name in ("cutoffs", "result"):
        assert "SortMergeJoin [vb" in plans[name] and "BroadcastHashJoin [vb" not in plans[name]


def test_narrow_numbers_and_exact_small_floats(spark):
    rng = random.Random(4)
    data = [(i, [rng.choice([-2.0, 1.984375, 511.0, 512.0, -512.015625, 0.0]) * rng.choice([1, 2, 64]) for _ in range(6)]) for i in range(120)]
    assert {tuple(r) for r in run(spark, data, 4).collect()} == brute(data, 4)
    for top in (127, -128, 128, -129, 32767, 2 ** 31 - 1, -2 ** 31, 2 ** 31, topk.LARGEST, topk.LOWEST):
        x = topk.np.array([[top, 1], [0, -1]], dtype="int64")
        assert (topk._matrix(topk._narrow(x), 2, 2) == x).all()
