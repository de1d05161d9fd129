"""Exact id sets as bitmaps, and ids beyond 32 bits."""
from pyspark.sql import functions as F

from quarry.plans import ingest_jobs as J
from quarry.sources import scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_and_others(spark):
    ids = [-70000, -32768, -1, 0, 1, 7, 8, 32768, 32769, 2 ** 31 - 1, 3 * 10 ** 9]
    sets = J.id_bitmaps(spark.createDataFrame([(i,) for i in ids] + [(None,), (7,)], "id long"), "id")
    probes = sorted({i + d for i in ids for d in (-1, 0, 1)})
    df = spark.createDataFrame([(i,) for i in probes] + [(None,)], "id long")
    assert sorted(r.id for r in J.with_ids(df, "id", sets).collect()) == sorted(ids)
    assert {r.id for r in J.with_ids(df, "id", sets, keep=False).collect()} == (set(probes) - set(ids)) | {None}
    assert J.with_ids(df, "id", sets.limit(0)).count() == 0


def test_bodies_are_not_shuffled(spark, tmp_path, monkeypatch):
    spark.range(2000).select("id", F.lit("{}").alias("body")).write.parquet(str(tmp_path / "b"))
    bodies = spark.read.parquet(str(tmp_path / "b"))
    sets = J.id_bitmaps(spark.range(0, 2000, 3), "id")
    kept = J.with_ids(bodies, "id", sets)
    text = plan(kept)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and kept.count() == 667
    monkeypatch.setattr(J, "BROADCAST_BITMAPS", 0)
    assert J.with_ids(bodies, "id", sets).count() == 667


def test_ids_beyond_32_bits(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("appid\n5\n3000000000\nx\n-1\n99999999999999999999\n")
    ids = scan.read_id_list(spark, str(tmp_path / "ids.csv"))
    assert [r.appid for r in ids.orderBy("seq").collect()] == [5, 3000000000, -1]
    nothing = spark.createDataFrame([], "id int, body string")
    texts = spark.createDataFrame([(1, "5"), (2, "3000000000")], "seq int, appid string")
    run = J.ingest(texts, nothing, nothing, spark.createDataFrame([], "id int, page_no int, body string"), run_ts="t")
    assert [r.id for r in run.entities.collect()] == [5]
    assert [r.appid for r in run.oversized.collect()] == [3000000000]
