"""Sinks and small scans: rows → table, sorted ids, entity CSV resume, versions."""
from pyspark.sql import functions as F

from quarry.sources import scan, sinks


def test_rows_to_table(spark):
    df = scan.from_rows(spark, [(1, "a"), (2, None)], "id int, name string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a"), (2, None)]


def test_sorted_unique_ids(spark, cat, tmp_path):
    path = str(tmp_path / "ids")
    sinks.write_sorted_ids(cat.df("lineitem").select(F.col("l_orderkey").alias("appid")), path)
    back = spark.read.option("header", True).csv(path).select(F.col("appid").cast("bigint"))
    got = [r[0] for r in back.collect()]
    assert got == sorted(set(got)) and len(got) == cat.df("lineitem").select("l_orderkey").distinct().count()


def test_entity_csv_resume_appends(spark, tmp_path):
    path = str(tmp_path / "games")
    df = spark.createDataFrame([(1, True, None)], "id int, is_free boolean, name string")
    sinks.write_entity_csv(spark, df, path, ["id", "is_free", "name"])
    sinks.write_entity_csv(spark, df, path, ["id", "is_free", "name"], resume=True)
    rows = spark.read.option("header", True).csv(path).collect()
    assert len(rows) == 2 and all(r["is_free"] == "True" and r["name"] is None for r in rows)
    sinks.write_entity_csv(spark, df, path, ["id", "is_free", "name"], resume=False)
    assert spark.read.option("header", True).csv(path).count() == 1


def test_versions_switch_at_publish(spark, cat, tmp_path):
    root = str(tmp_path / "tables")
    sinks.publish(spark, root, {"part": cat.df("part"), "supplier": cat.df("supplier")})
    first = sinks.current_versions(spark, root)
    sinks.publish(spark, root, {"part": cat.df("part").limit(3)})
    second = sinks.current_versions(spark, root)
    assert second["supplier"] == first["supplier"] and second["part"] != first["part"]
    assert sinks.read_table(spark, root, "part").count() == 3


def test_existing_keys_from_missing_csv_is_empty(spark, tmp_path):
    assert scan.existing_keys_from_csv(spark, str(tmp_path / "nope")).count() == 0


def test_id_pages_stop_rules_and_bad_pages(spark):
    import json
    from quarry.operators import normalize as N
    pages = [(1, json.dumps({"apps": [{"appid": 3}, {"appid": "x"}, {"appid": 1}]})),
             (2, json.dumps({"apps": [{"appid": 5}, {"name": "no id"}]})),
             (3, json.dumps({"apps": [{"appid": 9}]})),
             (4, json.dumps({"apps": "oops"}))]
    df = scan.landing_payloads(spark.createDataFrame(pages, "page_no int, body string"))
    assert sorted(r["appid"] for r in N.id_list_pages(df).collect()) == [1, 3, 5]
    assert [r["page_no"] for r in N.bad_id_pages(df).collect()] == [4]


def test_whole_texts_take_the_round_trip(spark):
    from quarry.plans.registry import QUERIES, load_all
    load_all()
    sf = "/root/testdata/sf0.001"
    got = {r.id: r.name for r in QUERIES["s2_k1_whole_text_round_trip_documents"](spark, sf).where("kind = 'keys'").collect()}
    want = {r.doc_id: f'  "{r.text}\n{r.doc_id * 7},x"\t' for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want and max(map(len, got.values())) > 1000


def test_file_order_takes_several_ordered_parts(spark, monkeypatch, tmp_path):
    from pathlib import Path

    from quarry.plans import q_quality
    monkeypatch.setattr(q_quality, "scratch", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = q_quality.s1_file_order(spark, "/root/testdata/sf0.001").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(tmp_path, "ids", "b").glob("part-*.csv"))) > 1
    ids = [r.appid for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").toDF("appid").collect()]
    assert [r.appid for r in got] == sorted(ids, key=lambda i: (i % 50 != 0, i))[5:205]


def test_lookups_read_one_row_group_of_many(spark, tmp_path):
    """Tables published with their model are clustered by key; scans by key or another unique column skip the rest."""
    from pyspark.sql import functions as F

    from quarry.model import ModelSpec
    from quarry.sources import sinks
    spec = ModelSpec("t", key=("id",), unique=(("code",),))
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("id"), F.md5(F.col("id").cast("string")).alias("code"), F.lit("x" * 20).alias("pad"))
    root = str(tmp_path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(256 * 1024))
    try:
        sinks.publish(spark, root, {"t": df, "plain": df}, models={"t": spec})
    finally:
        hadoop.unset("parquet.block.size")

    def scanned(name, cond):
        found = sinks.read_table(spark, root, name).where(cond)
        assert found.count() == 1
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.head().metrics().apply("numOutputRows").value()

    code = df.where("id = 5").first().code
    assert scanned("t", "id = 5") <= 20_000 and scanned("t", "id = 5") <= scanned("plain", "id = 5")
    assert scanned("t", f"code = '{code}'") <= 60_000
