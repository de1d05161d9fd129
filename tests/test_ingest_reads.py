"""The id list of a run is read once, however many parts join it."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.catalog import Catalog
from quarry.plans import ingest_jobs as J
from quarry.streaming.ingest_stream import IngestStream

BODY = '{"%d":{"success":true,"data":{"name":"G%d","developers":["A","B"],"publishers":["A"],"categories":[{"id":1,"description":"x"}]}}}'


def counting(spark, rows: int, kind: T.DataType):
    """(id list, how often its rows were computed)."""
    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x
    udf = F.udf(tick, kind).asNondeterministic()
    return spark.range(1, rows + 1).select(F.col("id").alias("seq"), udf(F.col("id").cast(kind)).alias("appid")), seen


def test_stream_reads_the_list_once_a_run(spark, tmp_path):
    landing = f"{tmp_path}/landing"
    spark.createDataFrame([(i, BODY % (i, i), 0) for i in (1, 2, 99)], "id int, body string, landed bigint").write.parquet(f"{landing}/store")
    spark.createDataFrame([], "id int, body string, landed bigint").write.parquet(f"{landing}/stats")
    spark.createDataFrame([], "id int, page_no int, body string, landed bigint").write.parquet(f"{landing}/pages")
    ids, seen = counting(spark, 3, T.LongType())
    stream = IngestStream(spark, landing, f"{tmp_path}/tables", ids, buckets=2, run_ts="t")
    stream.run()
    assert seen.value == 3
    assert sorted((r.id, r.name, r.store_status) for r in stream.entities().collect()) == [(1, "G1", "ok"), (2, "G2", "ok"), (3, "", "missing")]
    assert sorted((r.name, r.amount_games_published) for r in stream.table("Developer").collect()) == [("A", 2), ("B", 2)]


def test_big_run_reads_the_list_once(spark):
    texts, seen = counting(spark, 3, T.StringType())
    nothing = spark.createDataFrame([], "id int, body string")
    store = spark.createDataFrame([(i, BODY % (i, i)) for i in (1, 2)], "id int, body string")
    run = J.ingest(texts, store, nothing, spark.createDataFrame([], "id int, page_no int, body string"),
                   catalog=Catalog.empty_catalogue(spark), run_ts="t", checkpoint=True)
    assert sorted((r.id, r.name) for r in run.entities.collect()) == [(1, "G1"), (2, "G2"), (3, "")]
    assert sorted((r.gameId, r.developerName) for r in run.catalog.df("GameDeveloper").collect()) == [(1, "A"), (1, "B"), (2, "A"), (2, "B")]
    assert sorted(r.id for r in run.catalog.df("Game").collect()) == [1, 2, 3]
    assert seen.value == 3
