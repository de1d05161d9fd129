"""Wide text columns: the same model as the indexer's, from a dictionary table."""
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import ml


def rows(spark):
    return spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 9).alias("a"), F.when(F.col("id") % 7 != 0, (F.col("id") % 40).cast("string")).alias("b"),
                                   (F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 9 < 4, "yes").otherwise("no").alias("y"))


def test_dictionary_model_predicts_as_the_indexer_does(spark, tmp_path, monkeypatch):
    df = rows(spark)
    narrow = ml.train(df, "y")
    monkeypatch.setattr(ml, "MAX_CATEGORIES", 20)
    mixed = ml.train(df, "y")
    monkeypatch.setattr(ml, "MAX_CATEGORIES", 0)
    wide = ml.train(df, "y")
    assert list(mixed.model.dictionary.sizes) == ["b"] and list(wide.model.dictionary.sizes) == ["a", "b"]
    unseen = df.withColumn("a", F.lit("never")).unionByName(df).withColumn("n", F.monotonically_increasing_id())
    want = [r.prediction for r in ml.predict(narrow.model, unseen).orderBy("n").collect()]
    for res in (mixed, wide):
        assert res.metrics.first() == narrow.metrics.first()
        ml.save_model(res.model, str(tmp_path / "m"))
        for model in (res.model, ml.load_model(str(tmp_path / "m"))):
            assert [r.prediction for r in ml.predict(model, unseen).orderBy("n").collect()] == want


def test_unseen_and_null_are_zero_vectors(spark):
    df = rows(spark)
    words = ml.Dictionary.build(df, ["a", "b"])
    assert words.sizes == {"a": 9, "b": 40}
    encoder = ml.build_pipeline(["a", "b"], [], "y", 1, wide=["a", "b"]).getStages()[0]
    fitted = encoder.fit(words.transform(df))
    probe = spark.createDataFrame([("c3", "7"), ("zz", None)], "a string, b string")
    hot = [(sum(r.a), sum(r.b), len(r.a), len(r.b)) for r in fitted.transform(words.transform(probe)).select(vector_to_array("a__ohe").alias("a"), vector_to_array("b__ohe").alias("b"), F.col("a").alias("k")).orderBy("k").collect()]
    assert hot == [(1.0, 1.0, 9, 40), (0.0, 0.0, 9, 40)]
    values = words.table.groupBy("column").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert {r["column"]: r["s"] for r in values} == {"a": list(range(9)), "b": list(range(40))}
