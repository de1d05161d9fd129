"""Checked queries for ML (ML1–ML6, K4–K6) and the incremental ingest (ST1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import Catalog
from ..model import ModelSpec
from ..operators import ml
from ..session import checkpoint_dir
from ..sources import sinks
from .q_ingest import SQL_STATS
from .registry import fixture_catalog, query


def cat_of(spark, sf) -> Catalog:
    return fixture_catalog(spark, sf)


def _training_table(cat):
    """Documents with labels: text features lang, source; numeric n_chars; target quality."""
    return cat.df("documents").select("doc_id", "lang", "source", "n_chars").join(
        cat.df("labels").select("doc_id", "quality"), "doc_id").drop("doc_id")


@query("ml1_ml5_k5_train_evaluate_documents", """
SELECT sum(ceil(0.2 * n))::BIGINT AS n_test, true AS accuracy_in_range FROM (
  SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality)
""")
def ml_train(spark, sf):
    res = ml.train(_training_table(cat_of(spark, sf)), "quality")
    out = f"{checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    sinks.write_json(res.metrics, out)   # K5: {accuracy, n_test}
    return spark.read.json(out).select("n_test", F.col("accuracy").between(0, 1).alias("accuracy_in_range"))


@query("e3_ml3_ml5_k5_separable_target_documents", """
SELECT 1.0::DOUBLE AS accuracy, sum(ceil(0.2 * n))::BIGINT AS n_test FROM (SELECT count(*) AS n FROM documents GROUP BY lang)
""")
def e3_separable(spark, sf):
    """The whole training job on a target that one feature decides: every test row is predicted right."""
    docs = cat_of(spark, sf).df("documents").select("lang", "source", (F.col("n_chars") / 100000).alias("size"),
                                                    F.concat(F.lit("is_"), F.col("lang")).alias("target"))
    res = ml.train(docs, "target")
    out = f"{checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    sinks.write_json(res.metrics, out)
    return spark.read.json(out).select("accuracy", "n_test")


@query("ml1_p9_one_hot_unseen_documents", """
SELECT doc_id, (SELECT count(DISTINCT lang) FROM documents WHERE lang <> 'fr') AS width, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS ones,
  'lang,source' AS text_columns, 'doc_id,n_chars' AS number_columns FROM documents
""")
def ml1_one_hot(spark, sf):
    """Columns are split by type; a category that fitting never saw becomes the zero vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    docs = cat_of(spark, sf).df("documents").select("doc_id", "lang", "source", "n_chars", F.lit("x").alias("target"))
    text, numbers = ml.split_columns(docs, "target")
    stages = ml.build_pipeline(["lang"], [], "target", 1).getStages()[:2]
    out = Pipeline(stages=stages).fit(docs.where("lang <> 'fr'")).transform(docs)
    hot = vector_to_array("lang__ohe")
    return out.select("doc_id", F.size(hot).cast("bigint").alias("width"), F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).cast("int").alias("ones"),
                      F.lit(",".join(text)).alias("text_columns"), F.lit(",".join(numbers)).alias("number_columns"))


@query("ml1_dictionary_slots_lineitem", """
WITH v AS (SELECT DISTINCT unnest([{'c': 'order', 'v': CAST(l_orderkey AS VARCHAR)}, {'c': 'flag', 'v': l_returnflag}]) AS p FROM lineitem WHERE l_partkey % 5 <> 0),
d AS (SELECT p.c AS c, p.v AS v, row_number() OVER (PARTITION BY p.c ORDER BY p.v) - 1 AS slot FROM v),
n AS (SELECT c, count(*) AS n FROM d GROUP BY c)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(o.slot, (SELECT n FROM n WHERE c = 'order'))::BIGINT AS order_slot, coalesce(f.slot, (SELECT n FROM n WHERE c = 'flag'))::BIGINT AS flag_slot
FROM lineitem LEFT JOIN d o ON o.c = 'order' AND o.v = CAST(l_orderkey AS VARCHAR) LEFT JOIN d f ON f.c = 'flag' AND f.v = l_returnflag
""")
def ml1_dictionary(spark, sf):
    """Slots of a column of many values and of one of few, for rows that the dictionary has seen and others."""
    rows = cat_of(spark, sf).df("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("order"), F.col("l_returnflag").alias("flag"))
    words = ml.Dictionary.build(rows.where("l_partkey % 5 <> 0"), ["order", "flag"])
    out = words.transform(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("order__idx").cast("long").alias("order_slot"), F.col("flag__idx").cast("long").alias("flag_slot"))


@query("ml6_k4_k6_batch_predict_documents", """
SELECT doc_id, true AS known_class FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def ml_predict(spark, sf):
    cat = cat_of(spark, sf)
    res = ml.train(_training_table(cat), "quality")
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    ml.save_model(res.model, path)
    model = ml.load_model(path)
    unlabeled = cat.df("documents").join(cat.df("labels"), "doc_id", "left_anti").select(
        "doc_id", "lang", "source", "n_chars")
    pred = ml.predict(model, unlabeled).select("doc_id", "prediction")
    out = f"{checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}"
    sinks.write_json(pred, out)
    classes = cat.df("labels").select(F.col("quality").cast("string").alias("prediction"), F.lit(True).alias("known_class")).distinct()
    return spark.read.json(out).join(classes, "prediction", "left").select("doc_id", F.coalesce("known_class", F.lit(False)).alias("known_class"))


@query("st1_incremental_ingest_events", """
SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def st1_incremental(spark, sf):
    from ..streaming.incremental import read_incremental, run_incremental_upsert
    base = f"{checkpoint_dir(spark)}/st1-{uuid.uuid4().hex}"
    ev = cat_of(spark, sf).df("events").select("user_id", "event_id", "event_type", "ts",
                                               F.col("event_id").alias("seq"))
    half = ev.select(F.max("event_id")).scalar() / 2
    spec = ModelSpec("user_last_event", key=("user_id",))
    # land the events in two drops, the later ones first; the stream runs after each (a resumed run reads only the new files)
    for i, cond in enumerate((F.col("event_id") > half, F.col("event_id") <= half)):
        ev.where(cond).write.mode("overwrite").parquet(f"{base}/landing/drop={i}")
        run_incremental_upsert(spark, f"{base}/landing/drop=*", ev.schema, spec, "seq",
                               f"{base}/tables", f"{base}/checkpoint")
    return read_incremental(spark, f"{base}/tables", spec, ev.schema).select("user_id", "event_id", "event_type", "ts")


@query("st1_incremental_stats_ingest_part", f"WITH {SQL_STATS} SELECT * FROM stats")
def st1_stats(spark, sf):
    """Raw stats bodies land in two drops, the corrected ones first; each batch runs the ingest's parse step."""
    from ..operators import normalize as N
    from ..sources import landing as L
    from ..sources.scan import landing_payloads
    from ..streaming.incremental import read_incremental, run_incremental_upsert
    base = f"{checkpoint_dir(spark)}/st1s-{uuid.uuid4().hex}"
    good = L.stats_bodies(cat_of(spark, sf)).withColumn("landed", F.lit(2))
    stale = good.withColumn("body", F.regexp_replace("body", "[0-9]", "1")).withColumn("landed", F.lit(1))

    def parse(batch):
        rows = N.stats_records(landing_payloads(batch))
        return rows.join(batch.select("id", "landed").distinct(), "id") if "landed" not in rows.columns else rows

    spec = ModelSpec("stats", key=("id",))
    for i, drop in enumerate((good, stale)):
        drop.write.mode("overwrite").parquet(f"{base}/landing/drop={i}")
        run_incremental_upsert(spark, f"{base}/landing/drop=*", good.schema, spec, "landed", f"{base}/tables",
                               f"{base}/checkpoint", normalise=parse)
    schema = parse(good).schema
    return read_incremental(spark, f"{base}/tables", spec, schema).drop("landed")
