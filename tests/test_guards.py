"""Guards and edge rules of the mutations, landing rules, publishing and session."""
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarry.catalog import Catalog
from quarry.model import ModelSpec
from quarry.operators import ml
from quarry.operators import mutate as M
from quarry.operators import normalize as N
from quarry.operators import quality as Q
from quarry.operators.read import slice_rows
from quarry.plans import ingest_jobs as J
from quarry.session import checkpoint_dir
from quarry.sources import sinks
from quarry.sources.scan import landing_payloads
from quarry.streaming.incremental import merge_by_seq

SPEC = ModelSpec("t", key=("k",))


def frame(spark, rows, schema="k int, v string"):
    return spark.createDataFrame(rows, schema)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_without_seq_are_refused(spark):
    old, twice = frame(spark, [(1, "a")]), frame(spark, [(1, "b"), (1, "c")])
    with pytest.raises(M.UniqueViolation):
        M.upsert(old, twice, SPEC)
    with pytest.raises(M.UniqueViolation):
        M.update_from(old, twice, ("k",))
    last = M.upsert(old, twice.withColumn("s", F.when(F.col("v") == "b", 2).otherwise(1)), SPEC, seq="s").table
    assert [r.v for r in last.collect()] == ["b"]


def test_children_without_a_parent_are_refused(spark):
    parents, children = frame(spark, [(1, "a")]), frame(spark, [(1, 9)], "k int, p int")
    child_spec = ModelSpec("c", key=("k",))
    with pytest.raises(M.RequiredViolation):
        M.nested_create(parents, frame(spark, [(2, "b")]), SPEC, children, frame(spark, [(5, 3)], "k int, p int"), child_spec, foreign_key=("p",))
    made, kids = M.nested_create(parents, frame(spark, [(2, "b")]), SPEC, children, frame(spark, [(5, 2)], "k int, p int"), child_spec, foreign_key=("p",))
    assert made.count() == 2 and kids.count() == 2


def test_required_columns(spark):
    df = frame(spark, [(1, "a"), (2, None)])
    out = Q.partial(df, required=["v"], optional=["k"])
    assert not out.schema["v"].nullable and out.schema["k"].nullable
    assert out.where("k = 1").first().v == "a"
    with pytest.raises(Exception, match="v is required"):
        out.collect()


def test_big_category_id_is_listed_not_fatal(spark):
    body = ('{"7":{"success":true,"data":{"name":"g","categories":[{"id":3000000000,"description":"big"},'
            '{"id":5,"description":"five"}]}}}')
    empty = spark.createDataFrame([], "id int, body string")
    run = J.ingest(frame(spark, [(0, "7")], "seq long, appid string"), frame(spark, [(7, body)], "id int, body string"), empty,
                   spark.createDataFrame([], "id int, page_no int, body string"), catalog=Catalog.empty_catalogue(spark), run_ts="t")
    assert [(r.id, r.name) for r in run.catalog.df("Category").collect()] == [(5, "five")]
    assert [(r.gameId, r.id) for r in J.oversized_items(run.store, "categories").collect()] == [(7, 3000000000)]


def page(children, cursor):
    items = ",".join(f'{{"recommendationid":"{c}"}}' for c in children)
    return f'{{"success":1,"cursor":"{cursor}","reviews":[{items}]}}'


def test_a_page_that_never_landed_ends_the_run(spark):
    rows = [(1, 1, page(["a"], "x")), (1, 3, page(["c"], "y")), (2, 2, page(["d"], "z")), (3, 1, page(["e"], "p")), (3, 2, page(["f"], "q"))]
    _, reviews = N.page_run(landing_payloads(frame(spark, rows, "id int, page_no int, body string")))
    assert sorted(r.id for r in reviews.collect()) == ["a", "e", "f"]


def test_two_publishers_keep_each_others_tables(spark):
    root = f"{checkpoint_dir(spark)}/publishers"
    sinks.publish(spark, root, {"a": frame(spark, [(1, "a")])})
    number, seen = sinks._newest(spark, root)
    # another job publishes between this one's reading and writing
    sinks.publish(spark, root, {"b": frame(spark, [(2, "b")])})
    assert not sinks._create_manifest(spark, root, number + 1, seen | {"c": "lost"})
    sinks.publish(spark, root, {"c": frame(spark, [(3, "c")])})
    assert set(sinks.current_versions(spark, root)) == {"a", "b", "c"}


def test_late_rows_fill_but_do_not_overwrite(spark):
    old = frame(spark, [(1, 10, None, "new")], "k int, s int, a string, b string")
    late = frame(spark, [(1, 5, "old", "old"), (2, 1, "x", None)], "k int, s int, a string, b string")
    got = {tuple(r) for r in merge_by_seq(old, late, ("k",), "s").collect()}
    assert got == {(1, 10, "old", "new"), (2, 1, "x", None)}


@pytest.mark.parametrize("skip,take", [(0, None), (3, None), (37, 20), (95, 20), (200, 5), (10, 0)])
def test_slices(spark, skip, take):
    df = spark.range(100).repartition(7)
    got = [r.id for r in slice_rows(df, [F.col("id").desc()], skip, take).collect()]
    want = list(range(99, -1, -1))[skip:]
    assert got == (want if take is None else want[:take])


def test_no_window_over_a_whole_class(spark, cat):
    split = ml.stratified_split(cat.df("embeddings").select("vec_id", "label"), "label", "vec_id")
    assert "windowspecdefinition(__class" in plan(split) and "__bucket" in plan(split).split("windowspecdefinition(__class")[-1][:200]
    assert "SinglePartition" not in plan(split)


def test_each_landing_source_is_scanned_once(spark, cat):
    from quarry.sources import landing as L
    run = J.ingest(L.id_texts(cat), L.store_bodies(cat), L.stats_bodies(cat), L.review_page_bodies(cat), run_ts="t")
    for part in (run.store, run.stats):
        assert plan(part).count("FileScan parquet") == 1


def test_cluster_without_a_shared_folder_is_an_error():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
