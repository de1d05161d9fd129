"""Stored buckets: which side is shuffled, which groups are written, and what is refused."""
import re

import pytest
from pyspark.sql import functions as F

from quarry.model import ModelSpec
from quarry.operators import mutate as M
from quarry.sources import sinks
from quarry.sources.bucketed import BucketedTable

SPEC = ModelSpec("t", key=("id",), defaults={"n": 0})


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), SPEC)
    t.create(spark.range(1000).select("id", F.concat(F.lit("x"), F.col("id")).alias("name"), F.lit(1).alias("n")), buckets=4, groups=8)
    return t


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def changes(spark, ids, name="y"):
    return spark.createDataFrame([(i, name) for i in ids], "id long, name string")


def test_upsert_joins_without_a_shuffle_of_the_stored_side(spark, table):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        result, touched = table.merged(changes(spark, [5, 2000]))
        text = executed(result.table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(touched) <= 2 and "FullOuter" in text
    # one exchange, on the side of the changes; the scan of the stored table has none above it
    exchanges = re.findall(r"Exchange hashpartitioning", text)
    assert len(exchanges) == 1 and "Bucketed: true" in text
    left = text.index("Exchange hashpartitioning") > text.index("FileScan parquet")
    assert left or "FileScan" not in text[text.index("Exchange hashpartitioning"):].split(":-")[0]


def test_only_touched_groups_are_written(spark, table):
    before = sinks.current_versions(spark, table.root)
    touched = table.upsert(changes(spark, [5, 2000]))
    after = sinks.current_versions(spark, table.root)
    assert {int(k[2:]) for k in after if k.startswith("t#") and after[k] != before[k]} == set(touched) and len(touched) <= 2
    rows = {r.id: (r.name, r.n) for r in table.read().collect()}
    assert len(rows) == 1001 and rows[5] == ("y", 1) and rows[2000] == ("y", 0) and rows[6] == ("x6", 1)
    assert table.upsert(changes(spark, [])) == []


def test_delete_and_twice_is_once(spark, table):
    table.upsert(changes(spark, range(990, 1010)))
    once = sorted(map(tuple, table.read().collect()))
    table.upsert(changes(spark, range(990, 1010)))
    assert sorted(map(tuple, table.read().collect())) == once and len(once) == 1010
    table.delete(spark.range(500, 1500).select("id"))
    assert sorted(r.id for r in table.read().collect()) == list(range(500))
    table.delete(spark.range(2000).select("id"))
    assert table.read().count() == 0


def test_conflicts_and_bad_keys(spark, table, monkeypatch):
    inner = BucketedTable._write

    def slow(self, df, groups, buckets):
        version = inner(self, df, groups, buckets)
        if not getattr(self, "raced", False):
            self.raced = True
            table.upsert(changes(spark, [5], "faster"))
        return version

    other = BucketedTable(spark, table.root, SPEC)
    monkeypatch.setattr(other, "_write", slow.__get__(other))
    with pytest.raises(sinks.PublishConflict):
        other.upsert(changes(spark, [5], "slower"))
    assert table.read().where("id = 5").first().name == "faster"
    with pytest.raises(M.RequiredViolation):
        table.upsert(spark.createDataFrame([(None, "z")], "id long, name string"))
    with pytest.raises(M.UniqueViolation):
        table.upsert(changes(spark, [1, 1]))
    with pytest.raises(KeyError):
        BucketedTable(spark, table.root, ModelSpec("absent", key=("id",))).read()
