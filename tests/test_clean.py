"""Edge truth tables of the scalar rules (FIXTURES.md §3), as literal rows."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import clean as C
from quarry.sources.scan import parse_body


def run(spark, values, fn, as_json=True, sql=True):
    """Apply the rule ``fn`` to each value (JSON text → VARIANT when ``as_json``);
    rules are SQL-text builders applied to the column ``v`` unless ``sql=False``."""
    rows = [(i, json.dumps(v) if as_json else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, s string")
    staged = df.select("i", (F.parse_json("s") if as_json else F.col("s")).alias("v"))
    expr = F.expr(fn("v")) if sql else fn(F.col("v"))
    out = staged.select("i", expr.alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_f1_strip_html(spark):
    values = [None, "<p>a &amp; b<br/></p>", "&lt;b&gt;x", "a<br>b", "&nbsp;x&nbsp;", "a < b"]
    assert run(spark, values, C.strip_html, as_json=False, sql=False) == ["", "a & b", "<b>x", "ab", "x", "a < b"]


def test_f2_separators(spark):
    assert run(spark, ["English, French", "a,b"], C.list_separators, as_json=False) == ["English; French", "a,b"]


def test_f3_release_dates(spark):
    values = ["Nov 1, 2000", "1 Nov, 2000", "Nov 2000", "2000", "Q3 2025", "Coming soon", "November 1, 2000", "  "]
    got = run(spark, values, C.parse_release_date, as_json=False)
    d = dt.datetime(2000, 11, 1)
    assert got == [d, d, d, dt.datetime(2000, 1, 1), None, None, None, None]


def test_f4_required_age(spark):
    values = [None, 17, 99, -3, "18", "18+", "18.0", "3.7", "abc", "", True]
    assert run(spark, values, C.required_age) == [0, 17, 21, 0, 18, 18, 18, 3, 0, 0, 1]


def test_f5_int_default(spark):
    values = [7, "7", 3.7, "3.7", None, "", "x"]
    assert run(spark, values, lambda v: C.variant_int(v, default=0)) == [7, 7, 3, 0, 0, 0, 0]


def test_f6_float_default(spark):
    assert run(spark, ["0.52", 1, None, "x"], lambda v: C.variant_float(v, default=0.0)) == [0.52, 1.0, 0.0, 0.0]


def test_f7_truthiness(spark):
    values = [True, 1, "false", 0, "", None, [], {}]
    assert run(spark, values, C.truthy) == [True, True, True, False, False, False, False, False]


def test_f8_owners(spark):
    values = ["20,000 .. 50,000", "20,000", "a .. 5", "1 .. b", "1..2..3", "", None]
    got = run(spark, values, lambda v: "named_struct('lo', {}, 'hi', {})".format(*C.owners_range(v)))
    assert [tuple(r) for r in got] == [(20000, 50000)] + [(0, 0)] * 6


def test_f9_string_or_list(spark):
    values = ["Valve", [" A ", "B"], ["", "A"], [" ", "A"], 5, None]
    texts = run(spark, values, lambda v: C.join_list(C.string_or_list(v)))
    links = run(spark, values, lambda v: C.link_names(C.string_or_list(v)))
    assert texts == ["Valve", "A, B", "A", ", A", "", ""]
    assert links == [["Valve"], ["A", "B"], ["A"], ["A"], [], []]


def test_f11_id_name_items(spark):
    values = [[{"id": "1", "description": "X"}, {"id": "z"}, "x", {"id": 3}]]
    got = run(spark, values, lambda v: C.id_name_items(v, None, ("description",)))
    assert [tuple(r) for r in got[0]] == [(1, "X"), (3, "")]


def test_f12_epoch(spark):
    got = run(spark, [1700000000, 0, -5, None, "x"], lambda v: C.epoch_to_ts(C.variant_int(v, default=0)))
    assert got == [dt.datetime(2023, 11, 14, 22, 13, 20), None, None, None, None]


def test_f13_clamp(spark):
    assert run(spark, [4294967295, 5, -1], lambda v: C.clamp_int(C.variant_int(v))) == [2147483647, 5, -1]


def test_f15_millis(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)], "ts timestamp_ntz")
    assert df.selectExpr(C.truncate_millis("ts")).first()[0] == dt.datetime(2024, 1, 1, 0, 0, 7, 179000)


def test_f14_iso(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 6, 7),), (dt.datetime(2024, 1, 1, 5, 6, 7, 5),)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.selectExpr(C.iso_datetime("ts")).collect()]
    assert got == ["2024-01-01T05:06:07", "2024-01-01T05:06:07.000005"]


def test_strict_json_bodies(spark):
    values = ['{"a":1}', '"k": 69}', '{"a":1} x', "1,2", "not json", "[1,2]"]
    got = run(spark, values, lambda c: parse_body(c).isNotNull(), as_json=False, sql=False)
    assert got == [True, False, False, False, False, True]


def test_s1_id_list(spark, tmp_path):
    from quarry.sources.scan import read_id_list
    p = tmp_path / "ids.csv"
    p.write_text("appid\n10\n 20 \n\nx\n10\n")
    got = [r["appid"] for r in read_id_list(spark, str(p)).orderBy("seq").collect()]
    assert got == [10, 20, 10]


def test_s1_missing_column_gives_no_ids(spark, tmp_path):
    from quarry.sources.scan import read_id_list
    p = tmp_path / "ids.csv"
    p.write_text("other\n10\n")
    assert read_id_list(spark, str(p)).count() == 0
