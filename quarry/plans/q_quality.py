"""Checked queries for data-quality checks (Q1, Q2, Q4), profiling (G13),
raw SQL (S9–S11), CSV round trips (S2, S5, K1, K2) and the ML split (N7)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog
from ..operators import quality as Q
from ..operators.profile import profile
from ..sources import scan, sinks
from .registry import fixture_catalog, query


def cat_of(spark, sf) -> Catalog:
    return fixture_catalog(spark, sf)


def scratch(spark, name: str) -> str:
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- Q1 Q2 Q4
@query("q1_unique_violations_lineitem", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def q1_unique(spark, sf):
    return Q.unique_violations(cat_of(spark, sf).df("lineitem"), ("l_orderkey", "l_linenumber"))


@query("q2_required_violations_documents_labels", """
SELECT 'doc_id' AS column, count(*) - count(d.doc_id) AS n_null FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'quality', count(*) - count(l.quality) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'toxic', count(*) - count(l.toxic) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'lang', count(*) - count(d.lang) FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q2_required(spark, sf):
    cat = cat_of(spark, sf)
    dl = cat.df("documents").select("doc_id", "lang").join(cat.df("labels"), "doc_id", "left")
    return Q.required_violations(dl, ["doc_id", "quality", "toxic", "lang"])


@query("q4_type_violations_orders", """
SELECT o_orderkey, 'key_text' AS column, 'k' || o_orderkey AS value FROM orders WHERE o_orderkey % 17 = 0
UNION ALL
SELECT o_orderkey, 'price_text', CAST(o_totalprice AS VARCHAR) || '$' FROM orders WHERE o_orderkey % 23 = 0
""")
def q4_types(spark, sf):
    o = cat_of(spark, sf).df("orders")
    k = F.col("o_orderkey")
    df = o.select("o_orderkey",
                  F.when(k % 17 == 0, F.concat(F.lit("k"), k.cast("string"))).otherwise(k.cast("string")).alias("key_text"),
                  F.when(k % 23 == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit("$")))
                   .otherwise(F.col("o_totalprice").cast("string")).alias("price_text"))
    return Q.type_violations(df, {"key_text": "bigint", "price_text": "double"}, ["o_orderkey"])


# ---------------------------------------------------------------- G13 profiles
def _rounded(df):
    return df.select("column", "count", "unique", "top", "freq",
                     *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def _profile_sql(table: str, numeric: list[str], text: list[str]) -> str:
    parts = []
    for c in numeric:
        parts.append(f"""SELECT '{c}' AS column, count({c}) AS count, CAST(NULL AS BIGINT) AS unique,
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {table}""")
    for c in text:
        parts.append(f"""SELECT '{c}', count({c}), count(DISTINCT {c}),
  (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1),
  (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1),
  CAST(NULL AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL FROM {table}""")
    return "\nUNION ALL\n".join(parts)


@query("g13_profile_part", _profile_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def g13_profile_part(spark, sf):
    return _rounded(profile(cat_of(spark, sf).df("part")))


@query("g13_profile_customer", _profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"],
                                            ["c_name", "c_mktsegment"]))
def g13_profile_customer(spark, sf):
    return _rounded(profile(cat_of(spark, sf).df("customer")))


# ---------------------------------------------------------------- S9 S10 S11 raw SQL
@query("s9_raw_sql_positional_params", """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '5-LOW'
GROUP BY o_orderstatus
""")
def s9_raw(spark, sf):
    cat = cat_of(spark, sf)
    return scan.raw_query(spark, "SELECT o_orderstatus, count(*) AS n FROM orders "
                                 "WHERE o_totalprice > ? AND o_orderpriority <> ? GROUP BY o_orderstatus",
                          args=[100000, "5-LOW"], tables={"orders": cat.df("orders")})


@query("s10_raw_sql_first_row", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1
""")
def s10_first(spark, sf):
    cat = cat_of(spark, sf)
    return scan.raw_query_first(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :st "
                                       "ORDER BY o_totalprice DESC, o_orderkey",
                                args={"st": "O"}, tables={"orders": cat.df("orders")})


@query("s11_typed_raw_results_lineitem", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_shipdate AS DATE) AS ship_day
FROM lineitem WHERE l_quantity >= 0
""")
def s11_typed(spark, sf):
    cat = cat_of(spark, sf)
    raw = scan.raw_query(spark, "SELECT l_orderkey, l_extendedprice AS price, l_linenumber, l_shipdate AS ship_day "
                                "FROM lineitem WHERE l_quantity >= ?", args=[0], tables={"lineitem": cat.df("lineitem")})
    typed = scan.cast_to(raw, T.StructType([
        T.StructField("l_orderkey", T.StringType()), T.StructField("price", T.DecimalType(18, 2)),
        T.StructField("l_linenumber", T.LongType()), T.StructField("ship_day", T.DateType())]))
    return typed.withColumn("price", F.col("price").cast("double"))


# ---------------------------------------------------------------- S2 S5 K1 K2 CSV round trips
@query("s2_existing_keys_from_csv_sink", "SELECT DISTINCT CAST(p_partkey AS INTEGER) AS id FROM part")
def s2_csv_keys(spark, sf):
    path = scratch(spark, "s2")
    part = cat_of(spark, sf).df("part")
    sinks.write_csv(part.select(F.col("p_partkey").alias("id"), "p_name"), path)
    sinks.write_csv(part.where("p_size < 10").select(F.col("p_partkey").alias("id"), "p_name"), path, append=True)
    return scan.existing_keys_from_csv(spark, path, "id")


@query("s5_k1_csv_roundtrip_customer", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS positive FROM customer
""")
def s5_csv_roundtrip(spark, sf):
    path = scratch(spark, "s5")
    cust = cat_of(spark, sf).df("customer").withColumn("positive", F.col("c_acctbal") > 0)
    sinks.write_csv(sinks._python_text(cust), path)
    back = scan.read_csv_inferred(spark, path)
    return back.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
                       F.col("c_acctbal").cast("double"), "c_mktsegment",
                       (F.lower(F.col("positive").cast("string")) == "true").alias("positive"))


@query("k2_child_csv_iso_times_events", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type FROM events
""")
def k2_child_csv(spark, sf):
    path = scratch(spark, "k2")
    ev = cat_of(spark, sf).df("events").select("event_id", "ts", "event_type")
    sinks.write_child_csv(spark, ev, path, ["event_id", "ts", "event_type"], datetime_cols=["ts"])
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("event_id").cast("bigint"), "ts", "event_type")


# ---------------------------------------------------------------- N7 ML2 stratified split
@query("n7_ml2_stratified_split_embeddings", """
SELECT vec_id, label, rn <= CAST(ceil(0.2 * n) AS BIGINT) AS is_test FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings)
""")
def n7_split(spark, sf):
    from ..operators.ml import stratified_split
    emb = cat_of(spark, sf).df("embeddings").select("vec_id", "label")
    return stratified_split(emb, "label", "vec_id", test_size=0.2, seed=42).select("vec_id", "label", "is_test")


@query("g14_class_count_embeddings", "SELECT count(DISTINCT label) AS n_classes FROM embeddings")
def g14_classes(spark, sf):
    from ..operators.ml import class_count
    return class_count(cat_of(spark, sf).df("embeddings"), "label")


@query("g12_accuracy_rule_on_labels", """
SELECT avg(CASE WHEN (d.n_chars > 5000)::INT = l.quality THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_test
FROM labels l JOIN documents d USING (doc_id)
""")
def g12_accuracy(spark, sf):
    from ..operators.ml import accuracy
    cat = cat_of(spark, sf)
    df = cat.df("labels").join(cat.df("documents"), "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") > 5000).cast("int").alias("p"))
    return accuracy(df, "y", "p")


# ---------------------------------------------------------------- texts that a careless round trip loses
@query("s2_k1_text_round_trip_documents", """
SELECT CAST(doc_id AS INTEGER) AS id, '  "' || upper(source) || '"",' || text || chr(10) || doc_id * 7 || ',x"' || chr(9) AS name, 'keys' AS kind FROM documents
UNION ALL SELECT CAST(doc_id AS INTEGER), NULL, 'ids' FROM documents
""")
def s2_text_round_trip(spark, sf):
    return _text_round_trip(spark, sf, F.concat(F.upper("source"), F.lit('"",'), "text"))


@query("s2_k1_whole_text_round_trip_documents", """
SELECT CAST(doc_id AS INTEGER) AS id, '  "' || text || chr(10) || doc_id * 7 || ',x"' || chr(9) AS name, 'keys' AS kind FROM documents
UNION ALL SELECT CAST(doc_id AS INTEGER), NULL, 'ids' FROM documents
""")
def s2_whole_text_round_trip(spark, sf):
    return _text_round_trip(spark, sf, F.col("text"))


def _text_round_trip(spark, sf, text):
    """K1/K2 write, S5 reads back, S2 finds the keys: line ends, quotes, commas, digits and outer blanks all stay in the text."""
    path = scratch(spark, "texts")
    docs = cat_of(spark, sf).df("documents")
    name = F.concat(F.lit('  "'), text, F.lit("\n"), (F.col("doc_id") * 7).cast("string"), F.lit(',x"\t'))
    half = docs.select(F.max("doc_id")).scalar() / 2
    rows = docs.select(F.col("doc_id").alias("id"), name.alias("name"))
    sinks.write_entity_csv(spark, rows.where(F.col("id") <= half), path, ["id", "name"])
    sinks.write_entity_csv(spark, rows.where(F.col("id") > half), path, ["id", "name"], resume=True)
    back = scan.read_csv(spark, path, "id int, name string")
    return back.withColumn("kind", F.lit("keys")).unionByName(
        scan.existing_keys_from_csv(spark, path).select("id", F.lit(None).cast("string").alias("name"), F.lit("ids").alias("kind")))


@query("s1_l10_file_order_documents", """
SELECT appid, row_number() OVER (ORDER BY file, place) AS pos FROM (
  SELECT doc_id AS appid, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 1 END AS file, doc_id AS place FROM documents)
QUALIFY pos > 5 AND pos <= 205
""")
def s1_file_order(spark, sf):
    """Ids come in order of file name and place, though the first file is much the smaller one."""
    path = scratch(spark, "ids")
    docs = cat_of(spark, sf).df("documents").select(F.col("doc_id").alias("appid"))
    for name, cond in (("a", "appid % 50 = 0"), ("b", "appid % 50 <> 0")):
        docs.where(cond).repartitionByRange("appid").sortWithinPartitions("appid").write.option("header", True).csv(f"{path}/{name}")
    from . import ingest_jobs as J
    kept = J.offset_limit(scan.read_id_list(spark, f"{path}/*"), offset=5, limit=200)
    seen = kept.withColumn("__m", F.monotonically_increasing_id())
    return seen.select(F.col("appid").cast("bigint").alias("appid"), (F.row_number().over(Window.orderBy("__m")) + 5).alias("pos"))


@query("k3_sorted_ids_labels", "SELECT DISTINCT doc_id AS appid FROM labels")
def k3_sorted(spark, sf):
    path = scratch(spark, "k3")
    sinks.write_sorted_ids(cat_of(spark, sf).df("labels").select(F.col("doc_id").alias("appid")), path)
    return scan.read_csv(spark, path, "appid bigint")


@query("g13_profile_orders", _profile_sql("(SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders)",
                                          ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
def g13_profile_orders(spark, sf):
    return _rounded(profile(cat_of(spark, sf).df("orders")))
