"""Checked queries for the read surface: filters (W), paging (L), counts and
groups (G), row numbering (N1, N2) and joins / includes (J)."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.filters import Json
from ..model import ModelSpec
from ..operators import mutate
from .registry import fixture_catalog, query

LINEITEM_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


def cat_of(spark, sf) -> Catalog:
    return fixture_catalog(spark, sf)


# ---------------------------------------------------------------- G4–G8, W7, L9
@query("g4_g8_group_having_lineitem", """
SELECT l_returnflag, l_linestatus,
       sum(l_quantity) AS _sum_l_quantity, avg(l_quantity) AS _avg_l_quantity,
       min(l_shipdate) AS _min_l_shipdate, min(l_discount) AS _min_l_discount,
       max(l_shipdate) AS _max_l_shipdate, max(l_quantity) AS _max_l_quantity,
       count(*) AS _count__all, count(l_tax) AS _count_l_tax
FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'
GROUP BY l_returnflag, l_linestatus
HAVING avg(l_quantity) > 25.5 OR l_returnflag = 'N'
ORDER BY l_returnflag DESC, l_linestatus ASC LIMIT 4
""", bench=True)
def g4_g8_group_having_lineitem(spark, sf):
    return cat_of(spark, sf).table("lineitem").group_by(
        ["l_returnflag", "l_linestatus"],
        where={"l_shipdate": {"lt": datetime(2000, 1, 1)}},
        sum={"l_quantity": True}, avg={"l_quantity": True},
        min={"l_shipdate": True, "l_discount": True}, max={"l_shipdate": True, "l_quantity": True},
        count={"_all": True, "l_tax": True},
        having={"OR": [{"l_quantity": {"_avg": {"gt": 25.5}}}, {"l_returnflag": "N"}]},
        order={"l_returnflag": "desc"}, take=4)


@query("g4_group_orders_by_status_priority", """
SELECT o_orderstatus, o_orderpriority, count(*) AS _count__all,
       min(o_orderdate) AS _min_o_orderdate, max(o_orderdate) AS _max_o_orderdate,
       min(o_totalprice) AS _min_o_totalprice, max(o_totalprice) AS _max_o_totalprice
FROM orders GROUP BY o_orderstatus, o_orderpriority
HAVING count(*) > 970
""")
def g4_group_orders(spark, sf):
    return cat_of(spark, sf).table("orders").group_by(
        ["o_orderstatus", "o_orderpriority"], count=True,
        min={"o_orderdate": True, "o_totalprice": True}, max={"o_orderdate": True, "o_totalprice": True},
        having={"o_orderkey": {"_count": {"gt": 970}}})


@query("g7_group_count_events", """
SELECT event_type, count(*) AS _count__all, count(props) AS _count_props,
       CAST(sum(user_id) AS BIGINT) AS _sum_user_id
FROM events GROUP BY event_type
""")
def g7_group_count_events(spark, sf):
    return cat_of(spark, sf).table("events").group_by(
        "event_type", count={"_all": True, "props": True}, sum={"user_id": True})


# ---------------------------------------------------------------- W1 W3 W4
@query("w1_w3_w4_equals_not_orders", """
SELECT * FROM orders
WHERE o_orderstatus = 'F' AND o_custkey <> 7
  AND NOT (o_orderpriority IN ('5-LOW', '1-URGENT'))
  AND NOT (o_totalprice < 100000)
""")
def w1_w3_w4(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(where={
        "o_orderstatus": "F",
        "o_custkey": {"not": 7},
        "o_orderpriority": {"not": {"in": ["5-LOW", "1-URGENT"]}},
        "o_totalprice": {"not": {"lt": 100000}},
    })


# ---------------------------------------------------------------- W2 (NULLs made by a left join)
def _doc_labels(spark, sf) -> Catalog:
    cat = cat_of(spark, sf)
    dl = cat.df("documents").select("doc_id", "lang", "source", "n_chars").join(
        cat.df("labels"), "doc_id", "left")
    return cat.with_table("doc_labels", dl)


@query("w2_is_null_documents_labels", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NULL AND d.source IS NOT NULL
""")
def w2_is_null(spark, sf):
    return _doc_labels(spark, sf).table("doc_labels").find_many(
        where={"quality": None, "source": {"not": None}})


# ---------------------------------------------------------------- W5 W6
@query("w5_w6_in_not_in_lineitem", f"""
SELECT {LINEITEM_COLS} FROM lineitem
WHERE l_suppkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND l_linenumber NOT IN (1, 2)
""")
def w5_w6(spark, sf):
    return cat_of(spark, sf).table("lineitem").find_many(where={
        "l_suppkey": {"in": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]},
        "l_linenumber": {"not_in": [1, 2]}})


@query("w5_in_from_dataframe_lineitem", f"""
SELECT {LINEITEM_COLS} FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 40)
""")
def w5_in_df(spark, sf):
    cat = cat_of(spark, sf)
    keys = cat.df("part").where("p_type = 'PROMO' AND p_size > 40").select("p_partkey")
    return cat.table("lineitem").find_many(where={"l_partkey": {"in": keys}})


# ---------------------------------------------------------------- W7
@query("w7_range_events", """
SELECT * FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'
  AND event_type > 'click' AND value <= 50
""")
def w7_range_events(spark, sf):
    return cat_of(spark, sf).table("events").find_many(where={
        "ts": {"gte": datetime(2024, 1, 10), "lt": datetime(2024, 1, 12, 12)},
        "event_type": {"gt": "click"}, "value": {"lte": 50}})


# ---------------------------------------------------------------- W8 W9 W10
@query("w8_w9_w10_text_filters", """
SELECT 'contains' AS tag, doc_id AS k FROM documents WHERE contains(text, 'Elle')
UNION ALL
SELECT 'prefix_suffix', p_partkey FROM part WHERE starts_with(p_name, 'red') OR suffix(p_name, 'bolt')
UNION ALL
SELECT 'insensitive', c_custkey FROM customer
WHERE lower(c_mktsegment) = lower('machinery') AND contains(lower(c_name), lower('CUSTOMER#0000001'))
""")
def w8_w9_w10(spark, sf):
    cat = cat_of(spark, sf)
    a = cat.table("documents").find_many(where={"text": {"contains": "Elle"}}).select(
        F.lit("contains").alias("tag"), F.col("doc_id").alias("k"))
    b = cat.table("part").find_many(where={"OR": [{"p_name": {"startswith": "red"}},
                                                  {"p_name": {"endswith": "bolt"}}]}).select(
        F.lit("prefix_suffix").alias("tag"), F.col("p_partkey").alias("k"))
    c = cat.table("customer").find_many(where={
        "c_mktsegment": {"equals": "machinery", "mode": "insensitive"},
        "c_name": {"contains": "CUSTOMER#0000001", "mode": "insensitive"}}).select(
        F.lit("insensitive").alias("tag"), F.col("c_custkey").alias("k"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------- W11 full text
@query("w11_search_documents", r"""
SELECT doc_id, lang FROM documents
WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['le', 'la'])
""")
def w11_search(spark, sf):
    return cat_of(spark, sf).table("documents").find_many(
        where={"text": {"search": "le la"}}, select=["doc_id", "lang"])


# ---------------------------------------------------------------- W12 booleans
@query("w12_boolean_lineitem", f"""
SELECT {LINEITEM_COLS}, l_returnflag = 'R' AS is_returned FROM lineitem
WHERE (l_returnflag = 'R') = true
UNION ALL
SELECT {LINEITEM_COLS}, l_returnflag = 'R' AS is_returned FROM lineitem
WHERE (l_returnflag = 'R') <> true
""")
def w12_boolean(spark, sf):
    cat = cat_of(spark, sf)
    cat = cat.with_table("li", cat.df("lineitem").withColumn("is_returned", F.col("l_returnflag") == "R"))
    t = cat.table("li")
    return t.find_many(where={"is_returned": {"equals": True}}).unionByName(t.find_many(where={"is_returned": {"not": True}}))


# ---------------------------------------------------------------- W13 JSON
@query("w13_json_equals_events", """
SELECT event_id, props FROM events
WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 7 AND json_keys(props) = ['k']
UNION ALL
SELECT event_id, props FROM events
WHERE NOT (CAST(json_extract(props, '$.k') AS INTEGER) = 7)
""")
def w13_json(spark, sf):
    t = cat_of(spark, sf).table("events")
    a = t.find_many(where={"props": {"equals": Json({"k": 7})}})
    b = t.find_many(where={"props": {"not": Json({"k": 7})}})
    return a.unionByName(b).select("event_id", "props")


# ---------------------------------------------------------------- W14 bytes
@query("w14_bytes_part", """
SELECT p_partkey, p_name FROM part WHERE encode(p_name) IN ('red bolt'::BLOB, 'small ring'::BLOB)
UNION ALL
SELECT p_partkey, p_name FROM part WHERE encode(p_name) = 'blue bolt'::BLOB
""")
def w14_bytes(spark, sf):
    cat = cat_of(spark, sf)
    cat = cat.with_table("pb", cat.df("part").withColumn("p_name_bin", F.col("p_name").cast("binary")))
    t = cat.table("pb")
    a = t.find_many(where={"p_name_bin": {"in": [b"red bolt", b"small ring"]}})
    b = t.find_many(where={"p_name_bin": {"equals": b"blue bolt"}})
    return a.unionByName(b).select("p_partkey", "p_name")


# ---------------------------------------------------------------- W15 decimals
@query("w15_decimal_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price
FROM lineitem
WHERE CAST(l_extendedprice AS DECIMAL(18,2)) >= 50000.00 AND CAST(l_extendedprice AS DECIMAL(18,2)) < 50250.50
""")
def w15_decimal(spark, sf):
    cat = cat_of(spark, sf)
    cat = cat.with_table("ld", cat.df("lineitem").withColumn(
        "price", F.col("l_extendedprice").cast("decimal(18,2)")))
    df = cat.table("ld").find_many(where={"price": {"gte": Decimal("50000.00"), "lt": Decimal("50250.50")}})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("price").cast("double").alias("price"))


# ---------------------------------------------------------------- W16–W20 lists
@query("w16_w20_list_filters_part", """
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)
SELECT 'equals' AS tag, p_partkey FROM p WHERE words = ['red', 'bolt']
UNION ALL SELECT 'has', p_partkey FROM p WHERE list_contains(words, 'bolt')
UNION ALL SELECT 'has_every', p_partkey FROM p WHERE list_has_all(words, ['small', 'ring'])
UNION ALL SELECT 'has_some', p_partkey FROM p WHERE list_has_any(words, ['gear', 'ring'])
UNION ALL SELECT 'is_empty', p_partkey FROM p WHERE len(words) = 0
UNION ALL SELECT 'not_empty', p_partkey FROM p WHERE len(words) > 0
""")
def w16_w20_lists(spark, sf):
    cat = cat_of(spark, sf)
    cat = cat.with_table("pw", cat.df("part").select("p_partkey", F.split("p_name", " ").alias("words")))
    t = cat.table("pw")
    parts = [
        ("equals", {"words": {"equals": ["red", "bolt"]}}),
        ("has", {"words": {"has": "bolt"}}),
        ("has_every", {"words": {"has_every": ["small", "ring"]}}),
        ("has_some", {"words": {"has_some": ["gear", "ring"]}}),
        ("is_empty", {"words": {"is_empty": True}}),
        ("not_empty", {"words": {"is_empty": False}}),
    ]
    out = None
    for tag, w in parts:
        df = t.find_many(where=w).select(F.lit(tag).alias("tag"), "p_partkey")
        out = df if out is None else out.unionByName(df)
    return out


# ---------------------------------------------------------------- W21–W23
@query("w21_w23_and_or_not_orders", """
SELECT * FROM orders
WHERE (o_totalprice > 200000 AND o_orderstatus IN ('F', 'O'))
  AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')
  AND NOT (o_custkey < 100) AND NOT (o_orderdate < TIMESTAMP '1996-01-01')
""")
def w21_w23(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(where={
        "AND": [{"o_totalprice": {"gt": 200000}}, {"o_orderstatus": {"in": ["F", "O"]}}],
        "OR": [{"o_orderpriority": "1-URGENT"}, {"o_orderpriority": "2-HIGH"}],
        "NOT": [{"o_custkey": {"lt": 100}}, {"o_orderdate": {"lt": datetime(1996, 1, 1)}}],
    })


# ---------------------------------------------------------------- W24 L8
@query("w24_unique_compound_link", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 7 AND l_suppkey = 3
""")
def w24_unique(spark, sf):
    return cat_of(spark, sf).table("part_supplier").find_unique(
        where={"l_partkey_l_suppkey": {"l_partkey": 7, "l_suppkey": 3}})


@query("l8_find_unique_part", "SELECT * FROM part WHERE p_partkey = 7")
def l8_find_unique(spark, sf):
    return cat_of(spark, sf).table("part").find_unique_or_raise(where={"p_partkey": 7})


# ---------------------------------------------------------------- W25 to-one
@query("w25_to_one_is_is_not_orders", """
SELECT 'is' AS tag, o.o_orderkey FROM orders o
WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'
              AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1))
UNION ALL
SELECT 'is_not', o.o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 500)
""")
def w25_to_one(spark, sf):
    t = cat_of(spark, sf).table("orders")
    a = t.find_many(where={"customer": {"is": {"c_mktsegment": "BUILDING",
                                               "nation": {"is": {"n_regionkey": 1}}}}})
    b = t.find_many(where={"customer": {"is_not": {"c_acctbal": {"gt": 500}}}})
    return a.select(F.lit("is").alias("tag"), "o_orderkey").unionByName(
        b.select(F.lit("is_not").alias("tag"), "o_orderkey"))


# ---------------------------------------------------------------- W26–W28 to-many
@query("w26_w28_to_many_some_none_every", """
SELECT 'some' AS tag, p.p_partkey AS k FROM part p
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)
UNION ALL
SELECT 'none', o.o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL
SELECT 'every', o.o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND NOT (l.l_quantity >= 10))
UNION ALL
SELECT 'or_some', o.o_orderkey FROM orders o
WHERE o.o_totalprice < 5000
   OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount = 0.1 AND l.l_tax = 0.0)
""")
def w26_w28(spark, sf):
    cat = cat_of(spark, sf)
    a = cat.table("part").find_many(where={"lineitems": {"some": {"l_quantity": {"gt": 49}}}})
    o = cat.table("orders")
    b = o.find_many(where={"lineitems": {"none": {}}})
    c = o.find_many(where={"lineitems": {"every": {"l_quantity": {"gte": 10}}}})
    d = o.find_many(where={"OR": [{"o_totalprice": {"lt": 5000}},
                                  {"lineitems": {"some": {"l_discount": 0.1, "l_tax": 0.0}}}]})
    return (a.select(F.lit("some").alias("tag"), F.col("p_partkey").alias("k"))
            .unionByName(b.select(F.lit("none").alias("tag"), F.col("o_orderkey").alias("k")))
            .unionByName(c.select(F.lit("every").alias("tag"), F.col("o_orderkey").alias("k")))
            .unionByName(d.select(F.lit("or_some").alias("tag"), F.col("o_orderkey").alias("k"))))


# ---------------------------------------------------------------- L1 L3
@query("l1_l3_order_take_orders", """
SELECT * FROM orders ORDER BY o_orderdate DESC, o_totalprice ASC, o_orderkey ASC LIMIT 25
""")
def l1_l3(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(
        order=[{"o_orderdate": "desc"}, {"o_totalprice": "asc"}], take=25)


@query("l3_negative_take_orders", """
SELECT * FROM orders ORDER BY o_totalprice ASC, o_orderkey DESC LIMIT 10
""")
def l3_negative_take(spark, sf):
    # take=-10 over a descending order = the last 10 rows of that order
    return cat_of(spark, sf).table("orders").find_many(order={"o_totalprice": "desc"}, take=-10)


# ---------------------------------------------------------------- L4
@query("l4_skip_take_orders", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 30 OFFSET 100
""")
def l4_skip(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(order={"o_totalprice": "desc"}, skip=100, take=30)


# ---------------------------------------------------------------- L5 cursor
@query("l5_cursor_orders", """
WITH c AS (SELECT o_orderdate AS cd, o_orderkey AS ck FROM orders WHERE o_orderkey = 1234)
SELECT o.* FROM orders o, c
WHERE o.o_orderdate > c.cd OR (o.o_orderdate = c.cd AND o.o_orderkey >= c.ck)
ORDER BY o.o_orderdate, o.o_orderkey LIMIT 20
""")
def l5_cursor(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(
        order={"o_orderdate": "asc"}, cursor={"o_orderkey": 1234}, take=20)


# ---------------------------------------------------------------- L6 full composition, N1, G10
@query("l6_find_many_composed_orders", """
WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM f)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM d WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 5
""")
def l6_composed(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(
        where={"o_orderstatus": "O"}, order={"o_totalprice": "desc"}, distinct=["o_custkey"], skip=5, take=50)


@query("n1_first_order_per_customer", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1
""")
def n1_first_per_customer(spark, sf):
    return cat_of(spark, sf).table("orders").find_many(distinct=["o_custkey"], order={"o_orderdate": "asc"})


@query("g10_distinct_part_by_brand", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
WHERE rn = 1
""")
def g10_distinct(spark, sf):
    return cat_of(spark, sf).table("part").find_many(distinct=["p_brand"], order={"p_retailprice": "desc"})


# ---------------------------------------------------------------- L7
@query("l7_find_first_orders", """
SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1
""")
def l7_find_first(spark, sf):
    return cat_of(spark, sf).table("orders").find_first_or_raise(
        where={"o_orderpriority": "1-URGENT"}, order={"o_totalprice": "desc"})


# ---------------------------------------------------------------- L2 relevance
@query("l2_relevance_documents", r"""
SELECT doc_id, lang FROM documents
ORDER BY len(list_intersect(['le', 'la', 'de', 'un'],
         list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')))) DESC, doc_id
LIMIT 20
""")
def l2_relevance(spark, sf):
    return cat_of(spark, sf).table("documents").find_many(
        order={"_relevance": {"fields": ["text"], "search": "le la de un", "sort": "desc"}},
        take=20, select=["doc_id", "lang"])


# ---------------------------------------------------------------- G1 G2 G3
@query("g1_count_where_orders", """
SELECT count(*) AS _all FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000
""")
def g1_count(spark, sf):
    return cat_of(spark, sf).table("orders").count(
        where={"o_orderstatus": "P", "o_totalprice": {"gt": 250000}})


@query("g2_count_select_documents_labels", """
SELECT count(*) AS _all, count(l.quality) AS quality, count(l.toxic) AS toxic, count(d.lang) AS lang
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def g2_count_select(spark, sf):
    return _doc_labels(spark, sf).table("doc_labels").count(
        select={"_all": True, "quality": True, "toxic": True, "lang": True})


@query("g2_count_empty_select", "SELECT count(*) AS _all FROM documents")
def g2_count_empty(spark, sf):
    return cat_of(spark, sf).table("documents").count(select={})


@query("g3_count_over_page_orders", """
SELECT count(*) AS _all FROM (
  SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 4900)
""")
def g3_count_page(spark, sf):
    return cat_of(spark, sf).table("orders").count(
        where={"o_orderstatus": "F"}, order={"o_orderkey": "asc"}, skip=4900, take=100)


# ---------------------------------------------------------------- G9
@query("g9_distinct_sorted_ids", "SELECT DISTINCT l_orderkey FROM lineitem ORDER BY l_orderkey")
def g9_distinct_sorted(spark, sf):
    from .ingest_jobs import distinct_sorted_ids
    return distinct_sorted_ids(cat_of(spark, sf).df("lineitem"), "l_orderkey")


# ---------------------------------------------------------------- J1 J2 J4
@query("j1_include_to_one_customer", """
SELECT o.o_orderkey, o.o_totalprice, c.c_name AS customer_name, c.c_mktsegment AS customer_segment
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
""")
def j1_include_one(spark, sf):
    df = cat_of(spark, sf).table("orders").find_many(
        include={"customer": {"where": {"c_acctbal": {"gt": 0}}}})
    return df.select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("customer_name"),
                     F.col("customer.c_mktsegment").alias("customer_segment"))


@query("j2_include_to_many_lineitems", """
SELECT o.o_orderkey, CAST(coalesce(a.n, 0) AS INTEGER) AS n_lineitems, coalesce(a.q, 0.0) AS sum_quantity,
       a.first_line AS first_linenumber
FROM orders o LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, min(l_linenumber) AS first_line
  FROM lineitem GROUP BY l_orderkey) a ON o.o_orderkey = a.l_orderkey
""")
def j2_include_many(spark, sf):
    df = cat_of(spark, sf).table("orders").find_many(include={"lineitems": {"order": {"l_linenumber": "asc"}}})
    return df.select(
        "o_orderkey", F.size("lineitems").alias("n_lineitems"),
        F.aggregate("lineitems", F.lit(0.0), lambda acc, x: acc + x["l_quantity"]).alias("sum_quantity"),
        F.try_element_at("lineitems", F.lit(1))["l_linenumber"].alias("first_linenumber"))


@query("j2_include_flat_lineitems", f"""
SELECT o.o_orderkey, o.o_orderstatus, l.l_linenumber AS lineitems_l_linenumber,
       l.l_quantity AS lineitems_l_quantity, l.l_partkey AS lineitems_l_partkey
FROM orders o LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey
""")
def j2_include_flat(spark, sf):
    cat = cat_of(spark, sf)
    df = cat.table("orders").include_flat(cat.df("orders"), "lineitems", {"where": {"l_returnflag": "R"}})
    return df.select("o_orderkey", "o_orderstatus", "lineitems_l_linenumber", "lineitems_l_quantity",
                     "lineitems_l_partkey")


@query("j3_n2_top2_lineitems_per_part", f"""
SELECT p.p_partkey, p.p_name, l.rn AS lineitems_rank, l.l_orderkey AS lineitems_l_orderkey,
       l.l_extendedprice AS lineitems_l_extendedprice
FROM part p LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, {LINEITEM_COLS}) AS rn
  FROM lineitem) l ON p.p_partkey = l.l_partkey AND l.rn > 1 AND l.rn <= 3
""")
def j3_n2_top(spark, sf):
    cat = cat_of(spark, sf)
    df = cat.table("part").include_flat(cat.df("part"), "lineitems",
                                        {"order": {"l_extendedprice": "desc"}, "skip": 1, "take": 2})
    return df.select("p_partkey", "p_name", "lineitems_rank", "lineitems_l_orderkey", "lineitems_l_extendedprice")


@query("j3_include_args_array_part", """
SELECT p.p_partkey, CAST(coalesce(a.n, 0) AS INTEGER) AS n_items, a.top_price
FROM part p LEFT JOIN (
  SELECT l_partkey, count(DISTINCT l_suppkey) AS n, max(l_extendedprice) AS top_price
  FROM lineitem WHERE l_quantity > 5 GROUP BY l_partkey) a ON p.p_partkey = a.l_partkey
""")
def j3_include_array(spark, sf):
    # distinct=l_suppkey inside each part keeps the highest-priced line per supplier
    df = cat_of(spark, sf).table("part").find_many(include={"lineitems": {
        "where": {"l_quantity": {"gt": 5}}, "order": {"l_extendedprice": "desc"}, "distinct": ["l_suppkey"]}})
    return df.select("p_partkey", F.size("lineitems").alias("n_items"),
                     F.try_element_at("lineitems", F.lit(1))["l_extendedprice"].alias("top_price"))


@query("j4_nested_include_chain", """
SELECT o.o_orderkey, c.c_name AS customer_name, n.n_name AS nation_name, r.r_name AS region_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def j4_nested(spark, sf):
    df = cat_of(spark, sf).table("orders").find_many(
        include={"customer": {"include": {"nation": {"include": {"region": True}}}}})
    return df.select("o_orderkey", F.col("customer.c_name").alias("customer_name"),
                     F.col("customer.nation.n_name").alias("nation_name"),
                     F.col("customer.nation.region.r_name").alias("region_name"))


# ---------------------------------------------------------------- J6 N:M
@query("j6_part_supplier_traversal", """
SELECT p.p_partkey, p.p_name, s.s_suppkey, s.s_name
FROM part p JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps ON p.p_partkey = ps.l_partkey
JOIN supplier s ON ps.l_suppkey = s.s_suppkey
""")
def j6_traversal(spark, sf):
    from ..operators.include import traverse
    cat = cat_of(spark, sf)
    return traverse(cat, "part", cat.df("part"), ["suppliers", "supplier"]).select("p_partkey", "p_name", "s_suppkey", "s_name")


# ---------------------------------------------------------------- J7 J8 J9
@query("j7_new_links_only", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
EXCEPT
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
""")
def j7_new_links(spark, sf):
    cat = cat_of(spark, sf)
    li = cat.df("lineitem")
    existing = li.where(F.col("l_shipdate") < F.lit(datetime(1998, 1, 1))).select("l_partkey", "l_suppkey").distinct()
    return mutate.new_links(existing, li.select("l_partkey", "l_suppkey"), ("l_partkey", "l_suppkey"))


@query("j8_resume_difference", """
SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def j8_resume(spark, sf):
    from .ingest_jobs import resume_difference
    cat = cat_of(spark, sf)
    return resume_difference(cat.df("documents").select("doc_id", "lang"), "doc_id",
                             [cat.df("labels").select("doc_id")])


@query("j9_q3_foreign_key_orphans", f"""
SELECT {LINEITEM_COLS} FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 10)
""")
def j9_orphans(spark, sf):
    from ..operators.quality import foreign_key_orphans
    cat = cat_of(spark, sf)
    return foreign_key_orphans(cat.df("lineitem"), cat.df("part").where("p_size > 10"),
                               ("l_partkey",), ("p_partkey",))


# ---------------------------------------------------------------- P7 partial schema
@query("p7_partial_columns_orders", """
SELECT o_orderkey, o_totalprice, o_orderdate, true AS required_is_not_null, true AS optional_is_nullable FROM orders
""")
def p7_partial(spark, sf):
    from ..operators.quality import partial
    cat = cat_of(spark, sf)
    out = partial(cat.df("orders"), include=["o_orderkey", "o_totalprice", "o_orderdate"],
                  required=["o_orderkey", "o_orderdate"], optional=["o_totalprice"])
    nullable = {f.name: f.nullable for f in out.schema.fields}
    return out.withColumn("required_is_not_null", F.lit(not (nullable["o_orderkey"] or nullable["o_orderdate"]))).withColumn(
        "optional_is_nullable", F.lit(nullable["o_totalprice"]))


# ---------------------------------------------------------------- S3 S4
@query("s3_existing_key_set_part", "SELECT DISTINCT p_partkey AS id FROM part")
def s3_existing(spark, sf):
    from ..sources.scan import existing_keys_from_table
    return existing_keys_from_table(spark, f"{sf}/part.parquet", "p_partkey")


@query("s4_model_scan_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s4_model_scan(spark, sf):
    from ..sources.scan import model_scan
    from pyspark.sql import types as T
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])
    return model_scan(spark, f"{sf}/orders.parquet", ModelSpec("orders", schema, key=("o_orderkey",)))


# ---------------------------------------------------------------- row order as a value
def _positions(df):
    """The rows' place in the order they come in (partitions in turn), as a column.

    The rows are checkpointed with their partition and place; the sizes of the
    partitions (one small row each) say where each begins, so no task sees them all."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    seen = (df.withColumn("__part", F.spark_partition_id())
            .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint())
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = seen.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = seen.join(F.broadcast(starts), "__part").withColumn("pos", (F.col("__before") + F.col("__place") + 1).cast("int"))
    return placed.select(*df.columns, "pos")


@query("l3_negative_take_positions_orders", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM (
  SELECT * FROM orders ORDER BY o_totalprice ASC, o_orderkey DESC LIMIT 300)
""")
def l3_positions(spark, sf):
    return _positions(cat_of(spark, sf).table("orders").find_many(order={"o_totalprice": "desc"}, take=-300)).select("o_orderkey", "pos")


@query("l4_skip_without_take_positions_orders", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM (
  SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 1000)
""")
def l4_positions(spark, sf):
    return _positions(cat_of(spark, sf).table("orders").find_many(order={"o_totalprice": "desc"}, skip=1000)).select("o_orderkey", "pos")


@query("l5_cursor_absent_or_filtered_orders", """
WITH c AS (SELECT o_totalprice AS cp, o_orderkey AS ck FROM orders WHERE o_orderkey = 1234)
SELECT 'filtered' AS tag, o.o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders o, c
WHERE o_orderstatus <> (SELECT o_orderstatus FROM orders WHERE o_orderkey = 1234) AND (o_totalprice, o_orderkey) >= (cp, ck)
""")
def l5_absent(spark, sf):
    t = cat_of(spark, sf).table("orders")
    status = t.df.where("o_orderkey = 1234").select("o_orderstatus").scalar()
    by = {"o_totalprice": "asc"}
    absent = t.find_many(order=by, cursor={"o_orderkey": -5})  # no such row: nothing
    filtered = t.find_many(where={"o_orderstatus": {"not": status}}, order=by, cursor={"o_orderkey": 1234})
    return _positions(filtered).select(F.lit("filtered").alias("tag"), "o_orderkey", "pos").unionByName(
        _positions(absent).select(F.lit("absent").alias("tag"), "o_orderkey", "pos"))


@query("l6_j1_ordered_page_with_include_orders", """
SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM (
  SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) JOIN customer ON c_custkey = o_custkey
""")
def l6_include_order(spark, sf):
    df = cat_of(spark, sf).table("orders").find_many(order={"o_totalprice": "desc"}, take=500, include={"customer": True})
    return _positions(df).select("o_orderkey", F.col("customer.c_name").alias("c_name"), "pos")


@query("l7_find_first_distinct_orders", """
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 3
""")
def l7_first_distinct(spark, sf):
    return cat_of(spark, sf).table("orders").find_first(order={"o_totalprice": "desc"}, distinct=["o_custkey"], skip=3).select("o_orderkey")


@query("w11_search_marks_part", """
SELECT p_partkey, p_name FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'bolt'])
""")
def w11_marks(spark, sf):
    cat = cat_of(spark, sf)
    t = cat.with_table("pm", cat.df("part").select("p_partkey", "p_name", F.regexp_replace("p_name", " ", "_").alias("marked"))).table("pm")
    return t.find_many(where={"marked": {"search": "bolt_RED"}}).select("p_partkey", "p_name")


@query("w16_w18_empty_lists_part", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [] ELSE [p_size, p_size + 1] END AS nums FROM part)
SELECT 'equals' AS tag, p_partkey FROM p WHERE len(nums) = 0
UNION ALL SELECT 'has_every', p_partkey FROM p
""")
def w16_empty(spark, sf):
    cat = cat_of(spark, sf)
    nums = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("p_size"), F.col("p_size") + 1))
    t = cat.with_table("pn", cat.df("part").select("p_partkey", nums.alias("nums"))).table("pn")
    return t.find_many(where={"nums": {"equals": []}}).select(F.lit("equals").alias("tag"), "p_partkey").unionByName(
        t.find_many(where={"nums": {"has_every": []}}).select(F.lit("has_every").alias("tag"), "p_partkey"))
