"""Checked queries for set-based mutations (M1–M14, M17, N6, P8) and the
versioned write-back (K7).  Change sets are derived from the driver's tables;
each query returns the table after the mutation (or the affected count)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalog
from ..model import FIXTURE_MODELS, ModelSpec
from ..operators import mutate as M
from .registry import fixture_catalog, query

PART_COLS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


def cat_of(spark, sf) -> Catalog:
    return fixture_catalog(spark, sf)


# ---------------------------------------------------------------- M1 insert with defaults
@query("m1_insert_with_defaults_part", f"""
SELECT {PART_COLS} FROM part
UNION ALL
SELECT p_partkey + 1000000, p_name, p_brand, p_type, 0, p_retailprice FROM part WHERE p_type = 'SMALL'
""")
def m1_insert(spark, sf):
    cat = cat_of(spark, sf)
    part = cat.df("part")
    new = part.where("p_type = 'SMALL'").select((F.col("p_partkey") + 1000000).alias("p_partkey"),
                                                "p_name", "p_brand", "p_type", "p_retailprice")
    return M.insert(part, new, FIXTURE_MODELS["part"], check=True)


# ---------------------------------------------------------------- M2 create_many skip duplicates
@query("m2_create_many_skip_duplicates_customer", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, 'first', c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def m2_create_many(spark, sf):
    cat = cat_of(spark, sf)
    cust = cat.df("customer")
    # existing keys and in-batch repeats, of which the first by seq stays
    fresh = cust.withColumn("c_custkey", F.col("c_custkey") + 1000000)
    batch = (cust.withColumn("seq", F.lit(0)).unionByName(fresh.withColumn("c_name", F.lit("second")).withColumn("seq", F.lit(2)))
             .unionByName(fresh.withColumn("c_name", F.lit("first")).withColumn("seq", F.lit(1))))
    return M.insert_many(cust, batch, FIXTURE_MODELS["customer"], skip_duplicates=True, seq="seq").table


# ---------------------------------------------------------------- M3 / P8 / N6 upsert
@query("m3_p8_n6_upsert_part_shifted_keys", f"""
WITH ch AS (
  SELECT p_partkey + 1000 AS p_partkey,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name || ' v2' END AS p_name,
         p_brand, p_type, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS p_size,
         p_retailprice + 1 AS p_retailprice
  FROM part)
SELECT coalesce(o.p_partkey, c.p_partkey) AS p_partkey,
       coalesce(c.p_name, o.p_name) AS p_name, coalesce(c.p_brand, o.p_brand) AS p_brand,
       coalesce(c.p_type, o.p_type) AS p_type,
       CASE WHEN o.p_partkey IS NULL THEN coalesce(c.p_size, 0) ELSE coalesce(c.p_size, o.p_size) END AS p_size,
       coalesce(c.p_retailprice, o.p_retailprice) AS p_retailprice
FROM part o FULL JOIN ch c ON o.p_partkey = c.p_partkey
""")
def m3_upsert(spark, sf):
    cat = cat_of(spark, sf)
    part = cat.df("part")
    k, s = F.col("p_partkey"), F.col("p_size")
    ch = part.select((k + 1000).alias("p_partkey"),
                     F.when(s % 5 == 0, F.lit(None)).otherwise(F.concat("p_name", F.lit(" v2"))).alias("p_name"),
                     "p_brand", "p_type", F.when(s % 7 == 0, F.lit(None)).otherwise(s).alias("p_size"),
                     (F.col("p_retailprice") + 1).alias("p_retailprice"),
                     F.lit(1).alias("seq"))
    # repeat every change with an older sequence number: the last write must win
    older = ch.withColumn("p_name", F.lit("stale")).withColumn("seq", F.lit(0))
    return M.upsert(part, ch.unionByName(older), FIXTURE_MODELS["part"], seq="seq").table


@query("m3_k7_bucketed_upsert_customer", """
WITH ch AS (SELECT c_custkey, c_name || '!' AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 50 = 7
  UNION ALL SELECT c_custkey + 5000000, 'new', NULL FROM customer WHERE c_custkey % 100 = 3)
SELECT coalesce(c.c_custkey, ch.c_custkey) AS c_custkey, coalesce(ch.c_name, c.c_name) AS c_name, c.c_nationkey, coalesce(ch.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment
FROM customer c FULL JOIN ch USING (c_custkey)
WHERE coalesce(c.c_custkey, ch.c_custkey) % 997 <> 5
""")
def m3_bucketed(spark, sf):
    """Upsert and delete on a stored table: the touched groups are read without a shuffle and written alone."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.bucketed import BucketedTable
    customer = cat_of(spark, sf).df("customer")
    table = BucketedTable(spark, f"{checkpoint_dir(spark)}/bucketed-{uuid.uuid4().hex}", FIXTURE_MODELS["customer"])
    table.create(customer, buckets=4, groups=8)
    k = F.col("c_custkey")
    changed = customer.where(k % 50 == 7).select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(k % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("seq"))
    new = customer.where(k % 100 == 3).select((k + 5000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(1).alias("seq"))
    stale = new.withColumn("c_name", F.lit("stale")).withColumn("seq", F.lit(0))
    table.upsert(changed.unionByName(new).unionByName(stale), seq="seq")
    table.delete(customer.unionByName(new.select("c_custkey"), allowMissingColumns=True).where(k % 997 == 5).select("c_custkey"))
    return table.read()


@query("w24_s3_clustered_lookup_orders", """
SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT c_custkey * 4 FROM customer) OR o_orderkey % 1000 = 1
""")
def w24_lookup(spark, sf):
    """Look-ups by key in a table that was published in ranges of its key: by a table of keys, and by values."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources import sinks
    cat = cat_of(spark, sf)
    root = f"{checkpoint_dir(spark)}/clustered-{uuid.uuid4().hex}"
    sinks.publish(spark, root, {"orders": cat.df("orders")}, models=FIXTURE_MODELS)
    stored = cat.with_table("orders", sinks.read_table(spark, root, "orders", cat.df("orders").schema)).table("orders")
    keys = cat.df("customer").select((F.col("c_custkey") * 4).alias("k"))
    by_table = stored.find_many(where={"o_orderkey": {"in": keys}})
    return by_table.unionByName(stored.df.where("o_orderkey % 1000 = 1")).distinct()


@query("n6_last_event_per_user", """
SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def n6_last_per_user(spark, sf):
    ev = cat_of(spark, sf).df("events").select("user_id", "event_id", "event_type", "ts",
                                               F.col("event_id").alias("seq"))
    return M.last_per_key(ev, ("user_id",), "seq")


# ---------------------------------------------------------------- M4 M6 update_many
@query("m4_m6_update_many_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1996-01-01' THEN 0.0 ELSE l_discount END AS l_discount,
  CASE WHEN l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1996-01-01' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
FROM lineitem
""")
def m4_update_many(spark, sf):
    t = cat_of(spark, sf).table("lineitem")
    res = t.update_many({"l_discount": {"set": 0.0}, "l_quantity": {"increment": 1}},
                        where={"l_returnflag": "R", "l_shipdate": {"lt": __import__("datetime").datetime(1996, 1, 1)}})
    return res.table.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity")


@query("m4_update_count_lineitem", """
SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1996-01-01'
""")
def m4_update_count(spark, sf):
    t = cat_of(spark, sf).table("lineitem")
    return t.update_many({"l_discount": {"set": 0.0}},
                         where={"l_returnflag": "R",
                                "l_shipdate": {"lt": __import__("datetime").datetime(1996, 1, 1)}}).count()


@query("m6_atomic_ops_part_size", """
SELECT p_partkey,
  CASE WHEN p_type = 'PROMO' THEN p_size + 3
       WHEN p_type = 'SMALL' THEN p_size - 2
       WHEN p_type = 'LARGE' THEN p_size * 2
       WHEN p_type = 'MEDIUM' THEN CAST(trunc(p_size / 3) AS INTEGER)
       ELSE p_size END AS p_size,
  CASE WHEN p_type = 'ECONOMY' THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice
FROM part
""")
def m6_atomic(spark, sf):
    cat = cat_of(spark, sf)
    for ptype, op in (("PROMO", {"increment": 3}), ("SMALL", {"decrement": 2}), ("LARGE", {"multiply": 2}),
                      ("MEDIUM", {"divide": 3})):
        cat = cat.with_table("part", cat.table("part").update_many({"p_size": op}, where={"p_type": ptype}).table)
    cat = cat.with_table("part", cat.table("part").update_many({"p_retailprice": {"multiply": 2}},
                                                                where={"p_type": "ECONOMY"}).table)
    return cat.df("part").select("p_partkey", "p_size", "p_retailprice")


# ---------------------------------------------------------------- M5 update by unique key / change table
@query("m5_update_unique_and_from_table_part", f"""
SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'renamed' ELSE p_name END AS p_name, p_brand, p_type, p_size,
       CASE WHEN p_size > 45 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice
FROM part
""")
def m5_update_unique(spark, sf):
    cat = cat_of(spark, sf)
    t = cat.table("part")
    cat = cat.with_table("part", t.update({"p_name": "renamed"}, where={"p_partkey": 7}).table)
    cat = cat.with_table("part", cat.table("part").update({"p_name": "never"}, where={"p_partkey": -1}).table)
    changes = cat_of(spark, sf).df("part").where("p_size > 45").select(
        "p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"))
    return M.update_from(cat.df("part"), changes, ("p_partkey",)).table


# ---------------------------------------------------------------- M7 M8 delete
@query("m7_delete_many_orders", """
SELECT * FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000)
""")
def m7_delete_many(spark, sf):
    return cat_of(spark, sf).table("orders").delete_many(
        where={"o_orderstatus": "P", "o_totalprice": {"lt": 100000}}).table


@query("m8_delete_unique_and_keys_part", f"""
SELECT {PART_COLS} FROM part WHERE p_partkey <> 7 AND p_size <> 1
""")
def m8_delete(spark, sf):
    cat = cat_of(spark, sf)
    cat = cat.with_table("part", cat.table("part").delete(where={"p_partkey": 7}).table)
    keys = cat_of(spark, sf).df("part").where("p_size = 1").select("p_partkey")
    return M.delete_keys(cat.df("part"), keys, ("p_partkey",)).table


# ---------------------------------------------------------------- M9 M11 M12 M10 links
LINK = ("l_partkey", "l_suppkey")


@query("m9_connect_new_links", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
UNION
SELECT p_partkey, (p_partkey * 7) % 100 FROM part
""")
def m9_connect(spark, sf):
    cat = cat_of(spark, sf)
    pairs = cat.df("part").select(F.col("p_partkey").alias("l_partkey"),
                                  ((F.col("p_partkey") * 7) % 100).alias("l_suppkey"))
    return M.connect(cat.df("part_supplier"), pairs.unionByName(pairs), LINK).table


@query("m11_disconnect_links", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey >= 10
""")
def m11_disconnect(spark, sf):
    cat = cat_of(spark, sf)
    pairs = cat.df("part_supplier").where("l_suppkey < 10")
    return M.disconnect(cat.df("part_supplier"), pairs, LINK).table


@query("m12_set_links_part", """
SELECT DISTINCT l.l_partkey, l.l_suppkey FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size <= 45
UNION ALL
SELECT p_partkey, 0 FROM part WHERE p_size > 45
""")
def m12_set_links(spark, sf):
    cat = cat_of(spark, sf)
    pairs = cat.df("part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"),
                                                       F.lit(0).cast("bigint").alias("l_suppkey"))
    return M.set_links(cat.df("part_supplier"), pairs, ("l_partkey",), LINK).table


@query("m10_connect_or_create_supplier", """
SELECT s_suppkey, s_name, NULL::BIGINT AS l_partkey FROM supplier
UNION ALL
SELECT DISTINCT (p_partkey % 50) + 100000, 'Supplier#new' || (p_partkey % 50), NULL FROM part WHERE p_size = 50
UNION ALL
SELECT l_suppkey, NULL, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem UNION SELECT (p_partkey % 50) + 100000, p_partkey FROM part WHERE p_size = 50)
""")
def m10_connect_or_create(spark, sf):
    cat = cat_of(spark, sf)
    wanted = cat.df("part").where("p_size = 50").select(
        ((F.col("p_partkey") % 50) + 100000).alias("s_suppkey"),
        F.concat(F.lit("Supplier#new"), (F.col("p_partkey") % 50).cast("string")).alias("s_name"),
        F.col("p_partkey").alias("l_partkey"))
    sup_res, link_res = M.connect_or_create(
        cat.df("supplier"), wanted.select("s_suppkey", "s_name"), ModelSpec("supplier", key=("s_suppkey",)),
        cat.df("part_supplier"), wanted.select("l_partkey", F.col("s_suppkey").alias("l_suppkey")), LINK)
    links = link_res.table.select(F.col("l_suppkey").alias("s_suppkey"), F.lit(None).cast("string").alias("s_name"), "l_partkey")
    return sup_res.table.select("s_suppkey", "s_name", F.lit(None).cast("bigint").alias("l_partkey")).unionByName(links)


# ---------------------------------------------------------------- M13 nested create
@query("m13_nested_create_orders_lineitems", """
SELECT 'orders' AS tbl, o_orderkey AS k, o_totalprice AS v FROM orders
UNION ALL SELECT 'orders', o_orderkey + 10000000, o_totalprice FROM orders
UNION ALL SELECT 'lineitem', l_orderkey, l_extendedprice FROM lineitem
UNION ALL SELECT 'lineitem', l_orderkey + 10000000, l_extendedprice FROM lineitem
""")
def m13_nested_create(spark, sf):
    cat = cat_of(spark, sf)
    o, li = cat.df("orders"), cat.df("lineitem")
    new_o = o.withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
    new_l = li.withColumn("l_orderkey", F.col("l_orderkey") + 10000000)
    orders2, lines2 = M.nested_create(o, new_o, FIXTURE_MODELS["orders"], li, new_l, FIXTURE_MODELS["lineitem"],
                                      foreign_key=("l_orderkey",))
    return (orders2.select(F.lit("orders").alias("tbl"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
            .unionByName(lines2.select(F.lit("lineitem").alias("tbl"), F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))))


# ---------------------------------------------------------------- M14 list set / push
@query("m14_list_set_push_part", """
SELECT p_partkey,
  CASE WHEN p_size > 40 THEN list_concat(string_split(p_name, ' '), ['x', 'y'])
       WHEN p_size < 3 THEN ['a']
       ELSE string_split(p_name, ' ') END AS words
FROM part
""")
def m14_lists(spark, sf):
    cat = cat_of(spark, sf)
    cat = cat.with_table("pw", cat.df("part").select("p_partkey", "p_size", F.split("p_name", " ").alias("words")))
    t = cat.table("pw")
    cat = cat.with_table("pw", t.update_many({"words": {"push": ["x", "y"]}}, where={"p_size": {"gt": 40}}).table)
    cat = cat.with_table("pw", cat.table("pw").update_many({"words": {"set": ["a"]}}, where={"p_size": {"lt": 3}}).table)
    return cat.df("pw").select("p_partkey", "words")


# ---------------------------------------------------------------- M17 batch + K7 versioned publish
@query("m17_batch_of_mutations_part", f"""
SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_type = 'PROMO' THEN p_size + 1 ELSE p_size END AS p_size,
       p_retailprice
FROM part WHERE NOT (CASE WHEN p_type = 'PROMO' THEN p_size + 1 ELSE p_size END > 49)
""")
def m17_batch(spark, sf):
    cat = cat_of(spark, sf)
    steps = [("part", lambda c: c.table("part").update_many({"p_size": {"increment": 1}}, where={"p_type": "PROMO"}).table),
             ("part", lambda c: c.table("part").delete_many(where={"p_size": {"gt": 49}}).table)]
    out, touched = M.apply_batch(cat, steps)
    # all touched tables become visible by one manifest
    from ..session import checkpoint_dir
    from ..sources import sinks
    import uuid
    root = f"{checkpoint_dir(spark)}/batch-{uuid.uuid4().hex}"
    sinks.publish(spark, root, {name: out.df(name) for name in touched})
    return sinks.read_table(spark, root, "part")


@query("k7_versioned_write_back_part", f"""
SELECT p_partkey, p_name, p_brand, p_type, p_size + 1 AS p_size, p_retailprice FROM part
""")
def k7_write_back(spark, sf):
    from ..session import checkpoint_dir
    from ..sources import sinks
    import uuid
    root = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    cat = cat_of(spark, sf)
    sinks.publish(spark, root, {"part": cat.df("part")})
    current = sinks.read_table(spark, root, "part")
    updated = current.withColumn("p_size", F.col("p_size") + 1)
    sinks.publish(spark, root, {"part": updated})   # new version written beside the one read
    return sinks.read_table(spark, root, "part")


# ---------------------------------------------------------------- create / update data, exact division, empty set, nested delete
@query("m3_upsert_create_and_update_part", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'updated' ELSE p_name END AS p_name, p_size FROM part
UNION ALL SELECT p_partkey + 10000000, 'created', 1 FROM part WHERE p_partkey % 2 = 0
""")
def m3_create_update(spark, sf):
    part = cat_of(spark, sf).df("part")
    keys = part.where("p_partkey % 2 = 0").select("p_partkey")
    both = keys.unionByName(keys.select((F.col("p_partkey") + 10000000).alias("p_partkey")))
    res = M.upsert(part, both.withColumn("p_name", F.lit("updated")), FIXTURE_MODELS["part"],
                   create=both.withColumn("p_name", F.lit("created")).withColumn("p_size", F.lit(1)))
    return res.table.select("p_partkey", "p_name", "p_size")


@query("m6_exact_division_orders", """
SELECT o_orderkey, (o_orderkey * 1000000000 + 9007199254740993 + o_custkey) // 3 AS big,
  -((o_orderkey * 1000000000 + 9007199254740993) // 7) AS negative FROM orders
""")
def m6_exact(spark, sf):
    o = cat_of(spark, sf).df("orders").select("o_orderkey", (F.col("o_orderkey") * 1000000000 + 9007199254740993 + F.col("o_custkey")).alias("big"),
                                              (-(F.col("o_orderkey") * 1000000000 + 9007199254740993)).alias("negative"))
    return M.update_where(o, {"big": {"divide": 3}, "negative": {"divide": 7}}, None).table


@query("m12_set_links_to_nothing_part", """
SELECT DISTINCT l.l_partkey, l.l_suppkey FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size <= 45
UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size > 48
""")
def m12_set_nothing(spark, sf):
    cat = cat_of(spark, sf)
    named = cat.df("part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    pairs = named.where("p_size > 48").select("l_partkey", F.lit(0).cast("bigint").alias("l_suppkey"))
    return M.set_links(cat.df("part_supplier"), pairs, ("l_partkey",), LINK, parents=named).table


@query("m11_nested_delete_suppliers", """
SELECT 'supplier' AS tbl, s_suppkey AS a, 0 AS b FROM supplier WHERE s_suppkey % 10 <> 0
UNION ALL SELECT DISTINCT 'link', l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 10 <> 0
""")
def m11_nested_delete(spark, sf):
    cat = cat_of(spark, sf)
    gone = cat.df("supplier").where("s_suppkey % 10 = 0").select("s_suppkey")
    rows, links = M.nested_delete(cat.df("supplier"), gone, ("s_suppkey",), cat.df("part_supplier"), ("l_suppkey",))
    return rows.table.select(F.lit("supplier").alias("tbl"), F.col("s_suppkey").alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(
        links.table.select(F.lit("link").alias("tbl"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("m5_update_with_include_orders", """
SELECT o_orderkey, 1.5 AS o_totalprice, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 1234
""")
def m5_include(spark, sf):
    res = cat_of(spark, sf).table("orders").update({"o_totalprice": 1.5}, where={"o_orderkey": 1234}, include={"customer": True})
    return res.affected.select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("c_name"))
