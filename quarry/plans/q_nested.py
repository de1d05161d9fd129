"""Checked queries for nested writes (M9–M13): rows created and updated together with their related rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FIXTURE_MODELS
from .registry import fixture_catalog, query


def long_form(cat, tables: dict[str, list[str]]) -> DataFrame:
    """All tables' rows as (tbl, row): the named columns as text, in order."""
    parts = [cat.df(t).select(F.lit(t).alias("tbl"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).alias("row")) for t, cols in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sql_row(*cols: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in cols) + ") AS row"


TABLES = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_name", "c_nationkey"],
          "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
          "part_supplier": ["l_partkey", "l_suppkey"], "part": ["p_partkey", "p_name", "p_size"]}


def nested_orders(spark, sf):
    """Every third order again under a new key, with a customer that may be new, its lines, and their suppliers that may be new."""
    cat = fixture_catalog(spark, sf)
    cat = cat.with_table("part_supplier", cat.df("part_supplier"))
    known = F.col("l_suppkey") % 2 == 0
    supplier = F.struct(
        F.when(known, F.struct(F.col("l_suppkey").alias("s_suppkey"))).alias("connect"),
        F.when(~known, F.struct(F.struct((F.col("l_suppkey") + 500000).alias("s_suppkey")).alias("where"),
                                F.struct(F.concat(F.lit("New#"), F.col("l_suppkey").cast("string")).alias("s_name"),
                                         F.struct(F.struct((F.col("l_suppkey") % 5).cast("int").alias("n_nationkey")).alias("connect")).alias("nation")).alias("create"))).alias("connect_or_create"))
    line = F.struct("l_linenumber", "l_quantity", "l_extendedprice", F.struct(F.struct(F.col("l_partkey").alias("p_partkey")).alias("connect")).alias("part"), supplier.alias("supplier"))
    lines = cat.df("lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(line).alias("create"))
    old = cat.df("orders").where("o_orderkey % 3 = 0")
    custkey = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 700000)
    customer = F.struct(F.struct(F.struct(custkey.alias("c_custkey")).alias("where"), F.struct(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("c_name"), F.lit(1).alias("c_nationkey")).alias("create")).alias("connect_or_create"))
    data = old.join(lines, old["o_orderkey"] == lines["k"], "left").select(
        (F.col("o_orderkey") + 90000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice", customer.alias("customer"), F.struct("create").alias("lineitems"))
    return cat.table("orders").create(data).catalog


@query("m9_m10_m13_nested_create_orders", f"""
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT o_orderkey + 90000000 AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 700000 END AS c, o_custkey FROM o),
l AS (SELECT l.l_orderkey + 90000000 AS k, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE l_suppkey + 500000 END AS s, l_suppkey FROM lineitem l JOIN o ON o.o_orderkey = l.l_orderkey)
SELECT 'orders' AS tbl, {sql_row('o_orderkey', 'o_custkey', 'o_orderstatus')} FROM orders UNION ALL SELECT 'orders', {sql_row('o_orderkey', 'c', "'N'")} FROM n
UNION ALL SELECT 'customer', {sql_row('c_custkey', 'c_name', 'c_nationkey')} FROM customer
UNION ALL SELECT DISTINCT 'customer', {sql_row('c', "'Customer#' || o_custkey", '1')} FROM n WHERE c NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', {sql_row('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} FROM lineitem UNION ALL SELECT 'lineitem', {sql_row('k', 'l_linenumber', 'l_partkey', 's')} FROM l
UNION ALL SELECT 'supplier', {sql_row('s_suppkey', 's_name', 's_nationkey')} FROM supplier
UNION ALL SELECT DISTINCT 'supplier', {sql_row('s', "'New#' || l_suppkey", 'l_suppkey % 5')} FROM l WHERE l_suppkey % 2 = 1
""")
def m9_nested_create(spark, sf):
    return long_form(nested_orders(spark, sf), {t: TABLES[t] for t in ("orders", "customer", "lineitem", "supplier")})


@query("m9_m11_m12_nested_update_parts", f"""
WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
sets AS (SELECT p_partkey AS l_partkey, unnest(CASE WHEN p_partkey % 8 = 0 THEN [] ELSE [1, 1 + p_partkey % 7] END) AS l_suppkey FROM part WHERE p_partkey % 4 = 0),
kept AS (SELECT * FROM ps WHERE l_partkey % 4 <> 0 AND NOT (l_partkey % 4 = 1 AND l_suppkey % 2 = 0)),
added AS (SELECT DISTINCT l_partkey, l_suppkey FROM sets UNION SELECT p_partkey, 3 FROM part WHERE p_partkey % 4 = 2 UNION SELECT p_partkey, 800000 + p_partkey % 3 FROM part WHERE p_partkey % 4 = 3)
SELECT 'part' AS tbl, {sql_row('p_partkey', "CASE WHEN p_partkey % 4 = 1 THEN p_name || ' cut' ELSE p_name END", 'p_size')} FROM part
UNION ALL SELECT 'part_supplier', {sql_row('l_partkey', 'l_suppkey')} FROM (SELECT * FROM kept UNION SELECT * FROM added)
UNION ALL SELECT 'supplier', {sql_row('s_suppkey', 's_name', 's_nationkey')} FROM supplier
UNION ALL SELECT DISTINCT 'supplier', {sql_row('800000 + p_partkey % 3', "'Linked#' || (p_partkey % 3)", 'NULL')} FROM part WHERE p_partkey % 4 = 3
""")
def m9_nested_update(spark, sf):
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    cat = fixture_catalog(spark, sf)
    links = cat.df("part_supplier").checkpoint()  # distinct pairs of all lines, made once
    cat = cat.with_table("part_supplier", links)
    k, four = F.col("p_partkey"), F.col("p_partkey") % 4
    suppkey = links.schema["l_suppkey"].dataType.simpleString()

    def key(c):
        return F.struct(c.cast(suppkey).alias("l_suppkey"))

    linked = links.where("l_suppkey % 2 = 0 AND l_partkey % 4 = 1").groupBy(F.col("l_partkey").alias("k")).agg(F.collect_list(F.struct("l_suppkey")).alias("cut"))
    new = (800000 + k % 3).cast(suppkey)
    made = F.struct(F.struct(F.struct(F.struct(new.alias("s_suppkey")).alias("where"), F.struct(F.concat(F.lit("Linked#"), (k % 3).cast("string")).alias("s_name")).alias("create")).alias("connect_or_create")).alias("supplier"))
    suppliers = F.struct(
        F.when(four == 0, F.when(k % 8 == 0, F.array().cast(f"array<struct<l_suppkey:{suppkey}>>")).otherwise(F.array(key(F.lit(1)), key(1 + k % 7)))).alias("set"),
        F.when(four == 1, F.coalesce("cut", F.array().cast(f"array<struct<l_suppkey:{suppkey}>>"))).alias("disconnect"),
        F.when(four == 2, F.array(key(F.lit(3)))).alias("connect"),
        F.when(four == 3, F.array(made)).alias("create"))
    part = cat.df("part")
    data = part.join(linked, part["p_partkey"] == linked["k"], "left").select("p_partkey", F.when(four == 1, F.concat("p_name", F.lit(" cut"))).alias("p_name"), suppliers.alias("suppliers"))
    return long_form(cat.table("part").write(data, "update").catalog, {t: TABLES[t] for t in ("part", "part_supplier", "supplier")})
