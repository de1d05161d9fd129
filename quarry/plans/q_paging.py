"""Checked queries for paging at size: large takes, hot parents, and cursors inside includes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import read as R
from .registry import fixture_catalog, query


@query("l6_l3_large_take_lineitem", """
SELECT rank - 10 AS pos, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rank FROM lineitem)
WHERE rank > 10 AND rank <= 30010
""")
def l6_large_take(spark, sf):
    """``take=30000, skip=10`` with each row's place: a cutoff by a quantile sketch, and a slice of range partitions."""
    df = fixture_catalog(spark, sf).df("lineitem")
    keys = R.sort_keys(df, [{"l_extendedprice": "desc"}], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    rows = R.slice_rows(R.first_rows(df, keys, 30010), R.as_sort(keys), 10, 30000, position="pos")
    return rows.select("pos", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("l6_g3_large_take_backwards_orders", """
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank > 5 AND rank <= 12005
""")
def l6_backwards(spark, sf):
    return fixture_catalog(spark, sf).table("orders").find_many(order=[{"o_totalprice": "asc"}], take=-12000, skip=5, select=["o_orderkey", "o_totalprice"])


@query("l9_large_take_of_groups_lineitem", """
WITH g AS (SELECT l_orderkey, l_partkey, count(l_linenumber) AS _count_l_linenumber FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_partkey, _count_l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_partkey DESC, l_orderkey) AS rank FROM g)
WHERE rank > 100 AND rank <= 25100
""")
def l9_large_take(spark, sf):
    out = fixture_catalog(spark, sf).table("lineitem").group_by(["l_orderkey", "l_partkey"], count={"l_linenumber": True}, order=[{"l_partkey": "desc"}], take=25000, skip=100)
    return out.select("l_orderkey", "l_partkey", F.col(out.columns[-1]).alias("_count_l_linenumber"))


HOT = "CASE WHEN l_partkey % 10 < 9 THEN 1 ELSE l_orderkey END"


def hot_lines(spark, sf):
    """The catalogue with nine tenths of the lines under one order."""
    cat = fixture_catalog(spark, sf)
    return cat.with_table("lineitem", cat.df("lineitem").withColumn("l_line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
                          .withColumn("l_orderkey", F.expr(HOT)))


@query("j2_n2_hot_parent_ranks", f"""
SELECT o_orderkey, rank, l_partkey, l_line FROM orders JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_line, l_partkey, l_suppkey) AS rank
  FROM (SELECT {HOT} AS l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_orderkey * 10 + l_linenumber AS l_line FROM lineitem)) ON l_orderkey = o_orderkey
""")
def j2_hot_ranks(spark, sf):
    cat = hot_lines(spark, sf)
    order = [{"l_extendedprice": "desc"}, {"l_line": "asc"}, {"l_partkey": "asc"}, {"l_suppkey": "asc"}]
    df = cat.table("orders").include_flat(cat.df("orders"), "lineitems", {"order": order}).where("lineitems_rank IS NOT NULL")
    return df.select("o_orderkey", F.col("lineitems_rank").alias("rank"), F.col("lineitems_l_partkey").alias("l_partkey"), F.col("lineitems_l_line").alias("l_line"))


@query("j2_hot_parent_in_chunks", f"""
SELECT o_orderkey, coalesce((rank - 1) // 500, 0)::INTEGER AS chunk, count(l_line) AS n, min(l_line) AS first_line, sum(l_line * ((rank - 1) % 500 + 1))::BIGINT AS weighted
FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_line, l_partkey, l_suppkey) AS rank
  FROM (SELECT {HOT} AS l_orderkey, l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS l_line FROM lineitem)) ON l_orderkey = o_orderkey
GROUP BY ALL
""")
def j2_hot_chunks(spark, sf):
    from ..operators.include import include_chunks
    cat = hot_lines(spark, sf)
    args = {"order": [{"l_line": "asc"}, {"l_partkey": "asc"}, {"l_suppkey": "asc"}]}
    df = include_chunks(cat, "orders", cat.df("orders"), "lineitems", args, size=500)
    lines = F.transform("lineitems", lambda x: x["l_line"])
    weighted = F.aggregate(F.transform(lines, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.select("o_orderkey", "chunk", F.size(lines).cast("long").alias("n"), F.array_min(lines).alias("first_line"), F.when(F.size(lines) > 0, weighted).alias("weighted"))


@query("j3_n2_include_cursor_both_ways", """
WITH o AS (SELECT *, o_totalprice >= (SELECT o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) AS ge,
  o_totalprice <= (SELECT o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) AS le FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS pos FROM o WHERE ge),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS back FROM o WHERE le),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS pos FROM b WHERE back > 1 AND back <= 3)
SELECT 'forward' AS kind, c_custkey, (pos - 2)::INTEGER AS pos, o_orderkey FROM customer JOIN f ON o_custkey = c_custkey WHERE pos > 1 AND pos <= 3
UNION ALL SELECT 'backward', c_custkey, (pos - 1)::INTEGER, o_orderkey FROM customer JOIN c ON o_custkey = c_custkey
""")
def j3_cursor(spark, sf):
    """Two orders of each customer after the cursor and two before it; the cursor's own row may fail the filter, and one that names no row gives nothing."""
    cat = fixture_catalog(spark, sf)
    start = cat.df("orders").agg(F.min("o_orderkey")).first()[0]
    base = {"where": {"o_orderstatus": {"not": "P"}}, "order": [{"o_totalprice": "asc"}], "skip": 1}

    def read(kind: str, **args) -> DataFrame:
        df = cat.table("customer").find_many(include={"orders": base | args})
        return df.select(F.lit(kind).alias("kind"), "c_custkey", F.posexplode("orders").alias("pos", "o")).select("kind", "c_custkey", "pos", F.col("o.o_orderkey").alias("o_orderkey"))

    parts = [read("forward", cursor={"o_orderkey": start}, take=2), read("backward", cursor={"o_orderkey": start}, take=-2), read("none", cursor={"o_orderkey": -1}, take=2)]
    return reduce(DataFrame.unionByName, parts)


@query("w11_l2_inverted_index_documents", r"""
WITH t AS (SELECT doc_id, lang, source, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents),
s AS (SELECT doc_id, lang, source, len(list_filter(['le', 'la', 'the', 'que'], lambda x: list_contains(w, x))) AS score FROM t)
SELECT 'some' AS kind, doc_id, NULL AS lang, score::INTEGER AS score FROM s WHERE score > 0
UNION ALL SELECT 'all', doc_id, lang, 2 FROM t WHERE list_has_all(w, ['le', 'la']) AND source <> 'src1'
""")
def w11_index(spark, sf):
    """Search and relevance from an index of all texts, built in two segments; the rows' other filters go on as usual."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.text_index import TextIndex
    documents = fixture_catalog(spark, sf).table("documents")
    index = TextIndex(spark, f"{checkpoint_dir(spark)}/text-index-{uuid.uuid4().hex}")
    index.add(documents.df.where("doc_id % 3 <> 0"), "doc_id", "text")
    index.add(documents.df.where("doc_id % 3 = 0"), "doc_id", "text")
    some = index.scores("le la the que").select(F.lit("some").alias("kind"), F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "score")
    both = documents.search(index, "La le!", where={"source": {"not": "src1"}})
    return some.unionByName(both.select(F.lit("all").alias("kind"), "doc_id", "lang", F.col("_relevance").alias("score")))
