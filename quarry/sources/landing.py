"""Landing payloads derived from the driver's tables.

The catalogue jobs consume raw JSON bodies landed per id (store details,
stats, paged child lists, id-list pages).  For checks and benches these are
derived here from the driver's tables with Spark, so their volume grows with
the tables: parent = ``part``, its suppliers = developers, child pages =
``conversations`` (``conv_id`` = parent id, ``turn`` + 1 = page number, one
child per line of text), id-list pages = ``orders`` keys.

Each body deliberately mixes loose shapes (numbers as text, falsy values,
HTML, damaged JSON, wrong nesting) by simple rules on the row's own columns,
so the DuckDB twins can state the expected normalised values directly.
Bodies are built as SQL expressions (one ``selectExpr``).
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.clean import q
from ..session import checkpoint_dir

RUN_TS = "2024-06-01T12:00:00"  # fixed ingest time used by the checked queries
NEWLINE = "\n"
PAGE_SIZE = 50  # ids on a page of the id list


def landed(*key: str):
    """Land a fixture's bodies once per catalogue: written to the shared folder, dealt by ``key``, and read back as files."""
    def deco(build):
        @functools.wraps(build)
        def read(cat: Catalog) -> DataFrame:
            name = build.__name__
            if name not in cat.landed:
                bodies = build(cat)
                path = f"{checkpoint_dir(cat.spark)}/landing-{name}-{uuid.uuid4().hex[:12]}"
                n = max(cat.spark.sparkContext.defaultParallelism, int(cat.spark.conf.get("spark.sql.shuffle.partitions")))
                bodies.repartition(n, *key).write.parquet(path)
                cat.landed[name] = cat.spark.read.schema(bodies.schema).parquet(path)
            return cat.landed[name]
        return read
    return deco


def js(c: str) -> str:
    """JSON string literal of a text expression (quotes and escapes included)."""
    return f"regexp_extract(to_json(array(CAST({c} AS STRING))), {q(r'^\[(.*)\]$')}, 1)"


def jbool(c: str) -> str:
    return f"CASE WHEN {c} THEN 'true' ELSE 'false' END"


def s(c: str) -> str:
    return f"CAST({c} AS STRING)"


def obj(*pairs: tuple[str, str]) -> str:
    inner = ", ".join(f"concat({q(f'"{k}":')}, {v})" for k, v in pairs)
    return f"concat('{{', concat_ws(',', {inner}), '}}')"


# ------------------------------------------------------------------ ids
def id_texts(cat: Catalog) -> DataFrame:
    """Id list as text (the id-list CSV column): some padded, some broken, some blank."""
    return cat.df("part").selectExpr(
        "p_partkey AS seq",
        "CASE WHEN p_partkey % 13 = 0 THEN concat(' ', p_partkey, ' ') "
        "WHEN p_partkey % 13 = 5 THEN concat('x', p_partkey) "
        "WHEN p_partkey % 13 = 7 THEN '' ELSE CAST(p_partkey AS STRING) END AS appid")


# ------------------------------------------------------------------ store
@landed("id")
def store_bodies(cat: Catalog) -> DataFrame:
    """``(id, body)``: one store payload per part."""
    names = (cat.df("part_supplier").join(cat.df("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy("l_partkey").agg(F.array_sort(F.collect_list("s_name")).alias("sup_names")))
    p = cat.df("part").join(names, F.col("p_partkey") == F.col("l_partkey"), "left")
    k, sz = "p_partkey", "p_size"
    d = f"date_add(DATE '1990-01-01', CAST(({k} * 37) % 10000 AS INT))"
    datestr = (f"CASE WHEN {k} % 5 = 0 THEN date_format({d}, 'MMM d, yyyy') "
               f"WHEN {k} % 5 = 1 THEN date_format({d}, 'd MMM, yyyy') "
               f"WHEN {k} % 5 = 2 THEN date_format({d}, 'MMM yyyy') "
               f"WHEN {k} % 5 = 3 THEN date_format({d}, 'yyyy') ELSE 'Coming soon' END")
    devs = "coalesce(sup_names, CAST(array() AS array<string>))"
    data = obj(
        ("name", js("concat('<b>', p_name, '</b> &amp; Co')")),
        ("required_age", f"CASE WHEN {sz} % 5 = 0 THEN {s(sz)} WHEN {sz} % 5 = 1 THEN {js(f"concat({sz}, '+')")} "
                         f"WHEN {sz} % 5 = 2 THEN '\"\"' WHEN {sz} % 5 = 3 THEN concat({sz}, '.5') ELSE 'null' END"),
        ("is_free", f"CASE WHEN {sz} % 3 = 0 THEN 'true' WHEN {sz} % 3 = 1 THEN '\"\"' ELSE '\"no\"' END"),
        ("detailed_description", js(f"concat('<p>', p_type, {q(' part</p>' + NEWLINE + '<br/>')})")),
        ("about_the_game", "'null'"),
        ("short_description", js("concat(p_brand, ' &lt;b&gt;')")),
        ("supported_languages", js(q("English, French<strong>*</strong>, German"))),
        ("header_image", js(f"concat('https://img.example/', {k}, '.jpg')")),
        ("developers", f"CASE WHEN {sz} % 4 = 0 THEN {js('concat(' + q(' Dev ') + ', p_brand)')} "
                       f"ELSE to_json(concat({devs}, array(' ', ''))) END"),
        ("publishers", f"CASE WHEN {sz} % 4 = 1 THEN '5' ELSE to_json(array(p_brand, concat(' ', p_type))) END"),
        ("platforms", f"concat('{{\"windows\":true,\"mac\":', {jbool(f'{sz} > 25')}, ',\"linux\":\"\"}}')"),
        ("metacritic", f"CASE WHEN {sz} % 2 = 0 THEN concat('{{\"score\":', {sz} * 2, '}}') "
                       f"ELSE '{{\"score\":\"n/a\"}}' END"),
        ("release_date", f"concat('{{\"date\":', {js(datestr)}, ',\"coming_soon\":', {jbool(f'{sz} % 2 = 1')}, '}}')"),
        ("categories", f"concat('[{{\"id\":', {sz} % 7, ',\"description\":', {js('p_type')}, "
                       f"'}},{{\"id\":\"x\"}},7,{{\"id\":\"', {sz} % 3 + 10, '\",\"description\":\"\"}}]')"),
        ("genres", f"concat('[{{\"id\":', {sz} % 4, ',\"name\":', {js('p_brand')}, "
                   f"'}},{{\"id\":99,\"description\":\"Indie\",\"name\":\"X\"}}]')"),
    )
    # the entry key is the id itself, except for k % 10 == 4 (another id's key)
    key = f"concat('{{\"', CASE WHEN {k} % 10 = 4 THEN {k} + 1 ELSE {k} END, '\":')"
    entry = (f"CASE WHEN {k} % 10 = 0 THEN '{{\"success\":false}}' "
             f"WHEN {k} % 10 = 2 THEN '{{\"success\":true,\"data\":[]}}' "
             f"WHEN {k} % 10 = 3 THEN '{{\"success\":true,\"data\":\"oops\"}}' "
             f"WHEN {k} % 10 = 4 THEN '{{\"success\":true,\"data\":' ELSE '{{\"success\":1,\"data\":' END")
    full = f"({k} % 10 = 4 OR {k} % 10 >= 5)"
    body = (f"CASE WHEN {k} % 10 = 1 THEN 'not json {{' ELSE concat({key}, {entry}, "
            f"CASE WHEN {full} THEN concat({data}, '}}') ELSE '' END, '}}') END")
    return p.selectExpr(f"CAST({k} AS INT) AS id", f"{body} AS body")


# ------------------------------------------------------------------ stats
@landed("id")
def stats_bodies(cat: Catalog) -> DataFrame:
    k, sz = "p_partkey", "p_size"
    lo, hi = f"format_number({sz} * 1000, 0)", f"format_number({sz} * 2000, 0)"
    owners = (f"CASE WHEN {k} % 7 = 2 THEN '\"1 .. 2 .. 3\"' WHEN {k} % 7 = 3 THEN {js(lo)} "
              f"ELSE {js(f"concat({lo}, ' .. ', {hi})")} END")
    good = obj(("owners", owners), ("average_forever", s(f"{sz} * 10")), ("average_2weeks", js(s(sz))),
               ("median_forever", "'\"\"'"), ("median_2weeks", "'null'"),
               ("ccu", f"concat({sz} + 3, '.9')"))
    body = f"CASE WHEN {k} % 7 = 0 THEN '[1,2]' WHEN {k} % 7 = 1 THEN '{{bad' ELSE {good} END"
    return cat.df("part").selectExpr(f"CAST({k} AS INT) AS id", f"{body} AS body")


# ------------------------------------------------------------------ child pages
@landed("id")
def review_page_bodies(cat: Catalog) -> DataFrame:
    """``(id, page_no, body)``: one page per conversation turn, one child per line."""
    lines = f"split(text, {q(NEWLINE)})"
    line, i = "ln", "ix"
    review = obj(
        ("recommendationid", js(f"concat_ws('-', conv_id, turn, {i})")),
        ("author", obj(("steamid", s("conv_id * 1000 + turn")), ("playtime_forever", s(f"length({line})")),
                       ("playtime_at_review", "'\"12\"'"), ("last_played", s("1700000000 + turn * 3600")))),
        ("language", js("role")), ("review", js(line)), ("voted_up", jbool(f"{i} % 2 = 0")),
        ("votes_up", s(f"CAST(length({line}) AS BIGINT) * 1000000")), ("votes_funny", "'\"3\"'"),
        ("weighted_vote_score", "'\"0.5\"'"), ("written_during_early_access", "'0'"),
        ("timestamp_created", s(f"1700000000 + {i}")), ("timestamp_updated", "'0'"))
    reviews = (f"CASE WHEN length(text) < 100 THEN '[]' ELSE concat('[', "
               f"array_join(transform({lines}, ({line}, {i}) -> {review}), ','), ',5,{{\"recommendationid\":\"\"}}]') END")
    cursor = "CASE WHEN turn % 4 = 3 THEN '\"*\"' WHEN turn % 5 = 4 THEN 'null' ELSE concat('\"c', turn + 1, '\"') END"
    qs = obj(("num_reviews", s(f"size({lines})")), ("review_score", s("turn")), ("review_score_desc", js("role")),
             ("total_positive", s("length(text)")), ("total_negative", "'\"7\"'"), ("total_reviews", "'\"n/a\"'"))
    good = obj(("success", "CASE WHEN role <> 'system' THEN '1' ELSE '0' END"), ("cursor", cursor),
               ("query_summary", qs), ("reviews", reviews))
    body = f"CASE WHEN length(text) % 11 = 0 THEN 'garbage' ELSE {good} END"
    return cat.df("conversations").selectExpr("CAST(conv_id AS INT) AS id", "CAST(turn + 1 AS INT) AS page_no",
                                              f"{body} AS body")


# ------------------------------------------------------------------ id-list pages
@landed("page_no")
def id_list_page_bodies(cat: Catalog) -> DataFrame:
    """``(page_no, body)`` pages ``{"apps": [...]}`` over ``orders`` keys.

    Page ``n`` holds the orders with ``o_orderkey // page_size = n``; entries
    of ``1-URGENT`` orders carry the appid as text (skipped) unless they are a
    page's last slot, and the page nine tenths down the list ends with an entry
    without appid (the run stops after it)."""
    page_size = PAGE_SIZE
    stop = cat.df("orders").agg((F.max("o_orderkey") / page_size).cast("bigint").alias("last")).select((F.col("last") * 9 / 10).cast("bigint")).scalar()
    entry = (f"CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % {page_size} < {page_size - 1} "
             f"THEN {obj(('appid', js('o_orderkey')), ('name', js('o_orderstatus')))} "
             f"ELSE {obj(('appid', s('o_orderkey')), ('name', js('o_orderstatus')))} END")
    pages = (cat.df("orders").selectExpr(f"CAST(o_orderkey / {page_size} AS BIGINT) AS page_no",
                                         "o_orderkey AS k", f"{entry} AS e")
             .groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("items")))
    return pages.withColumn("stop", stop).selectExpr(
        "page_no + 1 AS page_no",
        "concat('{\"apps\":[', array_join(transform(items, x -> x.e), ','), "
        "CASE WHEN page_no = stop THEN ',{\"name\":\"no id\"}' ELSE '' END, ']}') AS body")
