"""Checked queries for the ingest surface: scalar rules (F), normalisation
jobs (P1–P5), page runs (N3–N5), id scans (S1, S7, S8), the three-source
merge and the full ingest (J5, E1, E2), and the tables it maintains (M15,
M16).  Landing bodies are derived from the driver's tables
(``quarry.sources.landing``); the DuckDB twins state the expected normalised
values from the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import clean as C
from ..operators import normalize as N
from ..sources import landing as L
from ..sources.scan import landing_payloads
from . import ingest_jobs as J
from .registry import fixture_catalog, query


def cat_of(spark, sf) -> Catalog:
    return fixture_catalog(spark, sf)


def _store(cat):
    return N.store_records(landing_payloads(L.store_bodies(cat)))


def _run(spark, sf, cap=N.MAX_CHILDREN, with_catalogue=False, checkpoint=False):
    cat = cat_of(spark, sf)
    base = Catalog.empty_catalogue(spark) if with_catalogue else None
    return J.ingest(L.id_texts(cat), L.store_bodies(cat), L.stats_bodies(cat), L.review_page_bodies(cat),
                    catalog=base, run_ts=L.RUN_TS, max_children=cap, checkpoint=checkpoint)


# =============================================================== SQL building blocks
SQL_PART = """part_s AS (
  SELECT p.*, p_partkey AS k, p_size AS s,
         DATE '1990-01-01' + CAST((p_partkey * 37) % 10000 AS INTEGER) AS d
  FROM part p)"""

SQL_SUP = """sup AS (
  SELECT ps.l_partkey, string_agg(s.s_name, ', ' ORDER BY s.s_name) AS names
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps
  JOIN supplier s ON ps.l_suppkey = s.s_suppkey GROUP BY ps.l_partkey)"""

SQL_STORE = """store AS (
  SELECT CAST(k AS INTEGER) AS id,
    CASE WHEN k % 10 = 2 THEN '' ELSE p_name || ' & Co' END AS name,
    CASE WHEN k % 10 = 2 OR s % 5 IN (2, 4) THEN 0 ELSE least(s, 21) END AS required_age,
    CASE WHEN k % 10 = 2 THEN false ELSE s % 3 <> 1 END AS is_free,
    CASE WHEN k % 10 = 2 THEN '' ELSE p_type || ' part' END AS detailed_description,
    '' AS about_the_game,
    CASE WHEN k % 10 = 2 THEN '' ELSE p_brand || ' <b>' END AS short_description,
    CASE WHEN k % 10 = 2 THEN '' ELSE 'English; French*; German' END AS supported_languages,
    CASE WHEN k % 10 = 2 THEN '' ELSE 'https://img.example/' || k || '.jpg' END AS header_image,
    CASE WHEN k % 10 = 2 THEN '' WHEN s % 4 = 0 THEN 'Dev ' || p_brand
         ELSE coalesce(sup.names || ', ', '') END AS developers,
    CASE WHEN k % 10 = 2 OR s % 4 = 1 THEN '' ELSE p_brand || ', ' || p_type END AS publishers,
    k % 10 <> 2 AS windows,
    CASE WHEN k % 10 = 2 THEN false ELSE s > 25 END AS mac,
    false AS linux,
    CASE WHEN k % 10 <> 2 AND s % 2 = 0 THEN s * 2 END AS metacritic,
    CASE WHEN k % 10 = 2 THEN NULL
         WHEN k % 5 IN (0, 1) THEN CAST(d AS TIMESTAMP)
         WHEN k % 5 = 2 THEN CAST(date_trunc('month', d) AS TIMESTAMP)
         WHEN k % 5 = 3 THEN CAST(date_trunc('year', d) AS TIMESTAMP) END AS release_date,
    CASE WHEN k % 10 = 2 THEN false ELSE s % 2 = 1 END AS coming_soon
  FROM part_s LEFT JOIN sup ON sup.l_partkey = part_s.k
  WHERE k % 10 IN (2, 5, 6, 7, 8, 9))"""

SQL_STATS = """stats AS (
  SELECT CAST(p_partkey AS INTEGER) AS id,
    CASE WHEN p_partkey % 7 >= 4 THEN p_size * 1000 ELSE 0 END AS owners_min,
    CASE WHEN p_partkey % 7 >= 4 THEN p_size * 2000 ELSE 0 END AS owners_max,
    p_size * 10 AS average_forever, p_size AS average_2weeks, 0 AS median_forever, 0 AS median_2weeks,
    p_size + 3 AS ccu
  FROM part WHERE p_partkey % 7 >= 2)"""


def sql_pages(cap: int, ids_filter: str = "") -> str:
    """CTEs pg, stops, lines, ranked, caps, lim, reviews, fs, summ for the page-run rules."""
    return f"""pg AS (
  SELECT conv_id AS id, turn + 1 AS page_no, turn, role, text,
    length(text) % 11 = 0 AS failed,
    CASE WHEN length(text) % 11 <> 0 AND role <> 'system' AND length(text) >= 100
         THEN len(string_split(text, chr(10))) ELSE 0 END AS n_valid,
    (turn % 4 = 3) OR (turn % 5 = 4) AS cur_stop,
    length(text) % 11 <> 0 AND role <> 'system' AS has_summary
  FROM conversations {ids_filter}),
stops AS (SELECT id, min(page_no) AS stop_page FROM pg WHERE failed OR n_valid = 0 OR cur_stop GROUP BY id),
lines AS (
  SELECT id, page_no, turn, role, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx
  FROM pg WHERE n_valid > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_no, idx) AS rnk FROM lines),
caps AS (SELECT id, page_no AS cap_page FROM ranked WHERE rnk = {cap}),
lim AS (SELECT coalesce(s.id, c.id) AS id, least(s.stop_page, c.cap_page) AS last_page
        FROM stops s FULL JOIN caps c ON s.id = c.id),
reviews AS (
  SELECT r.* FROM ranked r LEFT JOIN lim ON r.id = lim.id
  WHERE r.rnk <= {cap} AND (lim.last_page IS NULL OR r.page_no <= lim.last_page)),
fs AS (SELECT pg.id, min(pg.page_no) AS sp FROM pg LEFT JOIN lim ON pg.id = lim.id
       WHERE pg.has_summary AND (lim.last_page IS NULL OR pg.page_no <= lim.last_page) GROUP BY pg.id),
summ AS (
  SELECT CAST(pg.id AS INTEGER) AS id,
    CAST(len(string_split(pg.text, chr(10))) AS INTEGER) AS reviewNumReviews,
    CAST(pg.turn AS INTEGER) AS reviewScore, pg.role AS reviewScoreDesc,
    CAST(length(pg.text) AS INTEGER) AS reviewTotalPositive, 7 AS reviewTotalNegative,
    CAST(NULL AS INTEGER) AS reviewTotalReviews
  FROM pg JOIN fs ON pg.id = fs.id AND pg.page_no = fs.sp)"""


SQL_REVIEW_COLS = """r.id || '-' || r.turn || '-' || r.idx AS id, CAST(r.id AS INTEGER) AS gameId,
  CASE WHEN r.id * 1000 + r.turn = 0 THEN '' ELSE CAST(r.id * 1000 + r.turn AS VARCHAR) END AS authorSteamId, CAST(length(r.line) AS INTEGER) AS authorPlaytimeForever,
  12 AS authorPlaytimeAtReview,
  TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + r.turn * 3600) AS authorLastPlayed,
  r.role AS language, r.line AS review, r.idx % 2 = 0 AS votedUp,
  CAST(least(CAST(length(r.line) AS BIGINT) * 1000000, 2147483647) AS INTEGER) AS votesUp, 3 AS votesFunny,
  CAST(0.5 AS DOUBLE) AS weightedVoteScore, false AS writtenDuringEarlyAccess,
  TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + r.idx) AS timestampCreated,
  CAST(NULL AS TIMESTAMP) AS timestampUpdated"""

SQL_IDS = "ids AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 13 NOT IN (5, 7))"

REVIEW_COLUMNS = list(N.REVIEW_FIELDS)
STORE_COLUMNS = ["id", *N.GAME_FIELDS]


# =============================================================== F rules
@query("f1_f2_strip_html_pages", r"""
SELECT page_id,
  regexp_replace(
    replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),
      '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'),
    '^\s+|\s+$', '', 'g') AS text,
  replace(regexp_replace(url, '[/?=&]', ', ', 'g'), ', ', '; ') AS url_list
FROM pages
""")
def f1_f2_strip_html(spark, sf):
    df = cat_of(spark, sf).df("pages")
    return df.select("page_id", C.strip_html(F.col("html")).alias("text"),
                     F.regexp_replace("url", "[/?=&]", ", ").alias("u")).selectExpr(
        "page_id", "text", f"{C.list_separators('u')} AS url_list")


@query("f3_release_dates_orders", """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 6 IN (0, 1) THEN o_orderdate
       WHEN o_orderkey % 6 = 2 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)
       WHEN o_orderkey % 6 = 3 THEN CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)
       WHEN o_orderkey % 6 = 4 AND month(o_orderdate) = 5 THEN o_orderdate END AS release_date
FROM orders
""")
def f3_release_dates(spark, sf):
    o = cat_of(spark, sf).df("orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    txt = (F.when(k % 6 == 0, F.upper(F.date_format(d, "MMM d, yyyy")))
            .when(k % 6 == 1, F.concat(F.lit("  "), F.date_format(d, "d  MMM,   yyyy"), F.lit(" ")))
            .when(k % 6 == 2, F.date_format(d, "MMM yyyy"))
            .when(k % 6 == 3, F.date_format(d, "yyyy"))
            .when(k % 6 == 4, F.date_format(d, "MMMM d, yyyy"))
            .otherwise(F.lit("Q3 2025")))
    return o.select("o_orderkey", txt.alias("t")).selectExpr(
        "o_orderkey", f"{C.parse_release_date('t')} AS release_date")


@query("f4_required_age_part", """
SELECT p_partkey,
  CASE WHEN p_partkey % 7 = 0 THEN 0
       WHEN p_partkey % 11 = 0 THEN 1
       WHEN p_partkey % 6 IN (0, 1, 3) THEN least(p_size, 21)
       ELSE 0 END AS required_age
FROM part
""")
def f4_required_age(spark, sf):
    p = cat_of(spark, sf).df("part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    j = (F.when(k % 7 == 0, F.lit("null")).when(k % 11 == 0, F.lit("true"))
          .when(k % 6 == 0, s).when(k % 6 == 1, F.concat(F.lit('"'), s, F.lit('+"')))
          .when(k % 6 == 2, F.lit('""')).when(k % 6 == 3, F.concat(F.lit('"'), s, F.lit('.7"')))
          .when(k % 6 == 4, F.lit('"abc"')).otherwise(F.concat(F.lit('" -'), s, F.lit('"'))))
    return p.select("p_partkey", F.parse_json(j).alias("v")).selectExpr(
        "p_partkey", f"{C.required_age('v')} AS required_age")


@query("f5_f6_f7_f13_numbers_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN trunc(l_quantity)
            WHEN l_linenumber % 3 = 1 THEN l_suppkey ELSE 0 END AS BIGINT) AS as_int,
  CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 0.0 END AS as_float,
  l_linenumber % 4 NOT IN (0, 1) OR (l_linenumber % 4 = 1 AND l_tax <> 0) AS truthy,
  CAST(least(l_orderkey * 1000000, 2147483647) AS INTEGER) AS clamped
FROM lineitem
""")
def f5_f6_f7_f13(spark, sf):
    li = cat_of(spark, sf).df("lineitem")
    n = F.col("l_linenumber")
    int_json = (F.when(n % 3 == 0, F.col("l_quantity").cast("string"))
                 .when(n % 3 == 1, F.concat(F.lit('" '), F.col("l_suppkey").cast("string"), F.lit(' "')))
                 .otherwise(F.lit('"3.7"')))
    float_json = F.when(n % 2 == 0, F.concat(F.lit('"'), F.col("l_discount").cast("string"), F.lit('"')))\
        .otherwise(F.lit('"x"'))
    truth_json = (F.when(n % 4 == 0, F.lit("[]")).when(n % 4 == 1, F.col("l_tax").cast("string"))
                   .when(n % 4 == 2, F.lit('"false"')).otherwise(F.lit('{"a":0}')))
    staged = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.parse_json(int_json).alias("vi"), F.parse_json(float_json).alias("vf"),
                       F.parse_json(truth_json).alias("vt"))
    return staged.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        f"{C.variant_int('vi', default=0)} AS as_int", f"{C.variant_float('vf', default=0.0)} AS as_float",
        f"{C.truthy('vt')} AS truthy", f"{C.clamp_int('l_orderkey * 1000000')} AS clamped")


@query("f12_f14_f15_times_events", """
SELECT event_id,
  TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor(epoch(ts)) AS BIGINT)) AS from_epoch,
  strftime(ts, '%Y-%m-%d') AS iso_date,
  CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
  make_timestamp(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) * 1000) AS ts_ms,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE TIMESTAMP '1970-01-01 00:00:00' + to_seconds(event_id) END AS small_epoch
FROM events
""")
def f12_f14_f15(spark, sf):
    ev = cat_of(spark, sf).df("events")
    ts = F.col("ts")
    secs = (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))
    small = F.when(F.col("event_id") % 5 == 0, -F.col("event_id")).otherwise(F.col("event_id"))
    staged = ev.select("event_id", "ts", secs.alias("secs"), small.alias("small"))
    return staged.selectExpr("event_id", f"{C.epoch_to_ts('secs')} AS from_epoch", f"{C.iso_date('ts')} AS iso_date",
                             f"{C.iso_datetime('ts')} AS iso", f"{C.truncate_millis('ts')} AS ts_ms",
                             f"{C.epoch_to_ts('small')} AS small_epoch")


# =============================================================== S1 S7 S8
@query("s1_tolerant_id_scan_orders", """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 3 THEN o_custkey + 3000000000 ELSE o_custkey END AS appid FROM orders WHERE o_orderkey % 13 NOT IN (5, 7)
""")
def s1_tolerant_ids(spark, sf):
    o = cat_of(spark, sf).df("orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    txt = (F.when(k % 13 == 0, F.concat(F.lit(" \t"), c, F.lit(" "))).when(k % 13 == 5, F.concat(c, F.lit(".0")))
            .when(k % 13 == 7, F.lit("")).when(k % 13 == 9, F.concat(F.lit("+"), c))
            .when(k % 13 == 3, (F.col("o_custkey") + 3000000000).cast("string")).otherwise(c))
    return J.select_ids(o.select(k.alias("seq"), txt.alias("appid")))


@query("s7_landing_scan_events", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
       event_id % 9 = 0 AS missing
FROM events
""")
def s7_landing(spark, sf):
    ev = cat_of(spark, sf).df("events")
    body = F.when(F.col("event_id") % 9 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props"))
    df = landing_payloads(ev.select("event_id", body.alias("body")))
    return df.selectExpr("event_id", f"{C.vget('payload', '$.k', 'int')} AS k", "payload IS NULL AS missing")


@query("s8_e2_g9_k3_id_list_export", """
SELECT DISTINCT o_orderkey AS appid FROM orders
WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 50 < 49)
  AND o_orderkey < ((SELECT (max(o_orderkey) // 50) * 9 // 10 FROM orders) + 1) * 50 ORDER BY appid
""")
def s8_e2_export(spark, sf):
    return J.export_ids(L.id_list_page_bodies(cat_of(spark, sf)))


# =============================================================== P1 P2 P3
@query("p1_store_records_part", f"""
WITH {SQL_PART}, {SQL_SUP}, {SQL_STORE}
SELECT {", ".join(STORE_COLUMNS)} FROM store
""")
def p1_store(spark, sf):
    return _store(cat_of(spark, sf)).select(*STORE_COLUMNS)


@query("p2_store_links_part", f"""
WITH {SQL_PART},
ok AS (SELECT * FROM part_s WHERE k % 10 IN (5, 6, 7, 8, 9))
SELECT 'developer' AS kind, CAST(k AS INTEGER) AS gameId, CAST(NULL AS BIGINT) AS item_id, 'Dev ' || p_brand AS name
  FROM ok WHERE s % 4 = 0
UNION ALL
SELECT 'developer', CAST(ok.k AS INTEGER), NULL, sp.s_name FROM ok
  JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps ON ps.l_partkey = ok.k
  JOIN supplier sp ON sp.s_suppkey = ps.l_suppkey WHERE ok.s % 4 <> 0
UNION ALL
SELECT 'publisher', CAST(k AS INTEGER), NULL, p_brand FROM ok WHERE s % 4 <> 1
UNION ALL
SELECT 'publisher', CAST(k AS INTEGER), NULL, p_type FROM ok WHERE s % 4 <> 1
UNION ALL
SELECT 'category', CAST(k AS INTEGER), s % 7, p_type FROM ok
UNION ALL
SELECT 'category', CAST(k AS INTEGER), s % 3 + 10, '' FROM ok
UNION ALL
SELECT 'genre', CAST(k AS INTEGER), s % 4, p_brand FROM ok
UNION ALL
SELECT 'genre', CAST(k AS INTEGER), 99, 'Indie' FROM ok
""")
def p2_store_links(spark, sf):
    st = _store(cat_of(spark, sf))
    dev = N.name_links(st, "developer_names", "name").select(
        F.lit("developer").alias("kind"), F.col("gameId").cast("int"), F.lit(None).cast("bigint").alias("item_id"),
        "name")
    pub = N.name_links(st, "publisher_names", "name").select(
        F.lit("publisher").alias("kind"), F.col("gameId").cast("int"), F.lit(None).cast("bigint").alias("item_id"),
        "name")
    cats = N.item_links(st, "categories").select(F.lit("category").alias("kind"), F.col("gameId").cast("int"),
                                                 F.col("id").alias("item_id"), "name")
    gens = N.item_links(st, "genres").select(F.lit("genre").alias("kind"), F.col("gameId").cast("int"),
                                             F.col("id").alias("item_id"), "name")
    return dev.unionByName(pub).unionByName(cats).unionByName(gens)


@query("p3_stats_records_part", f"WITH {SQL_STATS} SELECT * FROM stats")
def p3_stats(spark, sf):
    return N.stats_records(landing_payloads(L.stats_bodies(cat_of(spark, sf))))


# =============================================================== P4 P5 N3 N4 N5
@query("p4_n4_n5_review_summaries", f"""
WITH {sql_pages(3)}
SELECT * FROM summ
""")
def p4_n5_summaries(spark, sf):
    pages = landing_payloads(L.review_page_bodies(cat_of(spark, sf)))
    summaries, _ = N.page_run(pages, cap=3)
    return summaries.select(F.col("id").cast("int").alias("id"), *N.SUMMARY_FIELDS)


@query("p5_n3_n4_review_rows_cap3", f"""
WITH {sql_pages(3)}
SELECT {SQL_REVIEW_COLS} FROM reviews r
""")
def p5_n3_reviews(spark, sf):
    pages = landing_payloads(L.review_page_bodies(cat_of(spark, sf)))
    _, reviews = N.page_run(pages, cap=3)
    return reviews.select(*REVIEW_COLUMNS)


# =============================================================== J5 E1
SQL_E1 = f"""
WITH {SQL_PART}, {SQL_SUP}, {SQL_STORE}, {SQL_STATS}, {SQL_IDS}, {sql_pages(100)}
SELECT CAST(i.k AS INTEGER) AS id,
  coalesce(st.name, '') AS name, coalesce(st.required_age, 0) AS required_age,
  coalesce(st.is_free, false) AS is_free, coalesce(st.detailed_description, '') AS detailed_description,
  coalesce(st.about_the_game, '') AS about_the_game, coalesce(st.short_description, '') AS short_description,
  coalesce(st.supported_languages, '') AS supported_languages, coalesce(st.header_image, '') AS header_image,
  coalesce(st.developers, '') AS developers, coalesce(st.publishers, '') AS publishers,
  coalesce(st.windows, false) AS windows, coalesce(st.mac, false) AS mac, coalesce(st.linux, false) AS linux,
  st.metacritic AS metacritic, st.release_date AS release_date, coalesce(st.coming_soon, false) AS coming_soon,
  coalesce(sa.owners_min, 0) AS owners_min, coalesce(sa.owners_max, 0) AS owners_max,
  coalesce(sa.average_2weeks, 0) AS average_2weeks, coalesce(sa.average_forever, 0) AS average_forever,
  coalesce(sa.median_forever, 0) AS median_forever, coalesce(sa.median_2weeks, 0) AS median_2weeks,
  coalesce(sa.ccu, 0) AS ccu,
  su.reviewNumReviews, su.reviewScore, su.reviewScoreDesc, su.reviewTotalPositive, su.reviewTotalNegative,
  su.reviewTotalReviews,
  CASE WHEN st.id IS NULL THEN 'missing' ELSE 'ok' END AS store_status,
  CASE WHEN sa.id IS NULL THEN 'missing' ELSE 'ok' END AS steamspy_status,
  CASE WHEN su.id IS NULL THEN 'missing' ELSE 'ok' END AS reviews_status,
  '{L.RUN_TS}' AS last_updated
FROM ids i LEFT JOIN store st ON st.id = i.k LEFT JOIN stats sa ON sa.id = i.k LEFT JOIN summ su ON su.id = i.k
"""


@query("e1_full_ingest_entities", SQL_E1, bench=True)
def e1_entities(spark, sf):
    return _run(spark, sf).entities


@query("e1_j5_review_rows", f"""
WITH {SQL_IDS}, {sql_pages(100, "WHERE conv_id IN (SELECT k FROM ids)")}
SELECT {SQL_REVIEW_COLS} FROM reviews r
""", bench=True)
def e1_reviews(spark, sf):
    return _run(spark, sf, checkpoint=True).reviews.select(*REVIEW_COLUMNS)


SQL_OK_GAMES = f"""{SQL_PART}, {SQL_IDS},
ok AS (SELECT part_s.* FROM part_s JOIN ids ON part_s.k = ids.k WHERE part_s.k % 10 IN (5, 6, 7, 8, 9))"""


SQL_DEVELOPERS = f"""
WITH {SQL_OK_GAMES},
links AS (
  SELECT k AS g, 'Dev ' || p_brand AS name FROM ok WHERE s % 4 = 0
  UNION
  SELECT ok.k, sp.s_name FROM ok
  JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps ON ps.l_partkey = ok.k
  JOIN supplier sp ON sp.s_suppkey = ps.l_suppkey WHERE ok.s % 4 <> 0)
SELECT name, CAST(count(DISTINCT g) AS INTEGER) AS amount_games_published FROM links GROUP BY name
"""


@query("m15_g11_developer_counters_after_ingest", SQL_DEVELOPERS, bench=True)
def m15_developers(spark, sf):
    return _run(spark, sf, with_catalogue=True).catalog.df("Developer")


SQL_PUBLISHER_LINKS = f"""
WITH {SQL_OK_GAMES}
SELECT DISTINCT CAST(k AS INTEGER) AS gameId, p_brand AS publisherName FROM ok WHERE s % 4 <> 1
UNION
SELECT DISTINCT CAST(k AS INTEGER), p_type FROM ok WHERE s % 4 <> 1
"""


@query("m15_publisher_links_after_ingest", SQL_PUBLISHER_LINKS)
def m15_publisher_links(spark, sf):
    return _run(spark, sf, with_catalogue=True).catalog.df("GamePublisher")


SQL_CATEGORIES = f"""
WITH {SQL_OK_GAMES}
SELECT CAST(s % 7 AS INTEGER) AS id, arg_max(p_type, k) AS name FROM ok GROUP BY s % 7
UNION ALL
SELECT DISTINCT CAST(s % 3 + 10 AS INTEGER), CAST(s % 3 + 10 AS VARCHAR) FROM ok
"""


@query("m16_category_dimension_after_ingest", SQL_CATEGORIES)
def m16_categories(spark, sf):
    return _run(spark, sf, with_catalogue=True).catalog.df("Category")


@query("m16_genre_links_after_ingest", f"""
WITH {SQL_OK_GAMES}
SELECT DISTINCT CAST(k AS INTEGER) AS gameId, CAST(s % 4 AS INTEGER) AS genreId FROM ok
UNION
SELECT DISTINCT CAST(k AS INTEGER), 99 FROM ok
""")
def m16_genre_links(spark, sf):
    return _run(spark, sf, with_catalogue=True).catalog.df("GameGenre")


@query("m3_game_table_after_ingest", f"""
WITH {SQL_PART}, {SQL_SUP}, {SQL_STORE}, {SQL_STATS}, {SQL_IDS}, {sql_pages(100)}
SELECT CAST(i.k AS INTEGER) AS id, coalesce(st.name, '') AS name, coalesce(st.metacritic, NULL) AS metacritic,
  coalesce(sa.owners_max, 0) AS owners_max, su.reviewScoreDesc AS reviewScoreDesc
FROM ids i LEFT JOIN store st ON st.id = i.k LEFT JOIN stats sa ON sa.id = i.k LEFT JOIN summ su ON su.id = i.k
""")
def m3_game_table(spark, sf):
    return _run(spark, sf, with_catalogue=True).catalog.df("Game").select(
        "id", "name", "metacritic", "owners_max", "reviewScoreDesc")


# =============================================================== O1 O2 L10
@query("o1_concat_pages_conversations", """
SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations
""")
def o1_concat(spark, sf):
    c = cat_of(spark, sf).df("conversations")
    return c.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))


@query("o2_union_processed_keys", """
SELECT doc_id AS id FROM labels UNION SELECT item_id FROM benchmark
""")
def o2_union(spark, sf):
    cat = cat_of(spark, sf)
    return J.processed_keys([cat.df("labels").select("doc_id"), cat.df("benchmark").select("item_id")])


@query("l10_offset_limit_documents", """
SELECT doc_id AS seq, doc_id AS appid FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100
""")
def l10_offset_limit(spark, sf):
    d = cat_of(spark, sf).df("documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("appid"))
    return J.offset_limit(J.offset_limit(d, offset=100), limit=50)


# =============================================================== landing faults
@query("n4_page_gap_review_rows", f"""
WITH {sql_pages(100, "WHERE turn < 2")}
SELECT {SQL_REVIEW_COLS} FROM reviews r
""")
def n4_page_gap(spark, sf):
    """The third page never landed: what landed after it was never visited."""
    pages = landing_payloads(L.review_page_bodies(cat_of(spark, sf)).where("page_no <> 3"))
    return N.page_run(pages)[1].select(*REVIEW_COLUMNS)


@query("j5_landed_again_stats_part", f"WITH {SQL_STATS} SELECT * FROM stats")
def j5_landed_again(spark, sf):
    """Every body landed twice: the later one counts."""
    good = L.stats_bodies(cat_of(spark, sf))
    stale = good.withColumn("body", F.regexp_replace("body", "[0-9]", "1"))
    return N.stats_records(J._only(good.withColumn("landed", F.lit(2)).unionByName(stale.withColumn("landed", F.lit(1))), None))


@query("f5_f6_f13_big_numbers_part", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 2147483647 WHEN 1 THEN -2147483648 WHEN 2 THEN 2147483647 WHEN 3 THEN 0 ELSE p_partkey END AS n,
  CASE p_partkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1e30 WHEN 3 THEN 0.0 WHEN 4 THEN 1.5 ELSE 0.25 END AS x FROM part
""")
def f5_big(spark, sf):
    k = "p_partkey"
    n = (f"CASE {k} % 6 WHEN 0 THEN {L.js(f"concat('9999999999', {k}, '9999999999')")} "
         f"WHEN 1 THEN concat('-9999999999', {k}, '9999999999') "
         f"WHEN 2 THEN '1e25' WHEN 3 THEN {L.js("'12abc'")} ELSE {L.s(k)} END")
    x = (f"CASE {k} % 6 WHEN 0 THEN {L.js("'1.5f'")} WHEN 1 THEN {L.js("'2d'")} WHEN 2 THEN {L.js("'1e30'")} "
         f"WHEN 3 THEN {L.js("'0x1'")} WHEN 4 THEN {L.js("' 1.5 '")} ELSE '0.25' END")
    df = landing_payloads(cat_of(spark, sf).df("part").selectExpr(k, f"{L.obj(('n', n), ('x', x))} AS body"))
    s = C.with_kinds(df, {"__n": C.vget("payload", "$.n"), "__x": C.vget("payload", "$.x")}, keep=[k])
    return s.selectExpr(k, f"{C.clamp_int(C.variant_int(*C.vk('__n'), 0))} AS n", f"{C.variant_float(*C.vk('__x'))} AS x")


@query("e1_job_with_sinks_resume_and_publish", f"""
WITH e AS ({SQL_E1})
SELECT 'csv' AS output, id, nullif(name, '') AS name, required_age, is_free, metacritic, owners_max, reviewScoreDesc, store_status FROM e
UNION ALL SELECT 'table', id, nullif(name, ''), required_age, is_free, metacritic, owners_max, reviewScoreDesc, NULL FROM e
""")
def e1_job(spark, sf):
    """The whole job twice: a first run over half of the ids, then a resumed one that skips what the outputs hold."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources import scan
    cat = cat_of(spark, sf)
    root = f"{checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    bodies = (L.store_bodies(cat), L.stats_bodies(cat), L.review_page_bodies(cat))
    ids = L.id_texts(cat)
    first = J.ingest(ids, *bodies, catalog=Catalog.empty_catalogue(spark), run_ts=L.RUN_TS, limit=max(1, ids.count() // 2), checkpoint=True)
    J.write_run(spark, first, root)
    done = [scan.existing_keys_from_csv(spark, f"{root}/entities"), J.published_catalog(spark, root).df("Game").select("id")]
    second = J.ingest(ids, *bodies, catalog=J.published_catalog(spark, root), run_ts=L.RUN_TS, processed=done, checkpoint=True)
    J.write_run(spark, second, root, resume=True)
    cols = ["id", "name", "required_age", "is_free", "metacritic", "owners_max", "reviewScoreDesc"]
    schema = ", ".join(f"{c} {'string' if c in ('release_date', 'last_updated') or c.endswith('_status') else J.ENTITY_TYPES[c]}" for c in J.ENTITY_CSV_COLUMNS)
    csv = scan.read_csv(spark, f"{root}/entities", schema)
    games = J.published_catalog(spark, root).df("Game")
    return csv.select(F.lit("csv").alias("output"), *cols, "store_status").unionByName(
        games.select(F.lit("table").alias("output"), *cols, F.lit(None).cast("string").alias("store_status")).withColumn("name", F.expr("nullif(name, '')")))


@query("j8_o3_resumed_ingest_by_bitmaps", f"""
WITH e AS ({SQL_E1}) SELECT id, name, owners_max, reviewScoreDesc, store_status, steamspy_status, reviews_status FROM e WHERE id % 3 <> 0
""")
def j8_bitmaps(spark, sf):
    """A run that skips a third of the ids: bodies are filtered by bitmaps of the others where they are read."""
    cat = cat_of(spark, sf)
    done = cat.df("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))
    run = J.ingest(L.id_texts(cat), L.store_bodies(cat), L.stats_bodies(cat), L.review_page_bodies(cat), run_ts=L.RUN_TS, processed=[done])
    return run.entities.select("id", "name", "owners_max", "reviewScoreDesc", "store_status", "steamspy_status", "reviews_status")


@query("o2_o3_id_bitmaps_lineitem", """
SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS inside FROM (SELECT l_orderkey - 100 AS l_orderkey, l_linenumber FROM lineitem)
LEFT JOIN (SELECT o_orderkey - 100 AS o_orderkey FROM orders WHERE o_custkey % 3 = 1) ON l_orderkey = o_orderkey
""")
def o2_bitmaps(spark, sf):
    """Membership in an exact id set, with numbers on both sides of zero."""
    cat = cat_of(spark, sf)
    lines = cat.df("lineitem").select((F.col("l_orderkey") - 100).alias("l_orderkey"), "l_linenumber")
    sets = J.id_bitmaps(cat.df("orders").where("o_custkey % 3 = 1").select((F.col("o_orderkey") - 100).alias("id")), "id")
    return (J.with_ids(lines, "l_orderkey", sets).withColumn("inside", F.lit(True))
            .unionByName(J.with_ids(lines, "l_orderkey", sets, keep=False).withColumn("inside", F.lit(False))))


# =============================================================== ST1 the whole ingest as a stream
DROPS = 4
_STREAMS: dict = {}


def streamed(spark, sf):
    """The ingest stream of a session, after all bodies have landed in four drops that mix the sources and the order of pages."""
    import uuid

    from ..session import checkpoint_dir
    from ..streaming.ingest_stream import IngestStream
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STREAMS:
        cat = cat_of(spark, sf)
        root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
        stream = IngestStream(spark, f"{root}/landing", f"{root}/tables", J.select_ids(L.id_texts(cat)), buckets=8, run_ts=L.RUN_TS)
        bodies = {"store": L.store_bodies(cat), "stats": L.stats_bodies(cat), "pages": L.review_page_bodies(cat)}
        for drop in range(DROPS):
            for name, df in bodies.items():
                keys = [c for c in ("id", "page_no") if c in df.columns]
                cols = ["CAST(id AS INT) AS id"] + (["CAST(page_no AS INT) AS page_no"] if "page_no" in keys else [])
                part = df.where(F.pmod(F.xxhash64(F.lit(name), *keys), F.lit(DROPS)) == drop)
                part.selectExpr(*cols, "body", f"CAST({drop} AS BIGINT) AS landed").write.mode("append").parquet(f"{root}/landing/{name}")
            stream.run()
        _STREAMS[key] = stream
    return _STREAMS[key]


@query("st1_stream_entities", SQL_E1)
def st1_entities(spark, sf):
    return streamed(spark, sf).entities()


@query("st1_stream_review_rows", f"""
WITH {SQL_IDS}, {sql_pages(100, "WHERE conv_id IN (SELECT k FROM ids)")}
SELECT {SQL_REVIEW_COLS} FROM reviews r
""")
def st1_reviews(spark, sf):
    return streamed(spark, sf).table("Review").select(*REVIEW_COLUMNS)


@query("st1_stream_developer_counters", SQL_DEVELOPERS)
def st1_developers(spark, sf):
    return streamed(spark, sf).table("Developer")


@query("st1_stream_publisher_links", SQL_PUBLISHER_LINKS)
def st1_publisher_links(spark, sf):
    return streamed(spark, sf).table("GamePublisher")


@query("st1_stream_category_dimension", SQL_CATEGORIES)
def st1_categories(spark, sf):
    return streamed(spark, sf).table("Category")
