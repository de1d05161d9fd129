import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarry.catalog import Catalog
from quarry.model import CATALOGUE_MODELS, FIXTURE_MODELS, ModelSpec
from quarry.operators import mutate as M
from quarry.operators import normalize as N
from quarry.plans import ingest_jobs as J
from quarry.sources.scan import landing_payloads


def keys(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ------------------------------------------------------------------ reads / paging
def test_page_union_over_take_skip_is_whole(cat):
    t = cat.table("orders")
    n = t.df.count()
    pages = [t.find_many(order={"o_totalprice": "desc"}, skip=s, take=400) for s in range(0, n, 400)]
    got = [k for p in pages for k in keys(p, "o_orderkey")]
    assert sorted(got) == keys(t.df, "o_orderkey")


def test_some_union_none_is_all_parents(cat):
    t = cat.table("orders")
    w = {"l_quantity": {"gt": 40}}
    some = keys(t.find_many(where={"lineitems": {"some": w}}), "o_orderkey")
    none = keys(t.find_many(where={"lineitems": {"none": w}}), "o_orderkey")
    assert sorted(some + none) == keys(t.df, "o_orderkey") and not set(some) & set(none)


def test_every_matches_childless_parents(cat):
    t = cat.table("orders")
    childless = set(keys(t.find_many(where={"lineitems": {"none": {}}}), "o_orderkey"))
    every = set(keys(t.find_many(where={"lineitems": {"every": {"l_quantity": {"gt": 1000}}}}), "o_orderkey"))
    assert childless and every == childless


def test_cursor_is_inclusive(cat):
    t = cat.table("orders")
    first = t.find_many(order={"o_orderdate": "asc"}, take=5).collect()
    cur = first[2]["o_orderkey"]
    page = t.find_many(order={"o_orderdate": "asc"}, cursor={"o_orderkey": cur}, take=3).collect()
    assert [r["o_orderkey"] for r in page] == [r["o_orderkey"] for r in first[2:5]]


def test_group_by_take_needs_order(cat):
    t = cat.table("lineitem")
    with pytest.raises(ValueError):
        t.group_by("l_returnflag", count=True, take=1)
    with pytest.raises(ValueError):
        t.group_by("l_returnflag", count=True, skip=1)


def test_count_empty_select_is_all(cat):
    r = cat.table("documents").count(select={}).first()
    assert r.asDict() == {"_all": cat.df("documents").count()}


def test_find_unique_or_raise(cat):
    from quarry.operators.table import RecordNotFoundError
    with pytest.raises(RecordNotFoundError):
        cat.table("part").find_unique_or_raise(where={"p_partkey": -1})
    with pytest.raises(ValueError):
        cat.table("part").find_unique(where={"p_name": "x"})


def test_unknown_field_is_an_error(cat):
    with pytest.raises(ValueError):
        cat.table("orders").find_many(where={"nope": 1})


# ------------------------------------------------------------------ mutations
def test_upsert_null_keeps_old_value_empty_overwrites(spark):
    spec = ModelSpec("t", key=("id",))
    old = spark.createDataFrame([(1, "A", 5)], "id int, name string, score int")
    new = spark.createDataFrame([(1, "", None)], "id int, name string, score int")
    got = M.upsert(old, new, spec).table.collect()
    assert [tuple(r) for r in got] == [(1, "", 5)]


def test_upsert_twice_equals_once(cat):
    part = cat.df("part")
    ch = part.where("p_size > 40").select((F.col("p_partkey") + 5).alias("p_partkey"), "p_name", "p_brand",
                                           "p_type", "p_size", "p_retailprice")
    once = M.upsert(part, ch, FIXTURE_MODELS["part"]).table
    twice = M.upsert(once, ch, FIXTURE_MODELS["part"]).table
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_connect_then_disconnect_is_identity(cat):
    links = cat.df("part_supplier")
    pairs = cat.df("part").select(F.col("p_partkey").alias("l_partkey"), F.lit(999).cast("bigint").alias("l_suppkey"))
    key = ("l_partkey", "l_suppkey")
    back = M.disconnect(M.connect(links, pairs, key).table, pairs, key).table
    assert keys(back, *key) == keys(links, *key)


def test_insert_duplicate_key_raises(cat):
    with pytest.raises(M.UniqueViolation):
        M.insert(cat.df("part"), cat.df("part").limit(1), FIXTURE_MODELS["part"])


def test_counters_count_new_distinct_links_once(spark):
    links = spark.createDataFrame([], "gameId int, developerName string")
    counters = spark.createDataFrame([], "name string, amount_games_published int")
    pairs = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A")], "gameId int, developerName string")
    l1, c1 = M.maintain_counted_links(links, counters, pairs, "gameId", "developerName")
    assert [tuple(r) for r in c1.table.collect()] == [("A", 2)]
    l2, c2 = M.maintain_counted_links(l1.table, c1.table, pairs, "gameId", "developerName")
    assert [tuple(r) for r in c2.table.collect()] == [("A", 2)]


def test_divide_by_zero_raises(cat):
    with pytest.raises(Exception):
        cat.table("part").update_many({"p_size": {"divide": 0}}).table.collect()


# ------------------------------------------------------------------ page runs
def _pages(spark, pages):
    rows = [(1, n, body) for n, body in pages]
    return landing_payloads(spark.createDataFrame(rows, "id int, page_no int, body string"))


def _page(summary, n_children, cursor, start=0):
    reviews = [{"recommendationid": f"r{start + i}"} for i in range(n_children)]
    return json.dumps({"success": 1, "cursor": cursor, "query_summary": {"review_score_desc": summary},
                       "reviews": reviews})


def test_page_run_empty_page_ends_but_counts_summary(spark):
    pages = _pages(spark, [(1, _page("A", 2, "c2")), (2, _page("B", 0, "c3")), (3, _page("C", 1, "c4", 9))])
    summ, rev = N.page_run(pages)
    assert [r["reviewScoreDesc"] for r in summ.collect()] == ["A"]
    assert sorted(r["id"] for r in rev.collect()) == ["r0", "r1"]


def test_page_run_only_empty_page(spark):
    summ, rev = N.page_run(_pages(spark, [(1, _page("B", 0, "c2"))]))
    assert [r["reviewScoreDesc"] for r in summ.collect()] == ["B"] and rev.count() == 0


def test_page_run_failed_first_page(spark):
    summ, rev = N.page_run(_pages(spark, [(1, "oops"), (2, _page("B", 3, "c3"))]))
    assert summ.count() == 0 and rev.count() == 0


def test_page_run_repeated_cursor_stops_after_page(spark):
    pages = _pages(spark, [(1, _page("A", 1, "c2")), (2, _page("B", 1, "c2", 5)), (3, _page("C", 1, "c9", 7))])
    _, rev = N.page_run(pages)
    assert sorted(r["id"] for r in rev.collect()) == ["r0", "r5"]


def test_page_run_cap(spark):
    pages = _pages(spark, [(1, _page("A", 3, "c2")), (2, _page("B", 3, "c3", 3)), (3, _page("C", 3, "c4", 6))])
    _, rev = N.page_run(pages, cap=4)
    assert sorted(r["id"] for r in rev.collect()) == ["r0", "r1", "r2", "r3"]


# ------------------------------------------------------------------ merge / ingest
def test_merge_store_only_and_none(spark):
    ids = spark.createDataFrame([(0, 1), (1, 2)], "seq long, appid int")
    body = json.dumps({"1": {"success": True, "data": {"name": "X", "metacritic": {"score": 90}}}})
    store = N.store_records(landing_payloads(spark.createDataFrame([(1, body)], "id int, body string")))
    stats = spark.createDataFrame([], "id int, " + ", ".join(f"{f} int" for f in N.STATS_FIELDS))
    summ = spark.createDataFrame([], "id int, reviewNumReviews int, reviewScore int, reviewScoreDesc string, "
                                     "reviewTotalPositive int, reviewTotalNegative int, reviewTotalReviews int")
    rows = {r["id"]: r for r in J.merge_sources(ids, store, stats, summ, "t").collect()}
    assert (rows[1]["store_status"], rows[1]["steamspy_status"], rows[1]["reviews_status"]) == ("ok", "missing", "missing")
    assert rows[1]["name"] == "X" and rows[1]["metacritic"] == 90
    assert (rows[2]["store_status"], rows[2]["name"], rows[2]["owners_min"]) == ("missing", "", 0)


def test_ingest_rerun_changes_nothing(spark, cat):
    from quarry.sources import landing as L
    base = Catalog.empty_catalogue(spark)
    args = (L.id_texts(cat), L.store_bodies(cat), L.stats_bodies(cat), L.review_page_bodies(cat))
    first = J.ingest(*args, catalog=base, run_ts="t").catalog
    second = J.ingest(*args, catalog=first, run_ts="t").catalog
    for name in ("Developer", "GameDeveloper", "Category", "Game"):
        a = sorted(map(tuple, first.df(name).collect()))
        b = sorted(map(tuple, second.df(name).collect()))
        assert a == b, name


def test_resume_difference_of_itself_is_empty(cat):
    ids = cat.df("documents").select("doc_id")
    assert J.resume_difference(ids, "doc_id", [ids]).count() == 0


def test_offset_resume_limit_order(spark):
    texts = spark.createDataFrame([(i, str(v)) for i, v in enumerate([5, 6, 7, 5, 8, 9])], "seq long, appid string")
    done = spark.createDataFrame([(7,)], "id int")
    got = J.select_ids(texts, offset=1, limit=3, processed=[done]).orderBy("seq").collect()
    assert [r["appid"] for r in got] == [6, 5, 8]


def test_ingest_with_checkpoint_matches_lazy(spark, cat):
    from quarry.sources import landing as L
    args = (L.id_texts(cat), L.store_bodies(cat), L.stats_bodies(cat), L.review_page_bodies(cat))
    lazy = J.ingest(*args, run_ts="t").entities
    cut = J.ingest(*args, run_ts="t", checkpoint=True).entities
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, cut.collect()))


def test_include_cursor_per_parent(cat):
    orders = cat.table("orders")
    top = orders.find_many(where={"o_orderkey": {"lt": 3}})
    full = orders.include_flat(top, "lineitems", {"order": {"l_linenumber": "asc"}})
    rows = sorted((r["o_orderkey"], r["lineitems_l_linenumber"]) for r in full.collect()
                  if r["lineitems_l_linenumber"] is not None)
    parent, line = rows[1]
    cur = cat.df("lineitem").where(f"l_orderkey = {parent} AND l_linenumber = {line}").limit(1).collect()[0]
    cursor = {c: cur[c] for c in cat.df("lineitem").columns}
    got = orders.include_flat(top, "lineitems", {"order": {"l_linenumber": "asc"}, "cursor": cursor})
    kept = {(r["o_orderkey"], r["lineitems_l_linenumber"]) for r in got.collect() if r["lineitems_l_linenumber"] is not None}
    assert (parent, line) in kept and all(l >= line for _, l in kept)
