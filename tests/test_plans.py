"""Physical-plan checks: the plans Catalyst picks for our operators are the
ones we rely on at scale (pushdown, pruning, semi/anti joins, partial
aggregation, per-group limits before the shuffle)."""
from pyspark.sql import functions as F

from quarry.operators import mutate as M


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(cat):
    df = cat.table("orders").find_many(where={"o_orderstatus": "F", "o_totalprice": {"gt": 1000}},
                                       select=["o_orderkey", "o_totalprice"])
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in p


def test_relation_filters_become_semi_anti_and_existence_joins(cat):
    t = cat.table("orders")
    assert "LeftAnti" in plan(t.find_many(where={"lineitems": {"none": {}}}))
    assert "LeftSemi" in plan(t.find_many(where={"lineitems": {"some": {"l_quantity": {"gt": 40}}}}))
    ored = t.find_many(where={"OR": [{"o_totalprice": {"lt": 5000}}, {"lineitems": {"some": {"l_tax": 0.0}}}]})
    assert "ExistenceJoin" in plan(ored)


def test_group_by_is_partial_then_final(cat):
    df = cat.table("lineitem").group_by("l_returnflag", sum={"l_quantity": True}, count=True)
    p = plan(df)
    assert p.count("HashAggregate") >= 2 and "partial_sum" in p


def test_first_per_group_limits_before_the_shuffle(cat):
    df = cat.table("orders").find_many(distinct=["o_custkey"], order={"o_orderdate": "asc"})
    df._jdf.queryExecution().optimizedPlan()
    assert "WindowGroupLimit" in plan(df)


def test_last_write_wins_limits_before_the_shuffle(cat):
    ev = cat.df("events").select("user_id", "event_id", F.col("event_id").alias("seq"))
    assert "WindowGroupLimit" in plan(M.last_per_key(ev, ("user_id",), "seq"))


def test_upsert_is_one_join_on_the_key(cat):
    part = cat.df("part")
    p = plan(M.upsert(part, part.where("p_size > 45"), cat.model("part")).table)
    assert p.count("FullOuter") == 1
