import os
import random
import time

import numpy as np
import pytest

from quarry.llm import ngram_join
from quarry.llm.common import discard, stage
from quarry.llm.components import components

from .helpers import EDGE, edited, families, prose, shingles, table


def brute(rows):
    sets = {d: set(shingles(t)) for d, t in rows}
    low = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {(d, len(sets[d]), low[d]) for d in sets}


def check(spark, texts):
    df = table(spark, texts)
    got = {tuple(r) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute([(10 + i, t) for i, t in enumerate(texts)])


def test_families_edges_and_a_long_text(spark):
    rng = random.Random(5)
    long = prose(rng, 30_000)
    check(spark, families() + EDGE + [long, edited(rng, long, 300), edited(rng, long, 900)])


def test_large_lists_and_clusters_take_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    base = prose(rng, 120)
    chain = [base]
    for _ in range(12):  # neighbours link, ends don't
        chain.append(edited(rng, chain[-1], 2))
    check(spark, chain + [edited(rng, base, rng.randint(0, 9)) for _ in range(40)] + families(3, 6))


def test_empty_table_and_repeated_rows(spark):
    assert ngram_join.near_duplicates(table(spark, []).limit(0)).collect() == []
    df = table(spark, ["a b c d e f g", "a b c d e f g", "z"])
    got = sorted(map(tuple, ngram_join.near_duplicates(df.unionByName(df)).collect()))
    assert got == [(10, 3, 10)] * 2 + [(11, 3, 10)] * 2 + [(12, 1, 12)] * 2


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    df = table(spark, ["a b c d e f g", "a b c d e f g", None, ""]).unionByName(table(spark, ["a b c d e f g"]).selectExpr("cast(null AS long) AS doc_id", "* EXCEPT (doc_id)"))
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 10, 12, 13]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 530)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


def brute_links(rows):
    sets = [set(shingles(t)) for _, t in rows]
    return [sum(a != b and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)) if x else 0 for a, x in enumerate(sets)]


@pytest.mark.parametrize("cluster,block", [(ngram_join.CLUSTER_SETS, ngram_join.BLOCK_SETS), (4, 3)])
def test_every_link_is_counted(spark, monkeypatch, cluster, block):
    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", cluster)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(3)
    base = prose(rng, 120)
    chain = [base]
    for _ in range(12):  # neighbours link, ends don't
        chain.append(edited(rng, chain[-1], 2))
    texts = chain + [edited(rng, base, rng.randint(0, 6)) for _ in range(30)] + [base] * 3 + families(3, 6) + EDGE
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ngram_join.linked_documents(table(spark, texts)).collect()}
    assert [got[d].n_links for d, _ in rows] == brute_links(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.values()} == brute(rows)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files_and_can_be_deleted(spark):
    before = shuffle_files(spark)
    df = stage(spark.range(1000).selectExpr("id % 7 AS k").repartition(5, "k").groupBy("k").count(), "test-stage")
    for _ in range(50):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 7 and os.path.exists(folder)
    discard(df)
    assert not os.path.exists(folder)


def test_what_copies_share_comes_before_what_unrelated_texts_share(spark):
    rng = random.Random(11)
    common = [prose(rng, 10) for _ in range(40)]  # passages that link unrelated texts to one cluster if they count as rare
    texts = []
    for _ in range(60):
        base = " ".join([prose(rng, 60), *rng.sample(common, 3)])
        texts += [base, *(f"{base} {prose(rng, 2)}" for _ in range(3))]
    _, nodes, kept = ngram_join.clustered_texts(table(spark, texts))
    assert max(r["count"] for r in nodes.groupBy("cluster").count().collect()) == 4
    assert kept.count() == len(texts)
    check(spark, texts)
