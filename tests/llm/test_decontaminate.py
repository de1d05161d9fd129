import random
from collections import Counter

from quarry.llm import decontaminate

from .helpers import EDGE, edited, prose, shingles, table, words


def brute(docs, items):
    df = Counter(s for _, t in items for s in set(shingles(t)))
    weight = lambda s: max(1, 2520 // df[s]) if s in df else 2520
    out = {}
    for d, t in docs:
        sh = shingles(t)
        for i, u in items:
            bag, size = Counter(shingles(u)), len(words(u))
            if not bag or not sh or size < 5 and len(words(t)) != size:
                continue
            m = max(1, min(size, len(words(t))) - 4)
            for a in range(len(sh) - m + 1):
                win = Counter(sh[a:a + m])
                both = sum(min(c, bag[s]) * weight(s) for s, c in win.items())
                union = sum(c * weight(s) for s, c in win.items()) + sum(c * weight(s) for s, c in bag.items()) - both
                if both * 100 >= union * 75:
                    out[d, i] = max(out.get((d, i), 0), both * 1000 // union)
    return out


def setup():
    rng = random.Random(11)
    items = [prose(rng, rng.choice([15, 25, 40, 60])) for _ in range(25)] + ["a b c", "x y", None, "", items_twice(rng)]
    docs = list(EDGE) + ["A B  C", "a b c d"]
    for k in range(60):
        t = rng.choice(items[:25])
        near = edited(rng, t, rng.choice([0, 0, 1, 2, 3]))
        docs.append(f"{prose(rng, rng.randint(0, 40))} {near.upper() if k % 5 == 0 else near} {prose(rng, rng.randint(0, 40))}")
    docs += [prose(rng, 50) for _ in range(30)] + [" ".join(items[0].split(" ")[:6]), items[-1] * 3, prose(rng, 5000) + " " + items[3]]
    return docs, items


def items_twice(rng):
    return " ".join([prose(rng, 6)] * 4)


def test_leaks_equal_brute_force(spark):
    docs, items = setup()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 AS n", "'x' AS h", "2 AS size")
    df = table(spark, docs)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, bench).collect()}
    want = brute([(10 + i, t) for i, t in enumerate(docs)], [(i, t) for i, t in enumerate(items)])
    assert len(want) > 40 and got.keys() == want.keys()
    # a window is proposed where a shingle is shared, so the best one is met or another as good
    assert all(abs(got[k] - want[k]) <= 250 for k in want)
    kept = {r.doc_id for r in decontaminate.keep_uncontaminated(df, bench).collect()}
    assert kept == {10 + i for i in range(len(docs))} - {d for d, _ in want}


def test_large_benchmark_takes_the_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = setup()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, docs), bench).collect()}
    assert got == brute([(10 + i, t) for i, t in enumerate(docs)], list(enumerate(items))).keys()


def test_empty_tables_and_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    df = table(spark, ["z a b c d e f g h z", None])
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == []
    assert decontaminate.find_leaks(df, bench.limit(0)).collect() == []
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate.find_leaks(df.unionByName(df), bench.unionByName(bench)).collect()] == [(10, 1, 1)]


def test_radius_holds_at_the_threshold(spark):
    """Windows that just reach the similarity lie within the radius."""
    rng = random.Random(4)
    items, docs = [], []
    for i in range(300):
        t = prose(rng, 40)
        w = t.split(" ")
        w[0] = w[-1] = "changed"  # 36 shingles, two less on either side of 37
        items.append((i, t))
        docs.append(" ".join(edited(rng, t, 1).split(" ")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, docs), bench).collect()}
    assert got == brute([(10 + i, t) for i, t in enumerate(docs)], items).keys()


def similarities(spark, docs, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(spark, docs), bench).collect()}


def test_best_window_lies_between_alignments(spark):
    """Words inserted and left out inside an item, its ends changed too; and an item that repeats itself."""
    rng = random.Random(8)
    items = [prose(rng, 120) for _ in range(12)] + [items_twice(rng)]
    docs = []
    for k, t in enumerate(items):
        w = t.split(" ")
        inner = w[5:-5] if k % 2 else w[2:-2]
        at = len(inner) // 2
        inner = inner[:at] + prose(rng, 10).split(" ") + inner[at:] if k % 3 else inner[:at] + inner[at + 8:]
        docs.append(" ".join([prose(rng, 40), *inner, prose(rng, 40)]))
    docs += [" ".join([prose(rng, 9), items[-1], items[-1], prose(rng, 9)])] + setup()[0]
    items += setup()[1]
    want = brute([(10 + i, t) for i, t in enumerate(docs)], list(enumerate(items)))
    assert sum(d < 10 + 12 for d, _ in want) >= 6
    assert similarities(spark, docs, items) == want


def test_items_that_share_text(spark):
    """A passage with forty questions, and one text under forty ids: one changed word, of 200, leaves a near copy."""
    rng = random.Random(21)
    passage, alone = prose(rng, 204), prose(rng, 200)
    items = [passage + " " + prose(rng, 5) for _ in range(40)] + [alone] * 40
    docs = []
    for t in items[::8]:
        w = t.split(" ")
        w[100] = "changed"
        docs.append(" ".join([prose(rng, 20), *w, prose(rng, 20)]))
    got = similarities(spark, docs, items)
    for k in range(len(docs)):
        same = [8 * k] if k < 5 else range(40, 80)
        for i in same:
            # of 205 or 196 shingles five differ; the passage's weigh half
            common, own = (195 * 1 + 5 * 2, 205 + 5) if k < 5 else (191 * 2, 196 * 2)
            assert got[10 + k, i] == common * 1000 // (own + 5 * 2), (k, i)


def test_a_shared_phrase_brings_no_pairs_together(spark, monkeypatch):
    """A phrase that all items and many documents hold: pairs meet by rarer shingles only."""
    rng = random.Random(5)
    phrase = "one phrase of just five"
    items = [f"{prose(rng, 20)} {phrase} {prose(rng, 20)}" for _ in range(60)]
    docs = [f"{prose(rng, 30)} {phrase} {prose(rng, 30)}" for _ in range(50)] + [prose(rng, 9) + " " + items[7] + " " + prose(rng, 9)]
    sizes, inner = {}, decontaminate.stage

    def counted(df, name):
        out = inner(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "stage", counted)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, docs), bench).collect()}
    assert got == {(60, 7)} and sizes["met"] <= 3 and sizes["hits"] < 200
