import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quarry.llm import queries, spelling

from .helpers import EDGE, table


def distance_one(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute(rows):
    """Rows of (doc_id, text): word, form, root, n, n_near, form_n."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def edit(rng, word):
    i = rng.randrange(len(word) + 1)
    c = rng.choice("abcé×")
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


def texts(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(7, 12))) for _ in range(14)] + ["a" * 7, "a" * 8, "x" * 400]
    out = []
    for w in base:
        once = edit(rng, w)
        out += [" ".join([w.title()] * 130), " ".join([w] * 120), " ".join([once] * 12), edit(rng, once)]
        out += [f"{v} {v.upper()}, {v}" for v in [edit(rng, w) for _ in range(12)] + [edit(rng, edit(rng, w)) for _ in range(6)]]
    out += ["chainword " * 50] * 10 + ["chainworp " * 6] * 5 + ["chainwxrp"] * 2
    hot = "commonpart"  # many words that share a long beginning or end
    tails = ["".join(rng.choice("abc") for _ in range(4)) for _ in range(60)]
    return EDGE + out + [f"{hot}{t} {hot}{t} {t}{hot} {t}{hot}" for t in tails] + ["naïve-Fähre ÀÉÎõüÿ×÷ab ÀÉÎõüÿ×÷ab"]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("crowded", [1, 30, spelling.CROWDED])
def test_equals_plain_comparison(spark, crowded):
    t = texts()
    want = brute([(10 + i, x) for i, x in enumerate(t)])
    assert rows_of(spelling.spelling_forms(table(spark, t), crowded=crowded)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1]) and max(r[4] for r in want) > 5


def test_nothing_and_rows_without_an_id(spark):
    assert spelling.spelling_forms(table(spark, [])).collect() == []
    df = table(spark, ["something something", None]).selectExpr("cast(null AS long) AS doc_id", "text")
    assert spelling.spelling_forms(df).collect() == []


def test_ties_take_the_first_word(spark):
    t = ["abcdefgh " * 40, "abcdefgx " * 40, "abcdefg " * 2]
    rows = rows_of(spelling.spelling_forms(table(spark, t, extra=False)))
    assert rows == brute([(10 + i, x) for i, x in enumerate(t)])


def test_crowded_keys_are_divided(spark):
    """Words that share one half don't meet each other in pairs."""
    rng = random.Random(2)
    words = {"longcommonbeginning" + "".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(800)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert spelling.near_words(df).count() == sum(distance_one(a, b) for a in words for b in words if a < b)
    whole = spelling.candidates(df, crowded=1 << 60)
    assert whole.count() >= spelling.near_words(df).count()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(spelling.SQL).fetchall(), key=lambda r: r[0])
    assert rows_of(queries.op13_spelling_variants(spark, sf)) == want and want
