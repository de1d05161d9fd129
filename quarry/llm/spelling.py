"""Spelling variants: words one edit apart, found by asymmetric chunks.

Of two words that differ by one edit (a code point inserted, deleted or
replaced), the one that isn't longer contributes two disjoint chunks, its
halves; one edit leaves one of them whole.  The other word contributes its grams
of the chunks' lengths with their places; a chunk can have moved by one place at
most, so only grams within that shift of a chunk's place are joined, as equal
keys.  A chunk that many words share says little, so where a key holds many
words the rule is applied again to what the key leaves open: the open part's
halves are two disjoint chunks, and the key grows by the one that stays whole.
This ends when no key is crowded or one place is open.  Candidates are verified.

A key's open part [a, b) lies in the shorter word; the longer one has one more
code point there.  Each word gives at most four keys a round as the shorter
word and eight as the other, whatever its length.

Defined cases: null and empty texts and rows without an id have no words; texts
and words of any length are taken whole; repeated rows count each; of near
words with the same number of occurrences the first in code-point order is the
form; an empty table gives no rows; other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, release, stage

#: Every so many-th run, by its checksum, loses one code point.
DAMAGED = 31
SHORTEST = 7
LEAST = 2
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: A task's counts are handed on when they hold so many words.
COUNTED_WORDS = 300_000
#: Keys with more pairs than this are divided once more.
CROWDED = 256
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def damaged(doc_id: int, run: str) -> str:
    """The run itself, or without one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """word and n, the occurrences over all documents."""
    runs = re.compile(r"[a-zÀ-ÿ]{%d,}" % shortest)  # shorter runs can't become longer

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counter()
        for pdf in frames:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                for run, n in Counter(runs.findall(text.encode().translate(LOWER).decode())).items():
                    word = damaged(doc_id, run)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= COUNTED_WORDS:
                    yield pd.DataFrame({"word": list(held), "n": np.fromiter(held.values(), dtype=np.int64)})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": np.fromiter(held.values(), dtype=np.int64)})
        release()

    return documents(docs).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halves() -> Column:
    """The two ways to go on from an open part [a, b): its right half stays whole, or its left half."""
    middle = F.expr("(a + b) div 2")
    return F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))


def divide(df: DataFrame) -> DataFrame:
    return df.withColumn("open", halves()).withColumn("a", F.col("open.a")).withColumn("b", F.col("open.b")).drop("open")


def with_key(df: DataFrame) -> DataFrame:
    """The key: the word without its open part; in a longer word that part has one more code point."""
    rest = "concat(substring(word, 1, a), substring(word, b + 1 + length(word) - l))"
    return df.withColumn("key", F.expr(rest))


PLACE = ["l", "a", "b", "key"]


def candidates(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (x, y) of words that share a key, x not the longer one; each at least once if the words are one edit apart."""
    whole = words.select("word", F.length("word").alias("l"), F.lit(0).alias("a"), F.length("word").alias("b"))
    chunks = with_key(divide(whole))
    # as the other word: partners of its own length, or shorter by one
    grams = with_key(divide(whole.withColumn("l", F.explode(F.array(F.col("l"), F.col("l") - 1))).withColumn("b", F.col("l"))))
    out = None
    while True:
        sides = chunks.withColumn("gram", F.lit(0)).unionByName(grams.withColumn("gram", F.lit(1)))
        # every chunk meets the gram of its own word; a key counts where another word has it too
        sizes = sides.groupBy(PLACE).agg(F.sum(F.lit(1) - F.col("gram")).alias("chunks"), F.sum("gram").alias("grams")).where("chunks > 0 AND grams > 1")
        sizes = sizes.withColumn("again", (F.col("chunks") * F.col("grams") > crowded) & (F.col("b") - F.col("a") > 1)).drop("chunks", "grams")
        kept = stage(sides.join(sizes, PLACE), "spelling-kept")
        x = kept.where("gram = 0 AND NOT again").select(*PLACE, F.col("word").alias("x"))
        y = kept.where("gram = 1 AND NOT again").select(*PLACE, F.col("word").alias("y"))
        # words of one length meet from both sides; once is enough
        found = x.join(y, PLACE).where("length(x) < length(y) OR x < y").select("x", "y").where(one_edit())
        out = found if out is None else out.unionByName(found)
        rest = kept.where("again").select("word", "l", "a", "b", "gram")
        if not rest.limit(1).count():
            return out
        chunks, grams = (with_key(divide(rest.where(F.col("gram") == g).drop("gram"))) for g in (0, 1))


def one_edit() -> Column:
    return F.levenshtein("x", "y", 1) == 1


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Every pair (x, y) of words one edit apart, once."""
    return candidates(words, crowded).distinct()


def spelling_forms(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that occurs ``least`` times."""
    words = stage(word_counts(docs, shortest).where(F.col("n") >= least), "spelling-words")
    pairs = stage(near_words(words.select("word"), crowded), "spelling-pairs")
    both = pairs.selectExpr("inline(array(struct(x AS word, y AS near), struct(y AS word, x AS near)))")
    both = both.join(words.selectExpr("word AS near", "n AS near_n"), "near")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                   F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.col("form_n") >= F.col("n") * ratio
    found = stage(found.withColumn("form", F.when(fits, F.col("form"))).withColumn("form_n", F.when(fits, F.col("form_n"))), "spelling-forms")
    roots = follow(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """Each word's last form: every round joins links of twice the length, until none goes on.

    A form occurs ``RATIO`` times as often as its word, so paths are short and never come back.
    """
    while True:
        links = stage(links, "spelling-links")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(on, "root", "left")
        if not longer.where("further IS NOT NULL").limit(1).count():
            return links
        links = longer.select("word", F.coalesce("further", "root").alias("root"))


SQL = r"""WITH t AS MATERIALIZED (SELECT list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v, i FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS v FROM t),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(0, octet_length(encode(doc_id || ':' || run))), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), (2 * i + 1)::INT, 2))::BIGINT),
 lambda c, b: xor(c >> 8, crc.v[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM u, crc WHERE length(run) >= 7),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
 WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS key FROM (SELECT word, n, unnest(range(0, length(word) + 1))::INT AS i FROM w)),
p AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
f AS MATERIALIZED (SELECT word, n, count(*) AS n_near, max(near_n) AS m, arg_min(near, (-near_n, near)) AS form FROM p GROUP BY word, n),
g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN form END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN f USING (word)),
z AS (WITH RECURSIVE z(word, last, depth) AS (SELECT word, word, 0 FROM g UNION ALL SELECT z.word, g.form, depth + 1 FROM z JOIN g ON g.word = z.last WHERE g.form IS NOT NULL) SELECT word, arg_max(last, depth) AS root FROM z GROUP BY word)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM g JOIN z USING (word)"""
