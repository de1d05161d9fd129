"""Benchmark decontamination: every item-sized window by sums over shared shingles, SimHash distance of the best.

DataFrame operations only.  Words are lower-cased runs without white space; a
shingle is ``WORDS`` of them.

1. Documents' shingles that any item holds are kept, each once a document, and
   counted.  A window that resembles an item shares most of the item's weight,
   so it shares one of the item's rarest shingles that make up the rest; a
   document and an item meet by those alone, and a phrase that many items and
   documents share brings none of them together.  Of the pairs that meet, those
   whose shared shingles all together weigh less than ``THRESHOLD`` per cent of
   the item have no such window and go.
2. A shared shingle counts for the windows of the item's size that start in one
   interval: from where it comes in, or from behind the occurrence that is as
   many before it as the item has, to its own place.  So the common weight of
   all windows is a running sum of changes, at most two a shared shingle, and so
   is the weight of the windows themselves.  Between changes nothing differs, so
   the best of all starts is among them.
3. The weighted Jaccard similarity of the two bags of shingles, in whole
   numbers, must reach ``THRESHOLD`` per cent.
4. The best window and its item get 64-bit SimHash fingerprints of their
   weighted shingles; their Hamming distance is a column and drops nothing.

A shingle that several items hold, counted by their different texts, weighs
half of one that a single item holds; a shingle of no item weighs as much as the
latter.  So weights differ by ``RATIO`` at most, and a copy whose plain
similarity is 6/7 or more reaches 75 per cent under any of these weights.

Defined cases: null and empty texts or items match nothing; an item with fewer
than ``WORDS`` words is one shingle and matches documents that are just these
words; a document shorter than an item is one window; rows with the same id and
text count once; an empty table gives no rows; rows without an id and other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stage

WORDS = 5
THRESHOLD = 75
BITS = 64
WEIGHT = 2520
RATIO = 2
#: Items' shingles are broadcast only when counted below this.
BROADCAST_ROWS = 200_000


def words(text: str) -> str:
    return rf"array_remove(split(lower({text}), '[\\x20\\x09-\\x0D]+'), '')"


def shingles(array: str, size: int = WORDS) -> str:
    """Hashes of the array's shingles in order; the whole array as one if it is shorter."""
    inner = ", ".join(f"{array}[i + {k}]" for k in range(size))
    return (f"CASE WHEN size({array}) >= {size} THEN transform(sequence(0, size({array}) - {size}), i -> xxhash64({inner})) "
            f"WHEN size({array}) > 0 THEN array(xxhash64(array_join({array}, ' '), size({array}))) ELSE array() END")


def with_shingles(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return df.selectExpr(*keys, f"{words(text)} AS w").selectExpr(*keys, "size(w) AS n", f"{shingles('w')} AS sh")


def fingerprints(bag: DataFrame, keys: list[str]) -> DataFrame:
    """The SimHash of each key's bag (``h``, ``c`` times, weight ``weight``): one sum a bit, then the signs."""
    sums = [F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("c") * F.col("weight")).otherwise(-F.col("c") * F.col("weight"))).alias(f"b{b}") for b in range(BITS)]
    sign = [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    bits = sign[0]
    for s in sign[1:]:
        bits = bits.bitwiseOR(s)
    mass = F.sum(F.col("c") * F.col("weight")).alias("mass")
    return bag.groupBy(*keys).agg(*sums, mass).select(*keys, "mass", bits.alias("print"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (word), n_words, distance and similarity (per mille) of every document's best window for each item it holds."""
    items = with_shingles(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").selectExpr("cast(item_id AS long) AS item_id", "text").distinct(), ["item_id"])
    items = stage(items, "items").where("n > 0").withColumn("item", F.xxhash64("item_id", "sh"))
    item_sh = items.selectExpr("item", "item_id", "n AS size", "xxhash64(sh) AS same", "explode(sh) AS h")
    weight = item_sh.groupBy("h").agg(F.countDistinct("same").alias("df")).selectExpr("h", f"{WEIGHT} div least(df, {RATIO}) AS weight")
    bags = item_sh.groupBy("item", "item_id", "size", "h").agg(F.count("*").alias("ic")).join(weight, "h")
    bags = stage(bags, "item-shingles")
    small = bags.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    masses = bags.groupBy("item").agg(F.sum(F.col("ic") * F.col("weight")).alias("item_mass"))

    # 1. hits, and the pairs whose hits can be enough
    doc_sh = with_shingles(documents(docs).withColumn("rid", F.xxhash64("text")), ["doc_id", "rid"])
    # the outer form keeps the optimizer from repeating the shingle expression in a filter; a null never joins
    spots = doc_sh.selectExpr("doc_id", "rid", "n", "posexplode_outer(sh) AS (pos, h)")
    doc, pair = ["doc_id", "rid"], ["doc_id", "rid", "item"]
    known = spots.join(hint(bags.select("h").distinct()), "h").groupBy(*doc, "n", "h").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    known = stage(known, "spots")
    # an item's rarest shingles that weigh more than what a match may lack
    counted = bags.join(known.groupBy("h").agg(F.count("*").alias("docs")), "h", "left").join(masses, "item").withColumn("docs", F.coalesce("docs", F.lit(0)))
    rarer = Window.partitionBy("item").orderBy("docs", "h").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum(F.col("ic") * F.col("weight")).over(rarer), F.lit(0)))
    rare = counted.where((F.col("before") * 100 <= F.col("item_mass") * (100 - threshold)) & (F.col("docs") > 0)).select("item", "size", "h")
    met = known.join(hint(rare), "h").where((F.col("size") >= WORDS) | (F.col("n") == F.col("size"))).select(*pair).distinct()
    met = stage(met, "met")
    hits = stage(met.join(known, doc).join(bags, ["item", "h"]), "hits")
    most = hits.groupBy(*pair).agg(F.sum(F.least(F.size("ps"), F.col("ic")) * F.col("weight")).alias("most")).join(masses, "item")
    most = most.where(F.col("most") * 100 >= F.col("item_mass") * threshold).select(*pair, "item_mass")
    held = stage(hits.join(most, pair).selectExpr("*", f"greatest(1, least(size, n) - {WORDS - 1}) AS m", "greatest(0, n - size) AS last"), "held")

    # 2. where the sums of the windows change
    changes = "array(named_struct('start', a, 'common', {0}, 'less', {1}), named_struct('start', z, 'common', -{0}, 'less', -{1}))"
    inside = held.selectExpr(*pair, "m", "last", "weight", "inline(transform(ps, (p, i) -> named_struct('p', p, 'q', IF(i >= ic, ps[cast(i - ic AS int)], -1))))")
    inside = inside.selectExpr(*pair, "last", "greatest(0, p - m + 1, q + 1) AS a", "p + 1 AS z", "weight")
    inside = inside.selectExpr(*pair, "last", f"inline({changes.format('weight', '0L')})")
    # a window weighs WEIGHT a shingle, less what its shingles of any item weigh below that
    light = known.join(hint(weight.where(f"weight < {WEIGHT}")), "h").selectExpr(*doc, f"{WEIGHT} - weight AS lack", "explode(ps) AS p").distinct()
    light = held.select(*pair, "m", "last").distinct().join(light, doc).selectExpr(*pair, "last", "greatest(0, p - m + 1) AS a", "p + 1 AS z", "lack")
    light = light.selectExpr(*pair, "last", f"inline({changes.format('0L', 'lack')})")
    steps = inside.unionByName(light).where("start <= last").groupBy(*pair, "start").agg(F.sum("common").alias("common"), F.sum("less").alias("less"))
    upto = Window.partitionBy(*pair).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select(*pair, "start", F.sum("common").over(upto).alias("common"), F.sum("less").over(upto).alias("less"))

    # 3. exact similarity
    named = held.select(*pair, "item_id", "size", "m", "item_mass").distinct()
    scored = sums.join(named, pair).selectExpr("*", f"{WEIGHT} * m - less + item_mass - common AS either").where(F.col("common") * 100 >= F.col("either") * threshold)
    scored = scored.withColumn("similarity", F.expr("(common * 1000) div either"))
    order = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start", "rid")
    best = stage(scored.withColumn("r", F.row_number().over(order)).where("r = 1").select(*pair, "item_id", "start", "size", "m", "similarity"), "best")

    # 4. fingerprints
    windows = best.select(*doc, "start", "m").distinct()
    again = documents(docs).withColumn("rid", F.xxhash64("text")).join(windows.select(*doc).distinct(), doc, "left_semi").distinct()
    cut = with_shingles(again, doc).join(windows, doc).selectExpr(*doc, "start", "m", "explode_outer(slice(sh, start + 1, m)) AS h")
    bag = cut.groupBy(*doc, "start", "m", "h").agg(F.count("*").alias("c")).join(hint(weight), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(WEIGHT)).cast("long"))
    prints = fingerprints(bag, [*doc, "start", "m"]).drop("mass")
    item_prints = fingerprints(bags.join(best.select("item").distinct(), "item", "left_semi").withColumnRenamed("ic", "c"), ["item"]).selectExpr("item", "print AS item_print")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("distance")
    return (best.join(prints, [*doc, "start", "m"]).join(item_prints, "item")
            .select("doc_id", "item_id", "start", F.col("size").alias("n_words"), distance, "similarity"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns; rows without an id stay."""
    leaks = stage(find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("leak_id")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["leak_id"], "left_anti")
