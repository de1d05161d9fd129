"""Column profile (G13): ``describe(include="all")`` transposed — one row per
column with count, unique, top, freq, mean, std, min, 25%, 50%, 75%, max.

Numeric columns get count / mean / sample std / min / quartiles (linear
interpolation) / max; every other column (text, boolean, date and time, by its
text) gets count / unique / top / freq.  Ties for ``top`` go to the smallest value.

All of it is partially aggregated: one ``agg`` over the table, and one grouped
count of (column, value) pairs.  Unique, top and freq are aggregates of those
counts.  Quartiles are read off the counts in value order: the values are
range-partitioned, partition totals (one small row each) say where each part
begins, and running sums stay within a part, so no task holds a column.
``exact=False`` takes ``percentile_approx`` and ``approx_count_distinct``
instead, which need no pass over the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
QUARTILES = (0.25, 0.5, 0.75)
STATS = "column string, count bigint, mean double, std double, min double, max double"


def _stacked(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" for c in names)
    return df.selectExpr(f"stack({len(names)}, {pairs}) AS (column, value)").where("value IS NOT NULL")


def quartiles(counts: DataFrame) -> DataFrame:
    """(column, p25, p50, p75) from (column, value, n), without a window over a column."""
    from ..session import checkpoint_dir
    checkpoint_dir(counts.sparkSession)
    parts = (counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
             .withColumn("part", F.spark_partition_id()).checkpoint())
    totals = parts.groupBy("column", "part").agg(F.sum("n").alias("n_part"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("n_part").over(before), F.lit(0)))
    sizes = totals.groupBy("column").agg(F.sum("n_part").alias("n_all"))
    run = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (parts.join(totals.select("column", "part", "base"), ["column", "part"]).join(sizes, "column")
              .withColumn("upto", F.col("base") + F.sum("n").over(run)))
    ends, cols = [], []
    for i, q in enumerate(QUARTILES):
        place = F.lit(q) * (F.col("n_all") - 1)
        for name, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.min(F.when(F.col("upto") > at, F.col("value"))).alias(f"{name}{i}"))
        share = place - F.floor(place)
        cols.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * share).alias(f"p{int(q * 100)}"))
    return placed.groupBy("column", "n_all").agg(*ends).select("column", *cols)


def profile(df: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    text = [f.name for f in df.schema.fields if f.name not in num]
    spark = df.sparkSession
    aggs, rows = [], []
    for c in num + text:
        x = F.col(c).cast("double") if c in num else F.col(c)
        aggs.append(F.count(x).alias(f"{c}__count"))
        if c in num:
            aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
            if not exact:
                aggs.append(F.percentile_approx(x, list(QUARTILES), accuracy).alias(f"{c}__q"))
        elif not exact:
            aggs.append(F.approx_count_distinct(x).alias(f"{c}__unique"))
        none = F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                             *[(F.col(f"{c}__{n}") if c in num else none).alias(n) for n in ("mean", "std", "min", "max")],
                             *([] if exact else [
                                 (F.lit(None).cast("bigint") if c in num else F.col(f"{c}__unique")).alias("unique"),
                                 *[(F.col(f"{c}__q")[i] if c in num else none).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]])))
    if not rows:
        return spark.createDataFrame([], "column string, count bigint, unique bigint, top string, freq bigint, mean double, "
                                         "std double, min double, p25 double, p50 double, p75 double, max double")
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tops = spark.createDataFrame([], "column string, n_values bigint, top string, freq bigint")
    if text:
        counts = _stacked(df, text, "STRING").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("b"))
        tops = best.select("column", "n_values", F.col("b.value").alias("top"), (-F.col("b.neg_n")).alias("freq"))
    out = out.join(tops, "column", "left")
    if exact:
        points = spark.createDataFrame([], "column string, p25 double, p50 double, p75 double")
        if num:
            points = quartiles(_stacked(df, num, "DOUBLE").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        is_text = F.col("column").isin(text) if text else F.lit(False)
        out = out.join(points, "column", "left").withColumn("unique", F.when(is_text, F.coalesce("n_values", F.lit(0).cast("bigint"))))
    return out.select("column", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max")
