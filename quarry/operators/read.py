"""Reads: ordering, distinct-by, cursor, skip/take, count.

All functions take and return DataFrames.  Orders are always made total by
appending the model key (or every column when the table has no key), so
``take``/``cursor``/``distinct`` are deterministic.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import search_terms, text_tokens

# One sort key: (column expression, ascending?).  NULLs sort first on
# ascending keys and last on descending keys (Spark's default).
SortKey = tuple[Column, bool]


def parse_order(order: Any) -> list[tuple[str, Any]]:
    """``{f: 'asc'}`` or ``[{f: 'desc'}, …]`` → ``[(f, dir), …]``."""
    if order is None:
        return []
    items = order if isinstance(order, (list, tuple)) else [order]
    out = []
    for item in items:
        if isinstance(item, str):
            out.append((item, "asc"))
            continue
        for f, d in item.items():
            out.append((f, d))
    return out


def relevance_score(df_cols: dict[str, Column], fields: list[str], search: str) -> Column:
    """Number of distinct query terms found in any of ``fields``."""
    terms = search_terms(search)
    tokens = F.array_distinct(F.flatten(F.array(*[text_tokens(df_cols[f]) for f in fields])))
    return F.size(F.array_intersect(F.array(*[F.lit(t) for t in terms]), tokens)).cast("int")


def sort_keys(df: DataFrame, order: Any, tiebreak: list[str], prefix: str = "") -> list[SortKey]:
    cols = {c: F.col(f"{prefix}{c}") for c in df.columns}
    keys: list[SortKey] = []
    seen = set()
    for f, d in parse_order(order):
        if f == "_relevance":
            score = relevance_score(cols, list(d["fields"]), d["search"])
            keys.append((score, str(d.get("sort", "desc")).lower() == "asc"))
            continue
        if f not in cols:
            raise ValueError(f"cannot order by unknown field {f!r}")
        asc = str(d).lower() == "asc"
        keys.append((cols[f], asc))
        seen.add(f)
    for f in tiebreak:
        if f not in seen:
            keys.append((cols[f], True))
    return keys


def as_sort(keys: list[SortKey], reverse: bool = False) -> list[Column]:
    out = []
    for c, asc in keys:
        a = asc != reverse
        out.append(c.asc_nulls_first() if a else c.desc_nulls_last())
    return out


def after_or_at(keys: list[SortKey], values: list[Column]) -> Column:
    """Lexicographic "row sorts at or after the cursor" predicate.

    ``values`` are the cursor row's sort-key values (scalar subqueries).
    NULL is the smallest value, matching ``as_sort``.
    """
    def gt(c, v, asc):
        if asc:   # nulls first
            return (c.isNotNull() & v.isNull()) | (c > v)
        return (c.isNull() & v.isNotNull()) | (c < v)

    pred = F.lit(True)  # equal on every key → the cursor row itself
    for (c, asc), v in reversed(list(zip(keys, values))):
        pred = gt(c, v, asc) | (c.eqNullSafe(v) & pred)
    return pred


def first_per_group(df: DataFrame, by: list[str], keys: list[SortKey]) -> DataFrame:
    """First row per ``by`` group in the given order (deterministic distinct).

    ``row_number() = 1`` lets Spark insert a partial per-group limit before the
    shuffle (WindowGroupLimit), so a hot group ships one row per map task.
    """
    rn = "__rn"
    w = Window.partitionBy(*[F.col(b) for b in by]).orderBy(*as_sort(keys))
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def page(df: DataFrame, keys: list[SortKey], *, cursor_values: list[Column] | None = None,
         skip: int | None = None, take: int | None = None, ordered: bool = True) -> DataFrame:
    """cursor → skip → take over a total order.  Negative take reads backwards."""
    if skip is not None and skip < 0:
        raise ValueError("skip must be >= 0")
    if cursor_values is not None:
        if take is not None and take < 0:
            # backwards from the cursor: rows at or before it
            pred = after_or_at([(c, not a) for c, a in keys], cursor_values)
        else:
            pred = after_or_at(keys, cursor_values)
        df = df.where(pred)
    reverse = take is not None and take < 0
    if take is None and skip:
        return slice_rows(df, as_sort(keys), skip)
    if take is not None and abs(take) + (skip or 0) > SMALL_TAKE:
        # backwards, the slice is cut from the reversed order and then given in the requested one
        order = [(c, not a) for c, a in keys] if reverse else keys
        rows = slice_rows(first_rows(df, order, abs(take) + (skip or 0)), as_sort(order), skip or 0, abs(take))
        return rows.orderBy(*as_sort(keys)) if reverse else rows
    if ordered or take is not None:
        df = df.orderBy(*as_sort(keys, reverse=reverse))
    if skip:
        df = df.offset(skip)
    if take is not None:
        df = df.limit(abs(take))
    # read backwards, given in the requested order
    return df.orderBy(*as_sort(keys)) if reverse else df


#: Up to so many rows the first ones of an order may meet in one task.
SMALL_TAKE = 10_000
#: Quantiles that the cutoff of a large take is chosen from.
GRID = 1000


def first_rows(df: DataFrame, keys: list[SortKey], n: int) -> DataFrame:
    """Rows among which the first ``n`` of the order lie, by a cutoff on the first sort key.

    A quantile sketch of the key (merged from all tasks) proposes the cutoff and
    an exact count confirms it, so what is left to sort is little more than ``n``
    rows and those that share the cutoff's value.  Keys without quantiles
    (texts) leave the table as it is."""
    key, asc = keys[0]
    kind = df.select(key.alias("k")).schema["k"].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df
    # timestamps as microseconds; the filter compares the column itself with a value of its own type
    grid = F.percentile_approx(key, [i / GRID for i in range(1, GRID)], 10 * GRID)
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("known"), grid.alias("grid")).first()
    nulls = seen["rows"] - seen["known"]
    if seen["rows"] <= n or not seen["known"]:
        return df
    first = nulls if asc else 0  # NULLs sort first ascending, last descending
    values = seen["grid"] if asc else seen["grid"][::-1]
    at = max(0, min(len(values) - 1, int((n - first) / seen["known"] * GRID) + 1))
    while at < len(values):
        bound = F.lit(values[at]).cast(kind)
        inside = (key.isNull() | (key <= bound)) if asc else (key >= bound)
        if df.where(inside).count() >= n:
            return df.where(inside)
        at += max(1, GRID // 100)
    return df


def slice_rows(df: DataFrame, sort: list[Column], skip: int = 0, take: int | None = None, position: str | None = None) -> DataFrame:
    """Rows ``skip`` … ``skip + take`` of a sorted table, without one task that sees them all.

    The sorted rows are checkpointed with their partition and place; the sizes
    of the partitions (one small row each) say where the slice begins and ends.
    ``position`` names a column for each row's place in the slice, from 1.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    rows = (df.orderBy(*sort).withColumn("__part", F.spark_partition_id())
            .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint())
    sizes = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    end = None if take is None else skip + take
    at, keep = 0, F.lit(False)
    whole: list[int] = []
    starts: list[int] = []
    for part, n in sizes:
        low, high = max(skip - at, 0), n if end is None else min(n, end - at)
        if low == 0 and high == n:
            whole.append(part)
        elif low < high:
            keep = keep | ((F.col("__part") == part) & (F.col("__place") >= low) & (F.col("__place") < high))
        starts += [0] * (part - len(starts)) + [at]
        at += n
    if whole:  # the whole partitions are neighbours
        keep = keep | F.col("__part").between(whole[0], whole[-1])
    rows = rows.where(keep)
    if position:
        before = F.element_at(F.array(*[F.lit(s) for s in starts or [0]]), F.col("__part") + 1)
        rows = rows.withColumn(position, (before + F.col("__place") - skip + 1).cast("long"))
    return rows.drop("__part", "__place")


def rank_in_groups(df: DataFrame, by: list[str], sort: list[Column], name: str) -> DataFrame:
    """``name``: each row's place in its group's order, from 1, however large a group is.

    Rows are range-partitioned by group and order, so a large group lies over
    several partitions, one run of rows in each.  The runs' sizes (a row per
    group and partition) give every run's offset by prefix sums; a row's rank is
    the offset and its place in the run.  No task sees a group as a whole."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(*[F.col(b) for b in by], *sort).sortWithinPartitions(*[F.col(b) for b in by], *sort)
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()}).checkpoint()
    runs = rows.groupBy(*by, "__part").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(b).alias(f"__g_{b}") for b in by], F.col("__part").alias("__p"), "__first", "__before")
    cond = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__g_{b}")) for b in by], F.col("__part") == F.col("__p"))
    out = rows.join(runs, cond).withColumn(name, F.col("__before") + F.col("__seq") - F.col("__first") + 1)
    return out.select(*df.columns, name)


def cursor_row_values(df_all: DataFrame, keys_on: list[tuple[str | Column, bool]],
                      cursor: dict) -> list[Column]:
    """Scalar subqueries for the cursor row's sort-key values.

    The cursor names a unique row; each of its sort keys becomes a scalar
    subquery, executed once and used as a literal (no join, no global window).
    """
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in cursor.items()])
    row = df_all.where(cond)
    return [row.select(expr.alias("v")).scalar() for expr in [k for k, _ in keys_on]]


def cursor_row_exists(df_all: DataFrame, cursor: dict) -> Column:
    """Whether the cursor names a row; without one, a read from it is empty."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in cursor.items()])
    return df_all.where(cond).select(F.count(F.lit(1)).alias("v")).scalar() > 0


def count_columns(df: DataFrame, select: dict | None) -> DataFrame:
    """``count()`` → ``_all``; ``count(select={f: True, _all: True})`` → per field."""
    if select is None or not select:
        return df.agg(F.count(F.lit(1)).alias("_all"))
    aggs = []
    for f, on in select.items():
        if not on:
            continue
        if f == "_all":
            aggs.append(F.count(F.lit(1)).alias("_all"))
        else:
            aggs.append(F.count(F.col(f)).alias(f))
    return df.agg(*aggs)
