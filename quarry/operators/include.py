"""Includes: related rows attached to each row.

* to-one  → left equi-join, the related row as a ``struct`` column (NULL when absent);
* to-many → ``collect_list`` grouped by the foreign key and a left join; with
  skip / take, children are ranked per parent first.  Childless parents get an
  empty array.
* ``include_flat`` gives the long form (one row per child) and
  ``include_chunks`` rows of a bounded number of children, for fan-outs that
  should never sit in one row.
* nested includes recurse on the related table first.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import compile_where, fresh_alias
from .read import SMALL_TAKE, after_or_at, as_sort, cursor_row_exists, cursor_row_values, parse_order, rank_in_groups, sort_keys

INCLUDE_ARGS = {"where", "order", "take", "skip", "cursor", "distinct", "include", "select"}
MAX_DEPTH = 5


def _args(value: Any) -> dict:
    if value is True:
        return {}
    if isinstance(value, dict):
        unknown = set(value) - INCLUDE_ARGS
        if unknown:
            raise ValueError(f"unknown include arguments {sorted(unknown)}")
        return value
    raise TypeError("include value must be True or a dict of arguments")


def related(cat, model: str, rel_name: str, args: dict, depth: int = 1) -> DataFrame:
    """The related table, filtered and with its own nested includes applied."""
    if depth > MAX_DEPTH:
        raise ValueError(f"include nesting deeper than {MAX_DEPTH}")
    rel = cat.model(model).relations[rel_name]
    target = cat.df(rel.target)
    if args.get("where"):
        a = fresh_alias(rel.target)
        target = target.alias(a).where(compile_where(cat, rel.target, args["where"], a, target)).select(
            *[F.col(f"{a}.{c}") for c in target.columns])
    if args.get("include"):
        target = include(cat, rel.target, target, args["include"], depth + 1)
    return target


def _children(cat, model: str, rel_name: str, args: dict, depth: int) -> tuple[DataFrame, list, list[str]]:
    """Children after ``distinct`` and ``cursor``, their sort keys, and the payload columns."""
    rel = cat.model(model).relations[rel_name]
    spec = cat.model(rel.target)
    children = related(cat, model, rel_name, args, depth)
    table = cat.df(rel.target)
    keys = sort_keys(children.select(*table.columns), args.get("order"), spec.tiebreak(table))
    payload = args.get("select")
    cols = [c for c in children.columns if not payload or payload.get(c) or c in rel.references]
    if args.get("distinct"):
        d = list(args["distinct"])
        w0 = Window.partitionBy(*[F.col(r) for r in rel.references], *[F.col(x) for x in d]).orderBy(*as_sort(keys))
        children = children.withColumn("__d", F.row_number().over(w0)).where("__d = 1").drop("__d")
    if args.get("cursor"):
        # the cursor names a row of the table, which the filter may leave out; children at or
        # after it in the requested order, or at or before it when taken from the end
        values = cursor_row_values(table, keys, args["cursor"])
        back = (args.get("take") or 0) < 0
        children = children.where(after_or_at([(c, not a) for c, a in keys] if back else keys, values)).where(cursor_row_exists(table, args["cursor"]))
    return children, keys, cols


def _ranked_children(cat, model: str, rel_name: str, args: dict, depth: int) -> tuple[DataFrame, list[str], str]:
    """Children with a per-parent rank; paging arguments applied.

    A bounded ``take`` limits every parent before the shuffle; where all of a
    parent's children may stay, ranks come from ``rank_in_groups``."""
    rel = cat.model(model).relations[rel_name]
    children, keys, cols = _children(cat, model, rel_name, args, depth)
    refs, rn = list(rel.references), "__rank"
    skip, take = args.get("skip") or 0, args.get("take")
    if take is not None and skip + abs(take) <= SMALL_TAKE:
        # last |take| rows per parent: ranked from the other end first
        w = Window.partitionBy(*refs).orderBy(*as_sort(keys, reverse=take < 0))
        children = children.withColumn(rn, F.row_number().over(w)).where((F.col(rn) > skip) & (F.col(rn) <= skip + abs(take)))
        if take < 0:
            children = children.withColumn(rn, F.row_number().over(Window.partitionBy(*refs).orderBy(*as_sort(keys))))
        return children, cols, rn
    children = rank_in_groups(children, refs, as_sort(keys, reverse=(take or 0) < 0), rn)
    if take is not None:
        children = children.where(F.col(rn) <= skip + abs(take))
    if skip:
        children = children.where(F.col(rn) > skip)
    if (take or 0) < 0:
        children = rank_in_groups(children.drop(rn), refs, as_sort(keys), rn)
    return children, cols, rn


def include(cat, model: str, df: DataFrame, spec: dict, depth: int = 1) -> DataFrame:
    """Attach every relation in ``spec`` to ``df`` (rows of ``model``)."""
    out = df
    for rel_name, value in spec.items():
        if value is False:
            continue
        args = _args(value)
        m = cat.model(model)
        if rel_name not in m.relations:
            raise ValueError(f"{model} has no relation {rel_name!r}")
        rel = m.relations[rel_name]
        jk = [f"__jk{i}" for i in range(len(rel.fields))]
        if rel.kind == "one":
            target = related(cat, model, rel_name, args, depth)
            payload = args.get("select")
            cols = [c for c in target.columns if not payload or payload.get(c)]
            right = target.select(*[F.col(r).alias(k) for r, k in zip(rel.references, jk)],
                                  F.struct(*[F.col(c) for c in cols]).alias(rel_name))
        else:
            if args.get("take") is None and not args.get("skip"):
                # nothing cuts the list: the array itself is sorted by the keys, without a window over the parent
                children, keys, cols = _children(cat, model, rel_name, args, depth)
                if not cat.model(rel.target).key and all(a for _, a in keys):
                    keys = keys[:len(parse_order(args.get("order")))]  # the other columns break ties as they are
                place, ordered = [c.alias(f"r{i}") for i, (c, _) in enumerate(keys)], array_order([a for _, a in keys])
            else:
                children, cols, rn = _ranked_children(cat, model, rel_name, args, depth)
                place, ordered = [F.col(rn).alias("r")], None
            items = F.collect_list(F.struct(*place, F.struct(*[F.col(c) for c in cols]).alias("v")))
            right = (children
                     .groupBy(*[F.col(r).alias(k) for r, k in zip(rel.references, jk)])
                     .agg((F.array_sort(items, ordered) if ordered else F.array_sort(items)).alias("__items"))
                     .select(*jk, F.transform("__items", lambda x: x["v"]).alias(rel_name)))
        cond = reduce(lambda a, b: a & b, [out[f] == right[k] for f, k in zip(rel.fields, jk)])
        out = out.join(right, cond, "left").drop(*jk)
        if rel.kind == "many":
            empty = F.array().cast(out.schema[rel_name].dataType)
            out = out.withColumn(rel_name, F.coalesce(F.col(rel_name), empty))
    return out


def array_order(ascending: list[bool]):
    """Comparator of array items by their fields r0, r1, …; NULL is the smallest value.  None where the natural order does."""
    if all(ascending):
        return None

    def compare(x, y):
        out = F.lit(0)
        for i, asc in reversed(list(enumerate(ascending))):
            a, b = x[f"r{i}"], y[f"r{i}"]
            less = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
            out = F.when(a.eqNullSafe(b), out).when(less, F.lit(-1 if asc else 1)).otherwise(F.lit(1 if asc else -1))
        return out
    return compare


def include_chunks(cat, model: str, df: DataFrame, rel_name: str, args: Any = True, size: int = 1000) -> DataFrame:
    """A to-many include in rows of at most ``size`` children: the parent's columns, ``chunk`` (from 0) and the
    relation's array.  A parent with many children is many rows in many tasks; a childless one has one empty row."""
    args = _args(args)
    rel = cat.model(model).relations[rel_name]
    children, cols, rn = _ranked_children(cat, model, rel_name, args, 1)
    if args.get("skip"):  # chunks count from the first child that stays
        children = children.withColumn(rn, F.col(rn) - args["skip"]) if (args.get("take") or 0) >= 0 else children
    jk = [f"__jk{i}" for i in range(len(rel.fields))]
    chunk = ((F.col(rn) - 1) / size).cast("int")
    items = F.array_sort(F.collect_list(F.struct(F.col(rn).alias("r"), F.struct(*[F.col(c) for c in cols]).alias("v"))))
    right = children.groupBy(*[F.col(r).alias(k) for r, k in zip(rel.references, jk)], chunk.alias("__chunk")).agg(items.alias("__items"))
    right = right.select(*jk, "__chunk", F.transform("__items", lambda x: x["v"]).alias(rel_name))
    # a parent stands once for each of its chunks before the arrays come, which then meet it by key and number: they are never dealt by the key alone
    last = children.groupBy(*[F.col(r).alias(f"__last{i}") for i, r in enumerate(rel.references)]).agg(F.max(chunk).alias("__last"))
    cond = reduce(lambda a, b: a & b, [df[f] == last[f"__last{i}"] for i, f in enumerate(rel.fields)])
    numbers = F.sequence(F.lit(0), F.coalesce("__last", F.lit(0)))
    out = df.join(last, cond, "left").select(*[df[c] for c in df.columns], F.explode(numbers).alias("chunk"))
    cond = reduce(lambda a, b: a & b, [out[f] == right[k] for f, k in zip(rel.fields, jk)], out["chunk"] == right["__chunk"])
    out = out.join(right, cond, "left").drop(*jk, "__chunk")
    return out.withColumn(rel_name, F.coalesce(rel_name, F.array().cast(out.schema[rel_name].dataType)))


def include_flat(cat, model: str, df: DataFrame, rel_name: str, args: Any = True,
                 prefix: str | None = None) -> DataFrame:
    """Long form of a to-many include: one row per (parent, child); childless
    parents keep one row with NULL child columns."""
    args = _args(args)
    rel = cat.model(model).relations[rel_name]
    children, cols, rn = _ranked_children(cat, model, rel_name, args, 1)
    prefix = f"{rel_name}_" if prefix is None else prefix
    jk = [f"__jk{i}" for i in range(len(rel.fields))]
    right = children.select(*[F.col(r).alias(k) for r, k in zip(rel.references, jk)],
                            F.col(rn).alias(f"{prefix}rank"),
                            *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    cond = reduce(lambda a, b: a & b, [df[f] == right[k] for f, k in zip(rel.fields, jk)])
    return df.join(right, cond, "left").drop(*jk)


def traverse(cat, model: str, df: DataFrame, path: list[str]) -> DataFrame:
    """Follow relations (e.g. parent → link → other side) as plain equi-joins;
    the result holds the columns of every table along the path."""
    out, cur = df, model
    for rel_name in path:
        rel = cat.model(cur).relations[rel_name]
        target = cat.df(rel.target)
        clash = set(out.columns) & set(target.columns) - set(rel.references)
        target = target.select(*[F.col(c).alias(f"{rel.target}_{c}") if c in clash else F.col(c)
                                 for c in target.columns])
        refs = [f"{rel.target}_{r}" if r in clash else r for r in rel.references]
        cond = reduce(lambda a, b: a & b, [out[f] == target[r] for f, r in zip(rel.fields, refs)])
        joined = out.join(target, cond, "inner")
        # drop the duplicated key columns coming from the target side
        out = joined.drop(*[target[r] for f, r in zip(rel.fields, refs) if f == r or r in out.columns])
        cur = rel.target
    return out
