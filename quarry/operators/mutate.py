"""Mutations as set-based table transforms.

Parquet tables have no ``MERGE``, so every mutation is
``(old table, change set) → Result(new table, affected rows)``; writing the new
version is ``quarry.sources.sinks.write_version``.  Nothing here runs an action
except the explicit ``check_*`` helpers that raise on violations.

Scale notes: an upsert is one full outer join on the key (both sides shuffle on
the key; a table in ``sources.bucketed`` spares the old side's shuffle).  Change sets are deduplicated by key *before* the join (last write
wins), so a key repeated in a batch cannot multiply rows; a change without its
key is refused.  Counters add the
number of *new distinct links*, so a rerun adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ModelSpec


@dataclass
class Result:
    table: DataFrame      # the table after the mutation
    affected: DataFrame   # rows inserted / updated / deleted

    def count(self) -> DataFrame:
        return self.affected.agg(F.count(F.lit(1)).alias("count"))


class UniqueViolation(ValueError):
    pass


class RequiredViolation(ValueError):
    pass


# -- shaping ---------------------------------------------------------------------

def conform(df: DataFrame, spec: ModelSpec, fill_defaults: bool = True, like: DataFrame | None = None) -> DataFrame:
    """Columns of the model (or of ``like``, the table written to) in order and
    type; missing columns NULL, defaults for NULLs."""
    schema = spec.schema if spec.schema is not None else (like.schema if like is not None else None)
    if schema is None:
        return df
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if fill_defaults and f.name in spec.defaults:
            c = F.coalesce(c, F.lit(spec.defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def key_cond(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[k] for k in key])


def last_per_key(df: DataFrame, key: tuple[str, ...], seq: str | None) -> DataFrame:
    """When a key repeats in one batch, the last write (highest ``seq``) wins.

    ``row_number() = 1`` over the key lets Spark keep one row per key and map
    task before the shuffle (WindowGroupLimit), so hot keys stay cheap.
    Without ``seq`` the batch must already be unique per key.
    """
    if seq is None:
        return df
    w = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", seq)


# -- checks (each is one cheap action) -------------------------------------------

def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_key(df: DataFrame, key: tuple[str, ...]) -> None:
    """A row without its whole key can't be found again, so it is refused."""
    bad = df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key]))
    if not bad.isEmpty():
        raise RequiredViolation(f"rows without a value for the key {key}")


def check_distinct(changes: DataFrame, key: tuple[str, ...]) -> None:
    if not duplicate_keys(changes, key).isEmpty():
        raise UniqueViolation(f"a key of {key} is repeated in the change set; give a seq to let the last one win")


def check_unique(new: DataFrame, old: DataFrame, key: tuple[str, ...]) -> None:
    clash = new.select(*key).join(old.select(*key), list(key), "left_semi")
    if not clash.isEmpty() or not duplicate_keys(new, key).isEmpty():
        raise UniqueViolation(f"unique constraint failed on {key}")


def check_required(df: DataFrame, spec: ModelSpec) -> None:
    if spec.required:
        bad = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.required]))
        if not bad.isEmpty():
            raise RequiredViolation(f"required fields missing on {spec.name}: {spec.required}")


# -- M1 / M2 insert -----------------------------------------------------------------

def insert(old: DataFrame, data: DataFrame, spec: ModelSpec, check: bool = True) -> DataFrame:
    new = conform(data, spec, like=old)
    if check:
        check_required(new, spec)
        if spec.key:
            check_unique(new, old, spec.key)
    return old.unionByName(new)


def insert_many(old: DataFrame, data: DataFrame, spec: ModelSpec, skip_duplicates: bool = False,
                check: bool = True, seq: str | None = None) -> Result:
    """Of rows that share a key, ``skip_duplicates`` keeps the first by ``seq``
    (without one, the smallest row, as a table has no order)."""
    new = conform(data, spec, like=old)
    if check:
        check_required(new, spec)
    if skip_duplicates and spec.key:
        order = [F.col(c).asc_nulls_first() for c in new.columns]
        if seq is not None:
            keyed = data.withColumn("__rn", F.row_number().over(Window.partitionBy(*spec.key).orderBy(seq, *[c for c in new.columns if c in data.columns])))
            new = conform(keyed.where("__rn = 1"), spec, like=old)
        else:
            new = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*spec.key).orderBy(*order))).where("__rn = 1").drop("__rn")
        new = new.join(old.select(*spec.key), list(spec.key), "left_anti")
    elif check and spec.key:
        check_unique(new, old, spec.key)
    return Result(old.unionByName(new.select(*old.columns)), new)


# -- M3 upsert ----------------------------------------------------------------------

def upsert(old: DataFrame, changes: DataFrame, spec: ModelSpec, seq: str | None = None,
           create_defaults: bool = True, create: DataFrame | None = None, check: bool = True) -> Result:
    """Insert new keys, update existing ones; a NULL in the change set keeps the
    old value (P8) while ``''`` / ``0`` overwrite it.  With ``create`` (same
    keys), new rows take its values instead.  Without ``seq`` a key may stand
    only once in the change set."""
    key = spec.key
    if not key:
        raise ValueError("upsert needs a keyed model")
    if check:  # callers whose keys can't be NULL spare the action
        check_key(changes, key)
    if seq is None:
        check_distinct(changes, key)
    ch = last_per_key(changes, key, seq)
    if create is not None:
        check_key(create, key)
        check_distinct(create, key)
        made = [c for c in old.columns if c not in key and c in create.columns]
        given = create.select(*key, *[F.col(c).alias(f"__c_{c}") for c in made], F.lit(True).alias("__made"))
        known = old.select(*key, F.lit(True).alias("__known"))
        both = ch.join(given, list(key), "full_outer").join(known, list(key), "left")
        new = F.col("__known").isNull() & F.col("__made").isNotNull()
        cols = [F.when(new, F.col(f"__c_{c}") if c in made else F.lit(None)).otherwise(F.col(c) if c in ch.columns else F.lit(None)).cast(old.schema[c].dataType).alias(c)
                for c in old.columns if c not in key and (c in ch.columns or c in made)]
        # a row that only ``create`` names leaves a present row as it is
        ch = both.select(*key, *cols)
    value_cols = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"__o_{c}") for c in value_cols], F.lit(True).alias("__old"))
    n = ch.select(*key, *[F.col(c).alias(f"__n_{c}") for c in value_cols if c in ch.columns],
                  F.lit(True).alias("__new"))
    j = o.join(n, list(key), "full_outer")
    out_cols = []
    for c in value_cols:
        oc = F.col(f"__o_{c}")
        if f"__n_{c}" in j.columns:
            nc = F.col(f"__n_{c}")
            v = F.coalesce(nc, oc)
        else:
            v = oc
        if create_defaults and c in spec.defaults:
            v = F.when(F.col("__old").isNull(), F.coalesce(v, F.lit(spec.defaults[c]))).otherwise(v)
        dtype = old.schema[c].dataType
        out_cols.append(v.cast(dtype).alias(c))
    merged = j.select(*key, *out_cols, F.col("__new").isNotNull().alias("__touched"))
    table = merged.drop("__touched").select(*old.columns)
    affected = merged.where("__touched").drop("__touched").select(*old.columns)
    return Result(table, affected)


# -- M4 / M5 / M6 / M14 update --------------------------------------------------------

def _apply_op(c: Column, op: Any, dtype: T.DataType) -> Column:
    if not isinstance(op, dict):
        return F.lit(op).cast(dtype) if not isinstance(op, Column) else op
    if len(op) != 1:
        raise ValueError(f"one operation per field, got {op}")
    (name, v), = op.items()
    if name == "set":
        if isinstance(dtype, T.ArrayType):
            return F.array(*[F.lit(x) for x in v]).cast(dtype)
        return F.lit(v).cast(dtype)
    if name == "push":
        vals = v if isinstance(v, (list, tuple)) else [v]
        return F.concat(F.coalesce(c, F.array().cast(dtype)), F.array(*[F.lit(x) for x in vals]).cast(dtype))
    if name == "increment":
        return (c + F.lit(v)).cast(dtype)
    if name == "decrement":
        return (c - F.lit(v)).cast(dtype)
    if name == "multiply":
        return (c * F.lit(v)).cast(dtype)
    if name == "divide":
        # ANSI mode: dividing by zero raises.  Integer fields truncate toward zero.
        if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) and isinstance(v, int):
            return F.call_function("div", c.cast("bigint"), F.lit(v).cast("bigint")).cast(dtype)
        q = c / F.lit(v)
        if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            return F.when(c.isNull(), F.lit(None)).otherwise(
                F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))).cast(dtype)
        return q.cast(dtype)
    raise ValueError(f"unknown update operation {name!r}")


def update_where(old: DataFrame, data: dict, pred: Column | None, spec: ModelSpec | None = None) -> Result:
    """Set / arithmetic / list updates on rows matching ``pred`` (all rows if None)."""
    match = F.coalesce(pred, F.lit(False)) if pred is not None else F.lit(True)
    flagged = old.withColumn("__hit", match)
    cols = []
    for f in old.schema.fields:
        if f.name in data:
            new = _apply_op(F.col(f.name), data[f.name], f.dataType)
            cols.append(F.when(F.col("__hit"), new).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    unknown = set(data) - set(old.columns)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    out = flagged.select(*cols, "__hit")
    return Result(out.drop("__hit"), out.where("__hit").drop("__hit"))


def update_from(old: DataFrame, changes: DataFrame, key: tuple[str, ...]) -> Result:
    """Update by key from a change table (M5 table form); absent keys do nothing.
    NULLs in the change table keep the old value; a key may stand there once."""
    check_distinct(changes, key)
    value_cols = [c for c in changes.columns if c not in key]
    n = changes.select(*key, *[F.col(c).alias(f"__n_{c}") for c in value_cols], F.lit(True).alias("__hit"))
    j = old.join(n, list(key), "left")
    cols = [F.coalesce(F.col(f"__n_{c}"), F.col(c)).cast(old.schema[c].dataType).alias(c)
            if c in value_cols else F.col(c) for c in old.columns]
    out = j.select(*cols, F.coalesce(F.col("__hit"), F.lit(False)).alias("__hit"))
    return Result(out.drop("__hit"), out.where("__hit").drop("__hit"))


# -- M7 / M8 delete ---------------------------------------------------------------

def delete_where(old: DataFrame, pred: Column | None) -> Result:
    if pred is None:
        return Result(old.limit(0), old)
    hit = F.coalesce(pred, F.lit(False))
    return Result(old.where(~hit), old.where(hit))


def delete_keys(old: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> Result:
    return Result(old.join(keys.select(*key), list(key), "left_anti"),
                  old.join(keys.select(*key), list(key), "left_semi"))


# -- links (M9 M10 M11 M12 M13) -------------------------------------------------------

def new_links(links: DataFrame, pairs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Pairs not linked yet, each once."""
    return pairs.select(*key).dropDuplicates(list(key)).join(links.select(*key), list(key), "left_anti")


def connect(links: DataFrame, pairs: DataFrame, key: tuple[str, ...]) -> Result:
    fresh = new_links(links, pairs, key)
    return Result(links.unionByName(fresh.select(*links.columns)), fresh)


def disconnect(links: DataFrame, pairs: DataFrame, key: tuple[str, ...]) -> Result:
    return Result(links.join(pairs.select(*key), list(key), "left_anti"),
                  links.join(pairs.select(*key), list(key), "left_semi"))


def set_links(links: DataFrame, pairs: DataFrame, parent_cols: tuple[str, ...], key: tuple[str, ...],
              parents: DataFrame | None = None) -> Result:
    """Replace the link set of every parent named in ``pairs`` or in ``parents``
    (one that only ``parents`` names is left without links: ``set`` to an empty list)."""
    named = pairs.select(*parent_cols)
    if parents is not None:
        named = named.unionByName(parents.select(*parent_cols))
    kept = links.join(named.distinct(), list(parent_cols), "left_anti")
    fresh = pairs.select(*key).dropDuplicates(list(key))
    return Result(kept.unionByName(fresh.select(*links.columns)), fresh)


def nested_delete(children: DataFrame, keys: DataFrame, key: tuple[str, ...], links: DataFrame | None = None,
                  link_key: tuple[str, ...] = ()) -> tuple[Result, Result | None]:
    """Delete the named related rows, and the links that name them (``link_key``: their columns in the order of ``key``)."""
    gone = delete_keys(children, keys, key)
    if links is None:
        return gone, None
    renamed = keys.select(*[F.col(k).alias(n) for k, n in zip(key, link_key)]).distinct()
    return gone, delete_keys(links, renamed, link_key)


def connect_or_create(parents: DataFrame, parent_rows: DataFrame, parent_spec: ModelSpec,
                      links: DataFrame, pairs: DataFrame, key: tuple[str, ...]) -> tuple[Result, Result]:
    p = insert_many(parents, parent_rows, parent_spec, skip_duplicates=True)
    return p, connect(links, pairs, key)


def nested_create(parents: DataFrame, parent_rows: DataFrame, parent_spec: ModelSpec,
                  children: DataFrame, child_rows: DataFrame, child_spec: ModelSpec,
                  check: bool = False, foreign_key: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert parents and their children together; ``child_rows`` carry the
    parent key (the foreign key is filled from it).  With ``foreign_key``, a
    child without a parent raises."""
    made = insert(parents, parent_rows, parent_spec, check=check)
    if foreign_key:
        from .quality import foreign_key_orphans
        if not foreign_key_orphans(child_rows, made, foreign_key, parent_spec.key).isEmpty():
            raise RequiredViolation(f"rows of {child_spec.name} without a parent by {foreign_key}")
    return made, insert(children, child_rows, child_spec, check=check)


# -- M15 / G11: name links with counters -------------------------------------------

def maintain_counted_links(links: DataFrame, counters: DataFrame, pairs: DataFrame,
                           id_col: str, name_col: str, counter_name_col: str = "name",
                           counter_col: str = "amount_games_published") -> tuple[Result, Result]:
    """New (id, name) pairs are linked and each adds 1 to the name's counter.

    Counting only *new distinct* links makes a rerun add nothing.  The counter
    update is a grouped count (partial aggregation) joined to the counter table.
    """
    link_key = (id_col, name_col)
    fresh = new_links(links, pairs, link_key)
    inc = fresh.groupBy(F.col(name_col).alias(counter_name_col)).agg(F.count(F.lit(1)).alias("__inc"))
    j = counters.join(inc, [counter_name_col], "full_outer")
    new_counters = j.select(
        F.col(counter_name_col),
        (F.coalesce(F.col(counter_col), F.lit(0)) + F.coalesce(F.col("__inc"), F.lit(0))).cast("int").alias(counter_col))
    touched = new_counters.join(inc.select(counter_name_col), [counter_name_col], "left_semi")
    link_res = Result(links.unionByName(fresh.select(*links.columns)), fresh)
    return link_res, Result(new_counters.select(*counters.columns), touched.select(*counters.columns))


# -- M16: id/name dimensions with links -------------------------------------------------

def dimension_names(items: DataFrame) -> DataFrame:
    """``items`` with stripped names; an empty name is the id's text."""
    from ..functions.clean import pystrip
    return items.withColumn("name", F.expr(f"coalesce(nullif({pystrip('name')}, ''), CAST(id AS STRING))"))


def maintain_dimension(dim: DataFrame, links: DataFrame, items: DataFrame, id_col: str, link_id_col: str,
                       seq: str) -> tuple[Result, Result]:
    """``items`` = (gameId, id, name, seq).  The dimension name is always
    refreshed (last write wins); an empty name is written as the id's text."""
    named = dimension_names(items)
    latest = last_per_key(named.select("id", "name", seq), ("id",), seq)
    dim_res = upsert(dim, latest, ModelSpec("dim", key=(id_col,)), check=False)
    pairs = named.select(F.col("gameId"), F.col("id").alias(link_id_col))
    link_res = connect(links, pairs, ("gameId", link_id_col))
    return dim_res, link_res


# -- M17: ordered batch ------------------------------------------------------------------

def apply_batch(cat, steps: list[tuple[str, Callable[[Any], DataFrame]]]):
    """Fold ``(table, fn(catalog) → new DataFrame)`` steps over a catalog, lazily
    and in order; the caller writes every touched table and switches once
    (``sinks.publish``)."""
    touched: list[str] = []
    for name, fn in steps:
        cat = cat.with_table(name, fn(cat))
        if name not in touched:
            touched.append(name)
    return cat, touched
