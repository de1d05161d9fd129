"""Data-quality checks (Q1–Q4, J9) and partial projections.

Each check returns the offending rows (or per-column counts) as a DataFrame;
raising is left to the caller, which keeps every check a single distributed
pass (grouped counts are partially aggregated before the shuffle).
"""

from __future__ import annotations

import datetime
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unique_violations(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Q1: key values held by more than one row, with their row count."""
    key = list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def required_violations(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Q2: one row per required column: ``(column, n_null)``, one scan."""
    required = list(required)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    stack = ", ".join(f"'{c}', `{c}`" for c in required)
    return counts.selectExpr(f"stack({len(required)}, {stack}) AS (column, n_null)")


def foreign_key_orphans(child: DataFrame, parent: DataFrame, fk: Iterable[str], pk: Iterable[str]) -> DataFrame:
    """Child rows whose foreign key has no parent (NULL keys are not orphans)."""
    fk, pk = list(fk), list(pk)
    p = parent.select(*[F.col(k).alias(f"__pk{i}") for i, k in enumerate(pk)])
    cond = reduce(lambda a, b: a & b, [child[f] == p[f"__pk{i}"] for i, f in enumerate(fk)])
    nonnull = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fk])
    return child.where(nonnull).join(p, cond, "left_anti")


def type_violations(df: DataFrame, declared: dict[str, str], key: Iterable[str]) -> DataFrame:
    """Q4: rows whose text does not fit the declared type: ``(key…, column, value)``."""
    key = list(key)
    parts = []
    for c, t in declared.items():
        bad = F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull()
        parts.append(df.where(bad).select(*key, F.lit(c).alias("column"),
                                          F.col(c).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def partial(df: DataFrame, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None,
            required: Iterable[str] | None = None, optional: Iterable[str] | None = None,
            relations: Iterable[str] | None = None) -> DataFrame:
    """Column subset of a table.  ``include`` xor ``exclude``; unknown
    names are errors; relation (struct / array) columns are dropped unless
    named in ``relations``.  ``required`` / ``optional`` change nullability
    in the schema; a NULL in a required column raises when it is read."""
    if include is not None and exclude is not None:
        raise ValueError("include and exclude are exclusive")
    cols = df.columns
    for group in (include, exclude, required, optional):
        for c in group or []:
            if c not in cols:
                raise ValueError(f"unknown field {c!r}")
    keep = list(include) if include is not None else [c for c in cols if c not in set(exclude or [])]
    rel = set(relations or [])
    keep = [c for c in keep
            if c in rel or not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType)) or c in (include or [])]
    out = df.select(*keep)
    req, opt = set(required or []), set(optional or [])
    if req or opt:
        out = out.select(*[_required(F.col(f.name), f) if f.name in req else
                           F.when(F.lit(True), F.col(f.name)).alias(f.name) if f.name in opt else F.col(f.name)
                           for f in out.schema.fields])
    return out


def _required(c: Column, f: T.StructField) -> Column:
    """A non-nullable column: a NULL raises when the rows are read."""
    filler = {T.StringType: "", T.BooleanType: False, T.DateType: datetime.date(1970, 1, 1),
              T.TimestampType: datetime.datetime(1970, 1, 1), T.TimestampNTZType: datetime.datetime(1970, 1, 1)}.get(type(f.dataType), 0)
    checked = F.when(c.isNull(), F.raise_error(F.lit(f"{f.name} is required")).cast(f.dataType)).otherwise(c)
    return F.coalesce(checked, F.lit(filler).cast(f.dataType)).alias(f.name)
