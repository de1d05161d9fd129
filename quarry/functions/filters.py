"""Where-dicts → Spark ``Column`` predicates.

The grammar is the catalogue client's: a dict of ``field → value`` or
``field → {op: value}``, plus ``AND`` / ``OR`` / ``NOT`` lists, compound unique
keys, and relation filters (``is`` / ``is_not`` for to-one, ``some`` / ``none``
/ ``every`` for to-many).

Relation filters compile to correlated ``EXISTS`` subqueries
(``DataFrame.exists()`` with ``Column.outer()``).  Catalyst rewrites them into
left-semi / left-anti joins at the top level and into existence joins under
``OR``/``NOT``, and picks broadcast or sort-merge from measured sizes, so a
relation filter never materialises the child table on the driver.

Users can always pass a ``Column`` instead of a dict.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import compound_key_name

LOGICAL = ("AND", "OR", "NOT")
SCALAR_OPS = {"equals", "not", "in", "not_in", "lt", "lte", "gt", "gte", "contains", "startswith",
              "endswith", "mode", "search", "has", "has_every", "has_some", "is_empty"}
# Spelling aliases that clients use (camelCase forms)
ALIASES = {"startsWith": "startswith", "endsWith": "endswith", "notIn": "not_in", "isNot": "is_not",
           "hasEvery": "has_every", "hasSome": "has_some", "isEmpty": "is_empty"}
RELATION_OPS = {"is", "is_not", "some", "none", "every"}

_alias_counter = itertools.count()


def fresh_alias(prefix: str) -> str:
    return f"{prefix}__q{next(_alias_counter)}"


@dataclass(frozen=True)
class Json:
    """Marks a filter value as JSON (compared in canonical form)."""
    value: Any


def _lit(v: Any) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (bytes, bytearray)):
        return F.lit(bytearray(v))
    if isinstance(v, (list, tuple)):
        return F.array(*[_lit(x) for x in v]) if v else F.array()  # an empty list takes the other side's type
    return F.lit(v)


def _canon_json(c: Column) -> Column:
    return F.to_json(F.try_parse_json(c))


def search_terms(query: str) -> list[str]:
    """Query terms of a full-text filter, cut as ``text_tokens`` cuts texts."""
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t]


def text_tokens(c: Column) -> Column:
    """Token array of a text column (lower-cased, split on runs of non letters/digits)."""
    return F.split(F.lower(c), r"[^\p{L}\p{N}]+")


def _field_filter(c: Column, spec: Any, dtype: T.DataType | None) -> Column:
    """Filter on one scalar or list field."""
    if spec is None:
        return c.isNull()
    if isinstance(spec, Json):
        return _canon_json(c) == _canon_json(F.lit(json.dumps(spec.value)))
    if not isinstance(spec, dict):
        if isinstance(spec, (list, tuple)) and isinstance(dtype, T.ArrayType):
            return c == _lit(spec)
        return c == _lit(spec)
    spec = {ALIASES.get(k, k): v for k, v in spec.items()}
    unknown = set(spec) - SCALAR_OPS
    if unknown:
        raise ValueError(f"unknown filter operators {sorted(unknown)}")
    insensitive = spec.get("mode") == "insensitive"
    cc = F.lower(c) if insensitive else c

    def val(v):
        if insensitive and isinstance(v, str):
            return F.lower(F.lit(v))
        if insensitive and isinstance(v, (list, tuple)):
            return [x.lower() if isinstance(x, str) else x for x in v]
        return v

    preds: list[Column] = []
    for op, v in spec.items():
        if op == "mode":
            continue
        if op == "equals":
            if v is None:
                preds.append(c.isNull())
            elif isinstance(v, Json):
                preds.append(_canon_json(c) == _canon_json(F.lit(json.dumps(v.value))))
            else:
                preds.append(cc == _lit(val(v)))
        elif op == "not":
            if v is None:
                preds.append(c.isNotNull())
            elif isinstance(v, dict):
                inner = dict(v)
                if insensitive:
                    inner.setdefault("mode", "insensitive")
                preds.append(~_field_filter(c, inner, dtype))
            elif isinstance(v, Json):
                preds.append(_canon_json(c) != _canon_json(F.lit(json.dumps(v.value))))
            else:
                preds.append(cc != _lit(val(v)))
        elif op in ("in", "not_in"):
            if isinstance(v, DataFrame):
                # large value sets: a one-column DataFrame becomes a semi/anti join
                in_alias = fresh_alias("in")
                other = v.alias(in_alias)
                col0 = F.col(f"{in_alias}.{v.columns[0]}")
                sub = other.where(col0 == c.outer()).exists()
                preds.append(sub if op == "in" else (c.isNotNull() & ~sub))
            else:
                values = list(val(v))
                p = cc.isin(values) if values else F.lit(False)
                preds.append(p if op == "in" else (c.isNotNull() & ~p))
        elif op == "lt":
            preds.append(cc < _lit(val(v)))
        elif op == "lte":
            preds.append(cc <= _lit(val(v)))
        elif op == "gt":
            preds.append(cc > _lit(val(v)))
        elif op == "gte":
            preds.append(cc >= _lit(val(v)))
        elif op == "contains":
            preds.append(cc.contains(val(v)))
        elif op == "startswith":
            preds.append(cc.startswith(val(v)))
        elif op == "endswith":
            preds.append(cc.endswith(val(v)))
        elif op == "search":
            terms = search_terms(v)
            tokens = text_tokens(c)
            preds.append(F.size(F.array_except(_lit(terms), tokens)) == 0 if terms else F.lit(True))
        elif op == "has":
            preds.append(F.array_contains(c, _lit(v)))
        elif op == "has_every":
            preds.append(F.size(F.array_except(_lit(list(v)), c)) == 0)
        elif op == "has_some":
            preds.append(F.arrays_overlap(c, _lit(list(v))) if v else F.lit(False))
        elif op == "is_empty":
            preds.append((F.size(c) == 0) if v else (F.size(c) > 0))
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def compile_where(cat, model: str, where: Any, alias: str, df: DataFrame | None = None) -> Column:
    """Compile a where-dict on ``model`` whose DataFrame is aliased ``alias``."""
    if where is None:
        return F.lit(True)
    if isinstance(where, Column):
        return where
    if not isinstance(where, dict):
        raise TypeError(f"where must be a dict or Column, got {type(where).__name__}")
    spec = cat.model(model)
    df = df if df is not None else cat.df(model)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    uniq = {compound_key_name(k): k for k in spec.unique_keys() if len(k) > 1}
    preds: list[Column] = []
    for key, value in where.items():
        key = ALIASES.get(key, key)
        if key == "AND":
            items = value if isinstance(value, (list, tuple)) else [value]
            preds.append(reduce(lambda a, b: a & b,
                                [compile_where(cat, model, w, alias, df) for w in items], F.lit(True)))
        elif key == "OR":
            items = value if isinstance(value, (list, tuple)) else [value]
            preds.append(reduce(lambda a, b: a | b,
                                [compile_where(cat, model, w, alias, df) for w in items], F.lit(False)))
        elif key == "NOT":
            items = value if isinstance(value, (list, tuple)) else [value]
            preds.append(reduce(lambda a, b: a & b,
                                [~compile_where(cat, model, w, alias, df) for w in items], F.lit(True)))
        elif key in uniq:
            cols = uniq[key]
            preds.append(reduce(lambda a, b: a & b,
                                [F.col(f"{alias}.{c}") == _lit(value[c]) for c in cols]))
        elif key in spec.relations:
            preds.append(_relation_filter(cat, model, key, value, alias))
        elif key in dtypes:
            preds.append(_field_filter(F.col(f"{alias}.{key}"), value, dtypes[key]))
        else:
            raise ValueError(f"unknown field {key!r} on {model}")
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def _correlated(cat, model: str, rel_name: str, alias: str):
    rel = cat.model(model).relations[rel_name]
    inner_alias = fresh_alias(rel.target)
    target = cat.df(rel.target).alias(inner_alias)
    join = reduce(lambda a, b: a & b, [
        F.col(f"{inner_alias}.{r}") == F.col(f"{alias}.{f}").outer()
        for f, r in zip(rel.fields, rel.references)])
    return rel, target, inner_alias, join


def _relation_filter(cat, model: str, rel_name: str, value: Any, alias: str) -> Column:
    rel, target, inner_alias, join = _correlated(cat, model, rel_name, alias)

    def inner(w):
        return compile_where(cat, rel.target, w, inner_alias, cat.df(rel.target))

    if rel.kind == "one":
        if value is None:
            return ~target.where(join).exists()
        ops = {ALIASES.get(k, k) for k in value} if isinstance(value, dict) else set()
        if not ops or not ops <= {"is", "is_not"}:
            value = {"is": value}
        preds = []
        for op, w in value.items():
            op = ALIASES.get(op, op)
            if op == "is":
                preds.append(~target.where(join).exists() if w is None
                             else target.where(join & inner(w)).exists())
            else:  # is_not
                preds.append(target.where(join).exists() if w is None
                             else ~target.where(join & inner(w)).exists())
        return reduce(lambda a, b: a & b, preds)
    # to-many
    preds = []
    for op, w in value.items():
        if op == "some":
            preds.append(target.where(join & inner(w)).exists())
        elif op == "none":
            preds.append(~target.where(join & inner(w)).exists())
        elif op == "every":
            preds.append(~target.where(join & ~F.coalesce(inner(w), F.lit(False))).exists())
        else:
            raise ValueError(f"unknown to-many operator {op!r}")
    return reduce(lambda a, b: a & b, preds)
