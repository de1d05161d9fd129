"""group_by with sum / avg / min / max / count, having, order, take, skip.

Output columns are flat: the ``by`` fields, then ``_<agg>_<field>`` for every
requested aggregate (``_count__all`` for ``count=True``).  Spark plans it as a
partial (map-side) hash aggregate, a shuffle on the ``by`` keys and a final
aggregate, so a hot key costs one partial row per map task, not a hot reducer.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import ALIASES, _field_filter

AGGS = ("_sum", "_avg", "_min", "_max", "_count")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def agg_name(agg: str, field: str) -> str:
    return f"{agg}_{field}"


def _agg_expr(agg: str, field: str) -> Column:
    if agg == "_count":
        return F.count(F.lit(1)) if field == "_all" else F.count(F.col(field))
    fn = {"_sum": F.sum, "_avg": F.avg, "_min": F.min, "_max": F.max}[agg]
    return fn(F.col(field))


def _fields(spec: Any) -> list[str]:
    if spec is None or spec is False:
        return []
    if spec is True:
        return ["_all"]
    return [f for f, on in spec.items() if on]


def _having(having: dict, by: list[str], dtypes: dict, wanted: dict[str, Column]) -> Column:
    preds = []
    for key, value in having.items():
        key = ALIASES.get(key, key)
        if key in ("AND", "OR", "NOT"):
            items = value if isinstance(value, (list, tuple)) else [value]
            subs = [_having(h, by, dtypes, wanted) for h in items]
            if key == "AND":
                preds.append(reduce(lambda a, b: a & b, subs, F.lit(True)))
            elif key == "OR":
                preds.append(reduce(lambda a, b: a | b, subs, F.lit(False)))
            else:
                preds.append(reduce(lambda a, b: a & b, [~s for s in subs], F.lit(True)))
            continue
        if key not in dtypes:
            raise ValueError(f"unknown having field {key!r}")
        if isinstance(value, dict) and any(k in AGGS for k in value):
            for agg, flt in value.items():
                if agg not in AGGS:
                    if key not in by:
                        raise ValueError(f"having on {key!r} needs it in `by` or an aggregate")
                    preds.append(_field_filter(F.col(key), {agg: flt}, dtypes[key]))
                    continue
                name = agg_name(agg, key)
                wanted.setdefault(name, _agg_expr(agg, key).alias(name))
                preds.append(_field_filter(F.col(name), flt, None))
        else:
            if key not in by:
                raise ValueError(f"having on {key!r} needs it in `by` or an aggregate")
            preds.append(_field_filter(F.col(key), value, dtypes[key]))
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def group_by(df: DataFrame, by: list[str] | str, *, sum: Any = None, avg: Any = None, min: Any = None,
             max: Any = None, count: Any = None, having: dict | None = None, order: Any = None,
             take: int | None = None, skip: int | None = None) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    if not by:
        raise ValueError("group_by needs at least one field")
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    for b in by:
        if b not in dtypes:
            raise ValueError(f"unknown group field {b!r}")
    if (take is not None or skip is not None) and not order:
        raise ValueError("take / skip in group_by need an order")
    aggs: dict[str, Column] = {}
    for agg, spec in (("_sum", sum), ("_avg", avg), ("_min", min), ("_max", max), ("_count", count)):
        for f in _fields(spec):
            if agg in ("_sum", "_avg") and not isinstance(dtypes.get(f), NUMERIC):
                raise ValueError(f"{agg} needs a numeric field, {f!r} is {dtypes.get(f)}")
            name = agg_name(agg, f)
            aggs[name] = _agg_expr(agg, f).alias(name)
    visible = list(aggs)
    extra: dict[str, Column] = dict(aggs)
    pred = _having(having, by, dtypes, extra) if having else None
    if not extra:
        out = df.select(*by).distinct()
    else:
        out = df.groupBy(*by).agg(*extra.values())
    if pred is not None:
        out = out.where(pred)
    out = out.select(*by, *visible)
    if order:
        from .read import SMALL_TAKE, parse_order, slice_rows
        sort = []
        for f, d in parse_order(order):
            if f not in by:
                raise ValueError(f"group_by order field {f!r} must be in `by`")
            c = F.col(f)
            sort.append(c.asc_nulls_first() if str(d).lower() == "asc" else c.desc_nulls_last())
        # the group keys are unique per row, so appending them makes the order total
        sort += [F.col(b).asc_nulls_first() for b in by if b not in [f for f, _ in parse_order(order)]]
        if (take or 0) + (skip or 0) > SMALL_TAKE or (skip and take is None):
            return slice_rows(out, sort, skip or 0, take)
        out = out.orderBy(*sort)
        if skip:
            out = out.offset(skip)
        if take is not None:
            out = out.limit(take)
    return out
