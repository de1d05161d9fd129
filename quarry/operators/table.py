"""``Table``: the per-model query / mutation surface over a ``Catalog``.

``cat.table("orders").find_many(where=…, order=…, take=…)`` returns a lazy
DataFrame.  Mutations return a new DataFrame for the table (and, where the
client returned a number, a one-row DataFrame with ``count``); persisting a new
version is ``quarry.sources.sinks.write_version``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_where, fresh_alias
from . import group as _group
from . import include as _include
from . import mutate as _mutate
from . import nested as _nested
from . import read as _read


class RecordNotFoundError(LookupError):
    pass


class Table:
    def __init__(self, cat, name: str):
        self.cat = cat
        self.name = name
        self.spec = cat.model(name)

    @property
    def df(self) -> DataFrame:
        return self.cat.df(self.name)

    # -- where --------------------------------------------------------------
    def where(self, where: Any) -> DataFrame:
        df = self.df
        if where is None:
            return df
        a = fresh_alias(self.name)
        return df.alias(a).where(compile_where(self.cat, self.name, where, a, df)).select(
            *[F.col(f"{a}.{c}") for c in df.columns])

    # -- reads ----------------------------------------------------------------
    def _keys(self, df: DataFrame, order: Any):
        return _read.sort_keys(df, order, self.spec.tiebreak(self.df))

    def find_many(self, where: Any = None, order: Any = None, take: int | None = None,
                  skip: int | None = None, cursor: dict | None = None, distinct: list[str] | None = None,
                  include: dict | None = None, select: list[str] | None = None) -> DataFrame:
        """where → distinct → cursor → skip → take, in the requested order."""
        df = self.where(where)
        keys = self._keys(df, order)
        if distinct:
            df = _read.first_per_group(df, list(distinct), keys)
        cursor_values = None
        if cursor:
            # the cursor names a row of the table, which the filter may leave out
            cursor_values = _read.cursor_row_values(self.df, keys, cursor)
            df = df.where(_read.cursor_row_exists(self.df, cursor))
        df = _read.page(df, keys, cursor_values=cursor_values, skip=skip, take=take,
                        ordered=order is not None)
        if include:
            df = _include.include(self.cat, self.name, df, include)
            if order is not None or skip or take is not None:  # joins give no order
                df = df.orderBy(*_read.as_sort(keys))
        if select:
            df = df.select(*select)
        return df

    def find_first(self, where: Any = None, order: Any = None, skip: int | None = None,
                   cursor: dict | None = None, include: dict | None = None, distinct: list[str] | None = None) -> DataFrame:
        return self.find_many(where=where, order=order, take=1, skip=skip, cursor=cursor, include=include, distinct=distinct)

    def find_first_or_raise(self, **kw) -> DataFrame:
        df = self.find_first(**kw)
        if df.isEmpty():
            raise RecordNotFoundError(f"no {self.name} row matches")
        return df

    def _unique_where(self, where: dict) -> dict:
        names = {"_".join(k): k for k in self.spec.unique_keys()}
        keys = set(where)
        ok = any(keys == set(k) or (len(keys) == 1 and next(iter(keys)) in names) for k in self.spec.unique_keys())
        if not ok:
            raise ValueError(f"find_unique on {self.name} needs a unique key, got {sorted(keys)}")
        return where

    def find_unique(self, where: dict, include: dict | None = None) -> DataFrame:
        df = self.where(self._unique_where(where))
        if include:
            df = _include.include(self.cat, self.name, df, include)
        return df

    def find_unique_or_raise(self, where: dict, include: dict | None = None) -> DataFrame:
        df = self.find_unique(where, include)
        if df.isEmpty():
            raise RecordNotFoundError(f"no {self.name} row for {where}")
        return df

    def count(self, where: Any = None, select: dict | None = None, take: int | None = None,
              skip: int | None = None, cursor: dict | None = None, order: Any = None) -> DataFrame:
        if take is None and skip is None and cursor is None:
            df = self.where(where)
        else:
            df = self.find_many(where=where, order=order, take=take, skip=skip, cursor=cursor)
        return _read.count_columns(df, select)

    def search(self, index, query: str, where: Any = None) -> DataFrame:
        """Rows whose indexed text holds every term (``sources.text_index``), with ``_relevance``; no text is read to find them."""
        (key,) = self.spec.key
        scores = index.scores(query).join(index.search(query), "id").select(F.col("id").alias("__id"), F.col("score").alias("_relevance"))
        df = self.where(where)
        return df.join(scores, df[key].cast("long") == scores["__id"]).drop("__id")

    def group_by(self, by, where: Any = None, **kw) -> DataFrame:
        return _group.group_by(self.where(where), by, **kw)

    def include(self, df: DataFrame, spec: dict) -> DataFrame:
        return _include.include(self.cat, self.name, df, spec)

    def include_flat(self, df: DataFrame, rel_name: str, args: Any = True) -> DataFrame:
        return _include.include_flat(self.cat, self.name, df, rel_name, args)

    # -- mutations (set-based; each returns DataFrames, nothing is written) -----
    def _including(self, res: _mutate.Result, include: dict | None) -> _mutate.Result:
        """The affected rows with their relations, read from the catalogue after the change."""
        if not include:
            return res
        return _mutate.Result(res.table, _include.include(self.cat.with_table(self.name, res.table), self.name, res.affected, include))

    def write(self, data: DataFrame, mode: str = "create", include: dict | None = None, check: bool = True) -> _nested.Written:
        """Create, update or upsert rows together with their related rows (``operators.nested``); all touched tables come back."""
        done = {"create": _nested.create, "update": _nested.update, "upsert": _nested.upsert}[mode](self.cat, self.name, data, check)
        if include:
            done.affected = _include.include(done.catalog, self.name, done.affected, include)
        return done

    def create(self, data: DataFrame, include: dict | None = None) -> DataFrame | _mutate.Result | _nested.Written:
        """The table after the insert; with ``include``, a Result whose affected rows carry their relations.
        Rows with columns for relations are written with their related rows, as ``write`` does."""
        if _nested.relation_columns(data, self.spec):
            return self.write(data, include=include)
        table = _mutate.insert(self.df, data, self.spec)
        if not include:
            return table
        return self._including(_mutate.Result(table, _mutate.conform(data, self.spec, like=self.df)), include)

    def create_many(self, data: DataFrame, skip_duplicates: bool = False) -> _mutate.Result:
        return _mutate.insert_many(self.df, data, self.spec, skip_duplicates=skip_duplicates)

    def upsert(self, changes: DataFrame, create: DataFrame | None = None, seq: str | None = None,
               include: dict | None = None) -> _mutate.Result:
        """``changes`` update present rows; absent ones are made from ``create`` (from ``changes`` without it)."""
        return self._including(_mutate.upsert(self.df, changes, self.spec, seq=seq, create=create), include)

    def update_many(self, data: dict, where: Any = None) -> _mutate.Result:
        a = fresh_alias(self.name)
        pred = compile_where(self.cat, self.name, where, a, self.df) if where is not None else None
        return _mutate.update_where(self.df.alias(a), data, pred, self.spec)

    def update(self, data: dict, where: dict, include: dict | None = None) -> _mutate.Result:
        return self._including(self.update_many(data, self._unique_where(where)), include)

    def delete_many(self, where: Any = None) -> _mutate.Result:
        a = fresh_alias(self.name)
        pred = compile_where(self.cat, self.name, where, a, self.df) if where is not None else None
        return _mutate.delete_where(self.df.alias(a), pred)

    def delete(self, where: dict, include: dict | None = None) -> _mutate.Result:
        res = self.delete_many(self._unique_where(where))
        if not include:
            return res
        return _mutate.Result(res.table, _include.include(self.cat, self.name, res.affected, include))
