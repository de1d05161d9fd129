"""Nested writes: rows that carry changes of their related rows, of any depth.

``data`` has the model's own columns and, for each relation to write through,
a struct column of that relation's name whose fields are the verbs:

* to-one:  ``create`` (a row), ``connect`` (a unique key), ``connect_or_create``
  (``where``, ``create``); in updates also ``disconnect`` and ``delete`` (boolean);
* to-many: arrays of the same, and in updates ``set``, ``disconnect``, ``delete``
  (unique keys).

A row inside ``create`` may hold relation structs again.  A NULL verb is not
given; an empty ``set`` leaves a parent without related rows.

The writes are ordered over the relations: rows that others refer to come
first (to-one), then the model's own rows, then the rows that refer to them
(to-many), where ``set``, ``disconnect`` and ``delete`` go before ``create``,
``connect_or_create`` and ``connect``.  Keys travel down as columns by
``explode``, so every verb is one set-based change of one table, whatever the
number of rows.  All touched tables come back together, for one ``publish``.

A related table whose foreign key is part of its own key is a link table:
there ``connect`` adds the link when it is missing and ``set`` / ``disconnect``
remove links; their keys name the other columns.  In other tables those verbs
set the foreign key, or clear it where it isn't required.

Several verbs of one relation work on the related table in turn.  What each
leaves, and the rows that carry the verbs, are checkpointed before the next one
reads them (a verb reads the table two or three times), so the work grows with
the number of verbs and not with the product of their reads.

Violations (a key that exists already or twice, a required column without a
value, a connected row that doesn't exist, a foreign key without a row) are
gathered as small DataFrames and looked for in one action.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ModelSpec, Relation
from . import mutate as M

TO_ONE = {"create", "connect", "connect_or_create"}
TO_ONE_UPDATE = TO_ONE | {"disconnect", "delete"}
TO_MANY_UPDATE = TO_ONE | {"set", "disconnect", "delete"}
#: To-many verbs in the order they work in.
ORDER = ("set", "disconnect", "delete", "create", "connect_or_create", "connect")


class RelatedNotFound(LookupError):
    pass


KINDS = {"unique": M.UniqueViolation, "required": M.RequiredViolation, "not found": RelatedNotFound}


@dataclass
class Written:
    """What a nested write leaves: the catalogue after it, the touched tables, and the model's written rows."""
    catalog: Any
    touched: list[str]
    table: DataFrame
    affected: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """All touched tables, for ``sinks.publish``."""
        return {name: self.catalog.df(name) for name in self.touched}


def relation_columns(df: DataFrame, spec: ModelSpec) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in spec.relations and isinstance(f.dataType, T.StructType)]


def create(cat, model: str, data: DataFrame, check: bool = True) -> Written:
    return _run(cat, model, data, "create", check)


def update(cat, model: str, data: DataFrame, check: bool = True) -> Written:
    """``data`` has the key, new values (NULL keeps the old one) and relation structs; rows whose key is absent do nothing."""
    return _run(cat, model, data, "update", check)


def upsert(cat, model: str, data: DataFrame, check: bool = True) -> Written:
    """``data`` has the key and two structs, ``create`` and ``update``: present rows take the second, others are made from the first."""
    key = list(cat.model(model).key)
    known = cat.df(model).select(*key)

    def part(name: str, how: str) -> DataFrame:
        fields = [f.name for f in data.schema[name].dataType.fields if f.name not in key]
        return data.join(known, key, how).select(*key, *[F.col(f"{name}.{f}").alias(f) for f in fields])

    run = _Run(cat)
    changed = run.write(model, part("update", "left_semi"), "update")
    made = run.write(model, part("create", "left_anti"), "create")
    run.check(check)
    return _written(run, model, changed.unionByName(made))


def _run(cat, model: str, data: DataFrame, mode: str, check: bool) -> Written:
    run = _Run(cat)
    rows = run.write(model, data, mode)
    run.check(check)
    return _written(run, model, rows)


def _written(run: "_Run", model: str, rows: DataFrame) -> Written:
    table, key = run.cat.df(model), list(run.cat.model(model).key)
    return Written(run.cat, run.touched, table, table.join(rows, key, "left_semi") if key else rows)


def set_columns(old: DataFrame, changes: DataFrame, key: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Rows that ``changes`` names take its values where ``__given_<column>`` holds, NULLs too."""
    new = changes.select(*key, *[F.col(c).alias(f"__new_{c}") for c in columns], *[F.col(f"__given_{c}") for c in columns])
    cols = [F.when(F.col(f"__given_{c}"), F.col(f"__new_{c}")).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in old.columns]
    return old.join(new, list(key), "left").select(*cols)


def _fields(df: DataFrame, path: str) -> list[str]:
    """Field names of a struct, or of an array's structs."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        kind = kind[name].dataType
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return [f.name for f in kind.fields]


def _kept(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, for several readers."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _one_per_key(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of rows that share a key, the smallest by their text (a batch has no order)."""
    w = Window.partitionBy(*key).orderBy(F.to_json(F.struct(*df.columns)))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


class _Run:
    def __init__(self, cat):
        self.cat, self.touched, self.bad, self.written = cat, [], [], []

    def put(self, model: str, df: DataFrame) -> None:
        self.cat = self.cat.with_table(model, df)
        if model not in self.touched:
            self.touched.append(model)

    def refuse(self, kind: str, text: str, df: DataFrame, columns) -> None:
        shown = F.to_json(F.struct(*[F.col(c) for c in columns]))
        self.bad.append(df.select(F.lit(kind).alias("kind"), F.concat(F.lit(text + " "), shown).alias("text")).limit(1))

    def check(self, wanted: bool) -> None:
        if not wanted:
            return
        for model, rows in self.written:
            for name, rel in self.cat.model(model).relations.items():
                if rel.kind == "one" and set(rel.fields) <= set(rows.columns):
                    keys = rows.select(*[F.col(f).alias(r) for f, r in zip(rel.fields, rel.references)]).dropna()
                    self.refuse("not found", f"{model}.{name} refers to no {rel.target}", keys.join(self.cat.df(rel.target).select(*rel.references), list(rel.references), "left_anti"), rel.references)
        found = reduce(DataFrame.unionByName, self.bad).limit(1).collect() if self.bad else []
        if found:
            raise KINDS[found[0]["kind"]](found[0]["text"])

    # -- one model's rows -------------------------------------------------------
    def write(self, model: str, rows: DataFrame, mode: str) -> DataFrame:
        spec = self.cat.model(model)
        relations = relation_columns(rows, spec)
        if mode == "update":
            if not spec.key:
                raise ValueError(f"{model} has no key to update by")
            rows = rows.join(self.cat.df(model).select(*spec.key), list(spec.key), "left_semi")
        for c in rows.columns:
            if c not in relations and c not in self.cat.df(model).columns and not c.startswith("__given_"):
                raise ValueError(f"{model} has no column {c!r}")
        for name in relations:
            if spec.relations[name].kind == "one":
                rows = self.to_one(model, rows, name, mode)
        self.own_rows(model, spec, rows.drop(*relations), mode)
        for name in relations:
            if spec.relations[name].kind == "many":
                self.to_many(model, rows, name, mode)
        return rows.select(*[c for c in rows.columns if c in (spec.key or self.cat.df(model).columns)])

    def own_rows(self, model: str, spec: ModelSpec, rows: DataFrame, mode: str) -> None:
        old = self.cat.df(model)
        if mode == "create":
            new = M.conform(rows.drop(*[c for c in rows.columns if c.startswith("__given_")]), spec, like=old)
            if spec.required:
                self.refuse("required", f"required fields missing on {model}", new.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.required])), spec.key or spec.required)
            if spec.key:
                self.refuse("unique", f"{model} has the key", new.select(*spec.key).join(old.select(*spec.key), list(spec.key), "left_semi"), spec.key)
                self.refuse("unique", f"key of {model} given twice", M.duplicate_keys(new, spec.key), spec.key)
            self.put(model, old.unionByName(new.select(*old.columns)))
            self.written.append((model, new))
            return
        self.refuse("unique", f"key of {model} given twice", M.duplicate_keys(rows, spec.key), spec.key)
        values = [c for c in old.columns if c in rows.columns and c not in spec.key]
        if values:
            given = [c for c in values if f"__given_{c}" not in rows.columns]
            changes = rows.withColumns({f"__given_{c}": F.col(c).isNotNull() for c in given}) if given else rows
            self.put(model, set_columns(old, changes, spec.key, values))
            self.written.append((model, rows.select(*spec.key, *values)))

    # -- verbs --------------------------------------------------------------------
    def verbs(self, model: str, rows: DataFrame, name: str, allowed: set[str]) -> list[str]:
        found = _fields(rows, name)
        if set(found) - allowed:
            raise ValueError(f"{model}.{name} takes {sorted(allowed)}, got {sorted(set(found) - allowed)}")
        return found

    def unique_of(self, model: str, fields: list[str]) -> tuple[str, ...]:
        for key in self.cat.model(model).unique_keys():
            if set(key) == set(fields):
                return key
        raise ValueError(f"{sorted(fields)} is no unique key of {model}")

    def referenced(self, rows: DataFrame, path: str, rel: Relation, tag: str) -> tuple[DataFrame, list[Column]]:
        """The related row's reference columns for a unique key at ``path``; by a look-up when the key is another one."""
        fields = _fields(rows, path)
        if set(rel.references) <= set(fields):
            return rows, [F.col(f"{path}.{r}") for r in rel.references]
        key = self.unique_of(rel.target, fields)
        target = self.cat.df(rel.target).select(*[F.col(k).alias(f"__{tag}_k_{k}") for k in key], *[F.col(r).alias(f"__{tag}_{r}") for r in rel.references])
        cond = reduce(lambda a, b: a & b, [F.col(f"{path}.{k}") == F.col(f"__{tag}_k_{k}") for k in key])
        rows = rows.join(target, cond, "left").drop(*[f"__{tag}_k_{k}" for k in key])
        return rows, [F.col(f"__{tag}_{r}") for r in rel.references]

    def absent(self, model: str, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
        return keys.join(self.cat.df(model).select(*key), list(key), "left_anti")

    def to_one(self, model: str, rows: DataFrame, name: str, mode: str) -> DataFrame:
        """Write the related rows, and fill this model's foreign key."""
        spec = self.cat.model(model)
        rel, columns = spec.relations[name], rows.columns
        verbs = self.verbs(model, rows, name, TO_ONE if mode == "create" else TO_ONE_UPDATE)
        filled: list[list[Column]] = []
        if "create" in verbs:
            made = rows.where(F.col(f"{name}.create").isNotNull()).select(f"{name}.create.*")
            if not set(rel.references) <= set(made.columns):
                raise ValueError(f"{model}.{name}.create needs {rel.references}")
            self.write(rel.target, made, "create")
            filled.append([F.col(f"{name}.create.{r}") for r in rel.references])
        if "connect_or_create" in verbs:
            path = f"{name}.connect_or_create"
            key = self.unique_of(rel.target, _fields(rows, f"{path}.where"))
            wanted = rows.where(F.col(path).isNotNull()).select(*[F.col(f"{path}.where.{k}").alias(k) for k in key], *[F.col(f"{path}.create.{c}").alias(c) for c in _fields(rows, f"{path}.create") if c not in key])
            self.write(rel.target, _one_per_key(self.absent(rel.target, wanted, key), key), "create")
            rows, found = self.referenced(rows, f"{path}.where", rel, "coc")
            filled.append(found)
        if "connect" in verbs:
            path = f"{name}.connect"
            key = self.unique_of(rel.target, _fields(rows, path))
            wanted = rows.where(F.col(path).isNotNull()).select(f"{path}.*")
            self.refuse("not found", f"{model}.{name} connects no {rel.target}", self.absent(rel.target, wanted, key), key)
            rows, found = self.referenced(rows, path, rel, "con")
            filled.append(found)
        cleared = F.lit(False)
        if "disconnect" in verbs:
            cleared = cleared | F.coalesce(f"{name}.disconnect", F.lit(False))
        if "delete" in verbs:
            gone = rows.where(f"{name}.delete").select(*spec.key).join(self.cat.df(model), list(spec.key)).select(*[F.col(f).alias(r) for f, r in zip(rel.fields, rel.references)])
            self.put(rel.target, self.cat.df(rel.target).join(gone, list(rel.references), "left_anti"))
            cleared = cleared | F.coalesce(f"{name}.delete", F.lit(False))
        if set(verbs) & {"disconnect", "delete"} and set(rel.fields) & (set(spec.required) | set(spec.key)):
            self.refuse("required", f"{model} needs its {name}", rows.where(cleared), spec.key)
        for i, f in enumerate(rel.fields):
            value = F.coalesce(*[v[i] for v in filled], *([F.col(f)] if f in columns else []), F.lit(None))
            rows = rows.withColumns({f"__{f}": F.when(~cleared, value), f"__given_{f}": cleared | value.isNotNull()})
        drop = [c for c in rows.columns if c not in columns and not c.startswith("__given_") and c not in {f"__{f}" for f in rel.fields}]
        rows = rows.drop(*rel.fields, *drop)
        return rows.withColumnsRenamed({f"__{f}": f for f in rel.fields})

    def to_many(self, model: str, rows: DataFrame, name: str, mode: str) -> None:
        """Write the rows that refer to this model's rows."""
        rel = self.cat.model(model).relations[name]
        child = self.cat.model(rel.target)
        verbs = self.verbs(model, rows, name, TO_ONE if mode == "create" else TO_MANY_UPDATE)
        if not set(rel.fields) <= set(rows.columns):  # an update names its key; other reference columns come from the table
            key = list(self.cat.model(model).key)
            rows = rows.join(self.cat.df(model).select(*key, *[f for f in rel.fields if f not in rows.columns]), key)
        if len(verbs) > 1:
            rows = _kept(rows)
            self.put(rel.target, _kept(self.cat.df(rel.target)))
        parent = [F.col(f).alias(r) for f, r in zip(rel.fields, rel.references)]
        link = bool(child.key) and set(rel.references) < set(child.key)
        others = [k for k in child.key if not link or k not in rel.references]
        if set(verbs) - {"create"} and not child.key:
            raise ValueError(f"{rel.target} has no key; {model}.{name} takes create alone")

        def done(verb: str) -> None:
            """The table as this verb leaves it, unless no other comes after it."""
            if any(v in verbs for v in ORDER[ORDER.index(verb) + 1:]):
                self.put(rel.target, _kept(self.cat.df(rel.target)))

        def listed(verb: str) -> DataFrame:
            return rows.select(*parent, F.explode(f"{name}.{verb}").alias("__item"))

        def keyed(verb: str, inner: str = "__item") -> DataFrame:
            """Parent columns (named as the foreign key) and the child's key; a link's key needs its other columns only."""
            items = listed(verb)
            fields = _fields(items, inner)
            if not set(others) <= set(fields):
                raise ValueError(f"{model}.{name}.{verb} needs {others}")
            if link:
                return items.select(*rel.references, *[F.col(f"{inner}.{k}").alias(k) for k in others], "__item")
            return items.select(*[F.col(r).alias(f"__to_{r}") for r in rel.references], *[F.col(f"{inner}.{k}").alias(k) for k in others], "__item")

        def point(keys: DataFrame, value) -> None:
            """Set (or clear) the foreign key of the named rows."""
            given = {f"__given_{r}": F.lit(True) for r in rel.references}
            changes = keys.select(*child.key, *[value(r).alias(r) for r in rel.references]).withColumns(given)
            self.refuse("unique", f"{rel.target} named twice", M.duplicate_keys(changes, child.key), child.key)
            self.put(rel.target, set_columns(self.cat.df(rel.target), changes, child.key, list(rel.references)))

        def clear(keys: DataFrame) -> None:
            if set(rel.references) & (set(child.required) | set(child.key)):
                self.refuse("required", f"{rel.target} needs {rel.references}", keys, child.key)
            point(keys.select(*child.key), lambda r: F.lit(None))

        def mine(keys: DataFrame) -> DataFrame:
            """The named rows that belong to the parent that names them."""
            if link:
                return keys.join(self.cat.df(rel.target).select(*child.key), list(child.key), "left_semi")
            now = self.cat.df(rel.target).select(*child.key, *[F.col(r).alias(f"__now_{r}") for r in rel.references])
            same = reduce(lambda a, b: a & b, [F.col(f"__now_{r}") == F.col(f"__to_{r}") for r in rel.references])
            return keys.join(now, list(child.key)).where(same)

        if "set" in verbs:
            parents = rows.where(F.col(f"{name}.set").isNotNull()).select(*parent)
            keys = keyed("set").drop("__item")
            now = self.cat.df(rel.target).join(parents.distinct(), list(rel.references), "left_semi")
            gone = now.join(keys.select(*child.key), list(child.key), "left_anti")
            if link:
                self.put(rel.target, self.cat.df(rel.target).join(gone.select(*child.key), list(child.key), "left_anti"))
                self.write(rel.target, self.absent(rel.target, keys.distinct(), child.key), "create")
            else:
                clear(gone)
                self.refuse("not found", f"{model}.{name} sets no {rel.target}", self.absent(rel.target, keys.select(*child.key), child.key), child.key)
                point(keys, lambda r: F.col(f"__to_{r}"))
            done("set")
        if "disconnect" in verbs:
            keys = mine(keyed("disconnect").drop("__item"))
            if link:
                self.put(rel.target, M.disconnect(self.cat.df(rel.target), keys, child.key).table)
            else:
                clear(keys)
            done("disconnect")
        if "delete" in verbs:
            keys = keyed("delete").drop("__item")
            self.refuse("not found", f"{model}.{name} deletes no {rel.target}", keys.join(mine(keys).select(*child.key), list(child.key), "left_anti"), child.key)
            self.put(rel.target, M.delete_keys(self.cat.df(rel.target), mine(keys), child.key).table)
            done("delete")
        if "create" in verbs:
            items = listed("create")
            fields = [c for c in _fields(items, "__item") if c not in rel.references]
            self.write(rel.target, items.select(*rel.references, *[F.col(f"__item.{c}").alias(c) for c in fields]), "create")
            done("create")
        if "connect_or_create" in verbs:
            keys = keyed("connect_or_create", "__item.where")
            fields = [c for c in _fields(keys, "__item.create") if c not in child.key and c not in rel.references]
            made = keys.select(*(child.key if link else [*others, *[F.col(f"__to_{r}").alias(r) for r in rel.references]]), *[F.col(f"__item.create.{c}").alias(c) for c in fields])
            known = keys.drop("__item").join(self.cat.df(rel.target).select(*child.key), list(child.key), "left_semi")
            missing = _one_per_key(self.absent(rel.target, made, child.key), child.key)
            if not link:
                point(known, lambda r: F.col(f"__to_{r}"))
            self.write(rel.target, missing, "create")
            done("connect_or_create")
        if "connect" in verbs:
            keys = keyed("connect").drop("__item")
            if link:
                self.write(rel.target, self.absent(rel.target, keys.distinct(), child.key), "create")
            else:
                self.refuse("not found", f"{model}.{name} connects no {rel.target}", self.absent(rel.target, keys, child.key), child.key)
                point(keys, lambda r: F.col(f"__to_{r}"))
