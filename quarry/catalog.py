"""A catalog: named DataFrames plus their model specs.

Relation filters and includes need the related table, so operations take the
catalog rather than a lone DataFrame.  The catalog only holds lazy DataFrames;
nothing is read until an action runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import CATALOGUE_MODELS, FIXTURE_MODELS, FIXTURE_TABLES, ModelSpec


class Catalog:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None,
                 models: dict[str, ModelSpec] | None = None):
        self.spark = spark
        self.tables: dict[str, DataFrame] = dict(tables or {})
        self.models: dict[str, ModelSpec] = dict(models or {})
        self.loaders: dict = {}
        self.landed: dict[str, DataFrame] = {}  # landing fixtures derived from these tables, once written

    # -- construction -----------------------------------------------------
    @classmethod
    def from_fixture_dir(cls, spark: SparkSession, sf_dir: str) -> "Catalog":
        """The driver's tables, read on first use (each read resolves a schema)."""
        loaders = {t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in FIXTURE_TABLES}
        # link table derived from the child rows: one row per (part, supplier) pair
        cat = cls(spark, {}, FIXTURE_MODELS)
        loaders["part_supplier"] = lambda: cat.df("lineitem").select("l_partkey", "l_suppkey").distinct()
        cat.loaders = loaders
        return cat

    @classmethod
    def from_table_dir(cls, spark: SparkSession, root: str, models: dict[str, ModelSpec] | None = None
                       ) -> "Catalog":
        """Catalogue tables stored as ``<root>/<Model>`` parquet folders."""
        models = models or CATALOGUE_MODELS
        tables = {name: spark.read.schema(m.schema).parquet(f"{root}/{name}") for name, m in models.items()}
        return cls(spark, tables, models)

    @classmethod
    def empty_catalogue(cls, spark: SparkSession) -> "Catalog":
        tables = {name: spark.createDataFrame([], m.schema) for name, m in CATALOGUE_MODELS.items()}
        return cls(spark, tables, CATALOGUE_MODELS)

    # -- access -------------------------------------------------------------
    def df(self, name: str) -> DataFrame:
        if name not in self.tables:
            if name not in self.loaders:
                raise KeyError(f"unknown table {name!r}")
            self.tables[name] = self.loaders[name]()
        return self.tables[name]

    def model(self, name: str) -> ModelSpec:
        return self.models.get(name) or ModelSpec(name)

    def with_table(self, name: str, df: DataFrame) -> "Catalog":
        tables = dict(self.tables)
        tables[name] = df
        out = Catalog(self.spark, tables, self.models)
        out.loaders = {k: v for k, v in self.loaders.items() if k not in tables}
        if "part_supplier" in out.loaders:
            out.loaders["part_supplier"] = lambda: out.df("lineitem").select("l_partkey", "l_suppkey").distinct()
        return out

    def with_loaders(self, loaders: dict) -> "Catalog":
        """Tables that are built (planned and analysed) only when asked for."""
        out = Catalog(self.spark, {k: v for k, v in self.tables.items() if k not in loaders}, self.models)
        out.loaders = {**self.loaders, **loaders}
        return out

    def table(self, name: str):
        from .operators.table import Table
        return Table(self, name)

    def __getitem__(self, name: str):
        return self.table(name)
