"""Registry of checked queries: name → (Spark callable, DuckDB twin SQL).

Every callable takes ``(spark, sf_dir)``, reads the driver's tables (or data
Spark derives from them) and returns a DataFrame; the SQL twin computes the
they check.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}
BENCH: list[str] = []


def query(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        if bench:
            BENCH.append(name)
        return fn
    return deco


_CATALOGS: dict = {}


def fixture_catalog(spark: SparkSession, sf_dir: str):
    """The driver's tables for ``sf_dir``, shared by the queries of one session
    (DataFrames are immutable; ``with_table`` always returns a new catalog)."""
    from ..catalog import Catalog
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = Catalog.from_fixture_dir(spark, sf_dir)
    return _CATALOGS[key]


QUERY_MODULES = ("q_read", "q_ingest", "q_mutate", "q_nested", "q_paging", "q_quality", "q_ml")


def load_all() -> None:
    """Import the query modules (importing registers their queries)."""
    import importlib
    import pkgutil
    from . import __path__ as pkg_path
    present = {m.name for m in pkgutil.iter_modules(pkg_path)}
    for mod in QUERY_MODULES:
        if mod in present:
            importlib.import_module(f"{__package__}.{mod}")
