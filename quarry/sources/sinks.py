"""Sinks: entity / child CSV, sorted id list, JSON outputs, and versioned
table write-back (K1–K5, K7; K6 model save lives in ``operators.ml``).

Every writer is a distributed ``DataFrameWriter`` call: files are written by
the executors, never gathered on the driver.  Table versions are immutable
folders; a new version becomes visible only when the manifest naming it is
written, so readers never see a half-written table and a job never overwrites
the path it reads.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import ident, iso_date, iso_datetime
from ..model import ModelSpec

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _python_text(df: DataFrame, date_cols: Iterable[str] = (), datetime_cols: Iterable[str] = ()) -> DataFrame:
    """Format values as the catalogue CSVs hold them: booleans ``True``/``False``,
    dates ``YYYY-MM-DD``, datetimes ISO-8601, NULL as an empty field."""
    date_cols, datetime_cols = set(date_cols), set(datetime_cols)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in date_cols:
            c = F.expr(iso_date(ident(f.name)))
        elif f.name in datetime_cols:
            c = F.expr(iso_datetime(ident(f.name)))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def has_rows(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists and holds at least one line (one small read)."""
    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException:
        return False


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").options(**CSV_OPTIONS).csv(path)


def write_entity_csv(spark: SparkSession, entities: DataFrame, path: str, columns: Iterable[str],
                     resume: bool = False) -> None:
    """K1: the fixed columns in order, a header per part file; overwrite unless
    resuming into a non-empty output, then append.  ``release_date`` as ISO date."""
    out = _python_text(entities.select(*columns), date_cols=("release_date",))
    write_csv(out, path, append=resume and has_rows(spark, path))


def write_child_csv(spark: SparkSession, rows: DataFrame, path: str, columns: Iterable[str],
                    datetime_cols: Iterable[str], resume: bool = False) -> None:
    """K2: child rows, datetimes as ISO-8601, NULL as an empty field."""
    out = _python_text(rows.select(*columns), datetime_cols=datetime_cols)
    write_csv(out, path, append=resume and has_rows(spark, path))


def write_sorted_ids(ids: DataFrame, path: str, column: str = "appid") -> None:
    """K3: unique ids in ascending order.  The sort range-partitions the ids,
    so part files are in order and each is sorted; no single task sees them all."""
    ids.select(column).distinct().orderBy(column).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K4 / K5: one JSON object per row (predictions, metrics)."""
    df.write.mode("overwrite").json(path)


# -- K7: versioned tables ------------------------------------------------------------

def _manifests(root: str) -> str:
    return f"{root}/_manifests"


def write_version(df: DataFrame, root: str, table: str, model: ModelSpec | None = None) -> str:
    """Write ``df`` as a new immutable version of ``table``; returns the version id.

    With a keyed ``model``, rows are clustered by the key: each file and row
    group holds one range of it, which their footers state, so a look-up by key
    reads the row groups that can hold it.  Further unique columns lie anywhere;
    they get bloom filters, which rule out nearly all other row groups."""
    version = uuid.uuid4().hex
    writer = df.write
    if model is not None and model.key:
        writer = df.repartitionByRange(*model.key).sortWithinPartitions(*model.key).write
        for column in sorted({c for key in model.unique_keys() for c in key if isinstance(df.schema[c].dataType, (T.StringType, T.IntegralType))}):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.mode("errorifexists").parquet(f"{root}/{table}/v={version}")
    return version


class PublishConflict(RuntimeError):
    """Another job published a table after this one read it."""


def switch(spark: SparkSession, root: str, changes: dict[str, str], based_on: dict[str, str] | None) -> dict[str, str]:
    """Add ``changes`` to the newest map by a manifest of the next number; with ``based_on``, none of them may have moved since."""
    while True:
        number, current = _newest(spark, root)
        if based_on is not None:
            moved = sorted(k for k in changes if current.get(k) != based_on.get(k))
            if moved:
                raise PublishConflict(f"published by another job since they were read: {moved}")
        current.update(changes)
        if _create_manifest(spark, root, number + 1, current):
            return current
        # another job published this number first: look at its map


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], based_on: dict[str, str] | None = None,
            models: dict[str, ModelSpec] | None = None) -> dict[str, str]:
    """Write every table's new version, then switch them all at once
    by writing one manifest; tables not named keep their current version.

    ``based_on`` is the map of versions that the tables were computed from
    (``current_versions`` before reading): if a job has published one of them
    in between, this raises ``PublishConflict`` and switches nothing.  Without
    it the tables replace what is there.  Tables with a spec in ``models`` are
    clustered by their key (``write_version``)."""
    return switch(spark, root, {name: write_version(df, root, name, (models or {}).get(name)) for name, df in tables.items()}, based_on)


def publish_update(spark: SparkSession, root: str, compute: Callable[[dict[str, str]], dict[str, DataFrame]], attempts: int = 5) -> dict[str, str]:
    """Compute tables from the current versions and publish them; when another job was faster, compute again from its versions.

    ``compute`` gets the version map and reads with ``read_version``."""
    for attempt in range(attempts):
        seen = current_versions(spark, root)
        try:
            return publish(spark, root, compute(seen), based_on=seen)
        except PublishConflict:
            if attempt + 1 == attempts:
                raise


def _folder(spark: SparkSession, root: str):
    """The manifest folder's path and its file context (any Hadoop file system)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_manifests(root))
    path = path.makeQualified(path.getFileSystem(conf).getUri(), path.getFileSystem(conf).getWorkingDirectory())
    return path, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf), path.getFileSystem(conf)


def _create_manifest(spark: SparkSession, root: str, number: int, versions: dict[str, str]) -> bool:
    """Write manifest ``number`` under a name of its own, then rename it without overwriting; False if the number exists."""
    jvm, (folder, context, system) = spark._jvm, _folder(spark, root)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
    out.close()
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, f"m-{number:012d}.json"),
                       spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        system.delete(draft, False)
        return False


def _newest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number and content of the newest manifest; only that one file is read."""
    folder, _, system = _folder(spark, root)
    if not system.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    names = sorted(n for n in names if n.startswith("m-"))
    if not names:
        return 0, {}
    text = "".join(r[0] for r in spark.read.text(f"{_manifests(root)}/{names[-1]}").collect())
    return int(names[-1][2:-5]), json.loads(text)


def current_versions(spark: SparkSession, root: str) -> dict[str, str]:
    """The table → version map of the newest manifest (one small file)."""
    return _newest(spark, root)[1]


def publish_buckets(spark: SparkSession, root: str, table: str, df: DataFrame, buckets: list[int]) -> None:
    """Replace some buckets of a table: ``df`` (with the column ``__b``) holds all their rows."""
    publish_parts(spark, root, {table: (df, buckets)})


def publish_parts(spark: SparkSession, root: str, parts: dict[str, tuple[DataFrame, list[int]]], notes: dict[str, str] | None = None,
                  based_on: dict[str, str] | None = None) -> dict[str, str]:
    """Replace some buckets of several tables at once, with ``notes`` in the same manifest.
    Each table gets one new folder; the manifest names a version for each bucket, and the others keep theirs."""
    def write(item: tuple[str, tuple[DataFrame, list[int]]]) -> dict[str, str]:
        table, (df, buckets) = item
        version = uuid.uuid4().hex
        df.write.mode("errorifexists").partitionBy("__b").parquet(f"{root}/{table}/v={version}")
        return {f"{table}#{b}": version for b in buckets}

    with ThreadPoolExecutor(4) as pool:  # the tables' jobs don't depend on each other
        changes = {k: v for part in pool.map(write, parts.items()) for k, v in part.items()}
    return switch(spark, root, changes | (notes or {}), based_on)


def read_buckets(spark: SparkSession, root: str, table: str, schema: T.StructType, buckets: list[int] | None = None,
                 versions: dict[str, str] | None = None) -> DataFrame:
    """The current rows of a bucketed table (of the named buckets only, if given)."""
    current = current_versions(spark, root) if versions is None else versions
    named = {int(k.split("#")[1]): v for k, v in current.items() if k.startswith(f"{table}#")}
    paths = [f"{root}/{table}/v={v}/__b={b}" for b, v in sorted(named.items()) if buckets is None or b in buckets]
    paths = [p for p in paths if path_exists(spark, p)]  # a bucket without rows has no folder
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_version(spark: SparkSession, root: str, table: str, versions: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """A table as a version map names it."""
    if table not in versions:
        raise KeyError(f"no published version of {table!r} under {root}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{table}/v={versions[table]}")


def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    return read_version(spark, root, table, current_versions(spark, root), schema)
