"""Scans: id lists, existing-key sets, model tables, CSV, rows, landing
payloads and raw SQL (S1–S11).

Every scan returns a lazy DataFrame.  File order, where the reference depends
on it, is kept as an explicit ``seq`` column taken at read time: the
triple (file, place of the split in it, row within the split), which sorts in
file order however Spark packs files into tasks.
"""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ModelSpec

# Text accepted as an integer: optional sign, digits, single underscores
# between digit groups, surrounding whitespace allowed.
# How our CSV sinks write: quotes doubled inside quoted text, line ends kept, no
# trimming.  A quoted line end makes a file unsplittable, so one task reads one
# (part) file; the sinks write one part file a task.
CSV_READ = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "nullValue": ""}
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def int_from_text(c: Column, to: str = "bigint") -> Column:
    """Whole-number text → integer, NULL for anything else (no exceptions)."""
    s = F.trim(c)
    return F.when(c.rlike(INT_TEXT), F.regexp_replace(s, "_", "").try_cast(to))


def read_id_list(spark: SparkSession, path: str, column: str = "appid") -> DataFrame:
    """Header CSV → ``(seq, appid bigint)``; blank / non-int rows dropped,
    order (``seq``: files by name, then rows by place) and duplicates kept.  A
    file without the column gives no ids."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if column not in raw.columns:
        return spark.createDataFrame([], "seq struct<file:string,block:long,row:long>, appid bigint")
    return (raw.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                F.monotonically_increasing_id().alias("row")).alias("seq"),
                       int_from_text(F.col(column)).alias("appid"))
               .where(F.col("appid").isNotNull()))


def existing_keys_from_csv(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """Distinct int ids of a CSV sink; a missing path is an empty set.
    Read as the sink writes, so line ends and quotes inside texts make no ids."""
    try:
        raw = spark.read.options(**CSV_READ).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], "id int")
    if column not in raw.columns:
        return spark.createDataFrame([], "id int")
    return raw.select(int_from_text(F.col(column), "int").alias("id")).where("id IS NOT NULL").distinct()


def existing_keys_from_table(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """S3: distinct keys of a stored table; only the key column is read."""
    return spark.read.parquet(path).select(F.col(key).alias("id")).distinct()


def model_scan(spark: SparkSession, path: str, spec: ModelSpec, columns: Iterable[str] | None = None) -> DataFrame:
    """Table scan under the model's schema, scalar columns only."""
    df = spark.read.schema(spec.schema).parquet(path) if spec.schema is not None else spark.read.parquet(path)
    scalars = [f.name for f in df.schema.fields
               if not isinstance(f.dataType, (T.StructType, T.MapType))]
    return df.select(*(columns or scalars))


def read_csv_inferred(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> DataFrame:
    """CSV with a header and inferred types.

    Inference costs a pass over the input; on big inputs pass a
    ``sampling_ratio`` (< 1) or read with a schema instead."""
    return spark.read.options(**CSV_READ).option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S5 with a declared schema: no inference pass."""
    return spark.read.options(**CSV_READ).schema(schema).csv(path)


def from_rows(spark: SparkSession, rows: list[dict] | list[tuple], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows → DataFrame (schema given, or inferred from the rows)."""
    return spark.createDataFrame(rows, schema)


def landing_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed raw payloads ``(id, source, page_no, body)`` with the body
    parsed to VARIANT; undecodable bodies give a NULL payload (= missing)."""
    df = spark.read.format(fmt).load(path)
    return landing_payloads(df)


def parse_body(body: Column) -> Column:
    """Strict JSON decode of a text body → VARIANT, NULL when it is not exactly
    one JSON value.  ``try_parse_json`` alone accepts trailing text (``'"k": 1}'``
    reads as ``"k"``); wrapping the body in ``[...]`` and requiring one element
    rejects that."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    # one pass over the (one-element) array: count items, keep the last; the
    # body is referenced once, so inlining this expression stays cheap
    init = F.struct(F.lit(0).alias("n"), F.lit(None).cast("variant").alias("v"))
    return F.aggregate(items, init, lambda acc, x: F.struct((acc["n"] + 1).alias("n"), x.alias("v")),
                       lambda acc: F.when(acc["n"] == 1, acc["v"]))


def landing_payloads(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", parse_body(F.col("body")))


# -- raw SQL (S9–S11) ----------------------------------------------------------------

def raw_query(spark: SparkSession, sql: str, args: list | dict | None = None,
              tables: dict[str, DataFrame] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """SQL with positional (``?``) or named parameters over the given tables
    (registered as temp views).  S11: an optional target schema casts the result."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql, args=args) if args is not None else spark.sql(sql)
    if schema is not None:
        out = cast_to(out, schema)
    return out


def raw_query_first(spark: SparkSession, sql: str, args: list | dict | None = None,
                    tables: dict[str, DataFrame] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """First row of a raw query (the SQL must ORDER BY to be deterministic)."""
    return raw_query(spark, sql, args, tables, schema).limit(1)


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared-type projection of raw results (bigint, decimal, json, arrays…)."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.VariantType):
            cols.append(F.try_parse_json(c.cast("string")).alias(f.name))
        else:
            cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
