"""What the operators of this subpackage share: table reading and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Python workers run one thread each: Spark's task slots are the parallelism.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch; texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system at the end of a task: idle workers stay alive beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null texts as empty) of a documents-like table.

    Rows without an id are left out, as no result could name them; so are other columns.
    """
    small_batches(df.sparkSession)
    return df.where(df["doc_id"].isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


#: The folders of tables that ``stage`` returned.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Queries that run meanwhile take their shuffle files with them when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows rereads the files after a lost
    executor instead of repeating the work before them.  The shuffle files of
    the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stage`` wrote for these tables: nothing may read them, or what is made from them, any more."""
    for df in tables:
        if (folder := _FOLDERS.pop(df, None)) is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file; every machine has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)
