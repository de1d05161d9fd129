"""Tables stored in buckets of their key, so that an upsert reads and shuffles only what it must (M3, K7).

A table is partitioned into groups of the key's hash (folders) and each group
into Spark buckets of the key (files).  An upsert

* reads the groups that the changes touch (at most ``groups`` numbers reach the
  driver) and writes those alone; a manifest names a version for each group;
* joins without a shuffle of the stored side: Spark knows from the bucket files
  that equal keys lie in equal buckets, and deals only the changes to them.

The number of buckets is chosen from the measured size of the data when the
table is made, and kept in the manifest.  A publish that was computed from
groups which another job has published meanwhile raises ``PublishConflict``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import ident
from ..model import ModelSpec
from ..operators import mutate as M
from . import sinks

#: Bytes of a bucket over all groups, about.
BUCKET_BYTES = 128 << 20
GROUPS = 16
GROUP = "__group"


def measured_bytes(df: DataFrame) -> int:
    """Spark's estimate of the data's size, which for files is their measured length."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class BucketedTable:
    def __init__(self, spark: SparkSession, root: str, spec: ModelSpec):
        if not spec.key:
            raise ValueError(f"{spec.name} has no key to bucket by")
        self.spark, self.root, self.spec = spark, root, spec

    def _names(self, versions: dict[str, str]) -> dict[int, str]:
        head = f"{self.spec.name}#"
        return {int(k[len(head):]): v for k, v in versions.items() if k.startswith(head)}

    def _meta(self, versions: dict[str, str]) -> tuple[int, int, str]:
        """Groups, buckets and the column types as a DDL string."""
        note = versions.get(f"@{self.spec.name}")
        if note is None:
            raise KeyError(f"no bucketed table {self.spec.name!r} under {self.root}")
        groups, buckets, ddl = note.split(" ", 2)
        return int(groups), int(buckets), ddl

    def _group(self, groups: int):
        return F.pmod(F.xxhash64(*self.spec.key), F.lit(groups)).cast("int")

    def _write(self, df: DataFrame, groups: int, buckets: int) -> str:
        """One new folder with a part of the table; its file names carry the bucket numbers."""
        version = uuid.uuid4().hex
        name = f"quarry_{self.spec.name}_{version}"
        key = list(self.spec.key)
        # dealt as the buckets are: a task writes one bucket, a file a group
        rows = df.withColumn(GROUP, self._group(groups)).repartition(buckets, *key)
        rows.write.partitionBy(GROUP).bucketBy(buckets, *key).sortBy(*key).option("path", f"{self.root}/{self.spec.name}/v={version}").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
        return version

    def create(self, df: DataFrame, buckets: int | None = None, groups: int = GROUPS) -> None:
        """Make the table; NULL and repeated keys are refused."""
        M.check_key(df, self.spec.key)
        M.check_distinct(df, self.spec.key)
        buckets = buckets or max(1, -(-measured_bytes(df) // BUCKET_BYTES))
        version = self._write(df, groups, buckets)
        ddl = ", ".join(f"{ident(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
        seen = sinks.current_versions(self.spark, self.root)
        sinks.switch(self.spark, self.root, {f"{self.spec.name}#{g}": version for g in range(groups)} | {f"@{self.spec.name}": f"{groups} {buckets} {ddl}"}, seen)

    def read(self, groups: list[int] | None = None, versions: dict[str, str] | None = None) -> DataFrame:
        """The table's current rows (of some groups); its plan knows the buckets."""
        versions = sinks.current_versions(self.spark, self.root) if versions is None else versions
        _, buckets, ddl = self._meta(versions)
        name = f"quarry_{self.spec.name}_{uuid.uuid4().hex}"
        key = ", ".join(ident(k) for k in self.spec.key)
        self.spark.sql(f"CREATE TABLE {name} ({ddl}, {GROUP} int) USING parquet PARTITIONED BY ({GROUP}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
                       f"LOCATION '{self.root}/{self.spec.name}/none-{name}'")
        for g, version in sorted(self._names(versions).items()):
            path = f"{self.root}/{self.spec.name}/v={version}/{GROUP}={g}"
            if (groups is None or g in groups) and sinks.path_exists(self.spark, path):
                self.spark.sql(f"ALTER TABLE {name} ADD PARTITION ({GROUP}={g}) LOCATION '{path}'")
        return self.spark.table(name).drop(GROUP)

    def merged(self, changes: DataFrame, seq: str | None = None, versions: dict[str, str] | None = None) -> tuple[M.Result, list[int]]:
        """The touched groups after an upsert, and their numbers."""
        versions = sinks.current_versions(self.spark, self.root) if versions is None else versions
        groups, _, _ = self._meta(versions)
        touched = sorted(r[0] for r in changes.select(self._group(groups)).distinct().collect())  # at most ``groups`` numbers
        return M.upsert(self.read(touched, versions), changes, self.spec, seq=seq), touched

    def upsert(self, changes: DataFrame, seq: str | None = None) -> list[int]:
        """M3 on the stored table: insert new keys, update the others; returns the groups that were written."""
        versions = sinks.current_versions(self.spark, self.root)
        groups, buckets, _ = self._meta(versions)
        result, touched = self.merged(changes, seq, versions)
        if touched:
            version = self._write(result.table, groups, buckets)
            sinks.switch(self.spark, self.root, {f"{self.spec.name}#{g}": version for g in touched}, versions)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """M8 by a table of keys."""
        versions = sinks.current_versions(self.spark, self.root)
        groups, buckets, _ = self._meta(versions)
        touched = sorted(r[0] for r in keys.select(self._group(groups)).distinct().collect())
        if touched:
            version = self._write(M.delete_keys(self.read(touched, versions), keys, self.spec.key).table, groups, buckets)
            sinks.switch(self.spark, self.root, {f"{self.spec.name}#{g}": version for g in touched}, versions)
        return touched
