"""Spark session helpers.

Everything in the package takes a ``SparkSession`` that the caller built; these
helpers only exist so tests, the bench and the CLI build it the same way.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants, whatever the cluster size.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # broadcast only what the optimizer has measured below this size
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}
# Local runs only: the driver is the executor, so its heap is the one that matters.
LOCAL_CONF = {"spark.driver.memory": "12g"}
# Cluster runs (hundreds of executors, ~100 TB inputs): many shuffle partitions
# that AQE coalesces toward ~256 MB each, 256 MB input splits, and skew-join
# splitting of partitions 5× the median.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "quarry", shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    elif master:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        # the master may come from spark-submit; what the user set there stays
        own = spark.sparkContext.getConf()
        for k, v in CLUSTER_CONF.items():
            if k not in conf and not own.contains(k):
                spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when a local session has none (tests) do we make one, under the
    system temp folder; on a cluster the setting must point at shared storage,
    and without it this raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
