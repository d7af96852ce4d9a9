"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE sizes the reduce side from real shuffle sizes, so the initial partition number only has to be
# large enough for the biggest job; skewed joins are split at run time.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_scratch: str | None = None


def build_session(app: str = "ticketlake", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder, which goes when the program ends: on a cluster a
    machine-local path would be lost with its executor.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="ticketlake-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_local_scratch)
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write an intermediate table to the shared folder and read it back.

    The result survives the loss of any executor and every consumer reads the same rows. Its size is then
    known when the next query is planned: a lookup under ``spark.sql.autoBroadcastJoinThreshold`` is
    broadcast without first shuffling the other side, a larger one takes the shuffled join that AQE
    splits on hot keys.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Give a table that is stored in fewer pieces than there are cores one partition per core.

    Only for costly per-row work on a plain scan. A large table has more pieces than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
