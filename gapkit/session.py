"""Session settings the library relies on, and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings worth having on a cluster. Skew handling and partition sizing are left to AQE.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # sorted input, as a window leaves it, is aggregated in a stream instead of in a hash table
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}
# Only when a session is built: drop checkpoints that nothing refers to any more.
BUILD_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

# For streams that hold keys: state on disk, only what changed in each checkpoint, and one memory for all stores of an executor.
# Counting rows would look up each key once more.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the plans rely on, where the session says nothing else: hot keys of joins are split at run time, sorted
    rows are aggregated in a stream."""
    for key in ("spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.execution.replaceHashWithSortAgg"):
        if spark.conf.get(key) != RECOMMENDED_CONF[key] and key not in _said(spark):
            spark.conf.set(key, RECOMMENDED_CONF[key])
    return spark


def _said(spark: SparkSession) -> set[str]:
    return {key for key, _ in spark.sparkContext.getConf().getAll()}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder. Where the session names none, a local one is picked, on a local master only: on a cluster
    each executor would write to its own disk."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="gapkit-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current
