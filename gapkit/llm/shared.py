"""Intermediate tables and the shuffles of finished steps."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession

from gapkit.stored import stored  # noqa: F401 - the operators take it from here


def release(spark: SparkSession) -> None:
    """Let go of the shuffles of finished steps now. Spark drops a shuffle's files when the driver's JVM collects what refers to
    it, by default every half hour; a step that has read a table back needs none of them. Twice, as listeners hold the last query
    for a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
