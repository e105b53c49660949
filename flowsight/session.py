"""Session settings for large inputs. The library itself never changes a session's configuration."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

SHUFFLE_BYTES = 192 * 1024 * 1024
MOST_PARTITIONS = 200_000


def cluster_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that may shuffle all of its input once.

    AQE merges small shuffle partitions but cannot cut a large one outside joins, so the starting
    number follows the input; 100 TB gives partitions of about half a gigabyte at the upper limit
    and a fifth of one below it.
    """
    partitions = min(MOST_PARTITIONS, max(2 * cores, math.ceil(input_bytes / SHUFFLE_BYTES)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_BYTES),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
        "spark.sql.session.timeZone": "UTC",
    }


def build_session(name: str, input_bytes: int, cores: int, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**cluster_settings(input_bytes, cores), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
