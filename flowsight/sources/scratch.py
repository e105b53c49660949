"""Work tables in the cluster's shared checkpoint folder.

A staged table cuts lineage the way ``checkpoint()`` does: it lies on shared storage, so a lost
executor costs a re-read and not a re-run, and values that depend on a shuffle's layout stay fixed.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folder of the innermost open Workspace.
_OPEN: ContextVar[str | None] = ContextVar("workspace", default=None)


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's work tables, below ``spark.checkpoint.dir``.

    Where nothing is configured, as in tests, a folder is set as the checkpoint folder once, and only under a local
    master: on a cluster a machine's own folder would not be seen by the others.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flowsight-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/flowsight-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the open Workspace where there is one."""
    return f"{_OPEN.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """All work tables of one job, also those its operators stage, removed together when its outputs are written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self._count = spark, scratch_path(spark, label), 0

    def stage(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.path}/{self._count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        self._outer = _OPEN.set(self.path)
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.reset(self._outer)
        fs, target = hadoop_path(self.spark, self.path)
        fs.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) for checks that no DataFrame reader offers."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return bool(fs.exists(target))


def pattern_exists(spark: SparkSession, pattern: str) -> bool:
    """Is there a path that matches?"""
    fs, target = hadoop_path(spark, pattern)
    return bool(fs.globStatus(target))


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's work tables; call it when no staged frame is needed any more."""
    fs, target = hadoop_path(spark, scratch_root(spark))
    fs.delete(target, True)
