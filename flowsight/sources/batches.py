"""The numbered batches of a streaming table, and the manifest of those that are committed.

A batch lies in ``batch_id=N`` and counts once an empty file ``_committed/N.<query id>`` stands beside it. Creating that
file is one step on every store, so a reader that goes by the manifest sees a batch whole or not at all, also while the batch
is being written again after a failure. A committed batch is never written again: a replay of it finds its entry.

A manifest grows by one name per batch and nothing but names is read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .scratch import hadoop_path

MANIFEST = "_committed"


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def _entries(spark: SparkSession, path: str, pattern: str) -> list[tuple[int, str]]:
    fs, target = hadoop_path(spark, f"{path.rstrip('/')}/{MANIFEST}/{pattern}")
    names = [s.getPath().getName() for s in fs.globStatus(target) or ()]
    return sorted((int(number), owner) for number, owner in (n.split(".", 1) for n in names))


def is_committed(spark: SparkSession, path: str, batch_id: int, owner: str) -> bool:
    """Has ``owner``, a streaming query, committed the batch? ``ValueError`` where another query has.

    A query that lost its checkpoint starts to number its batches anew; it must not take those of its predecessor for its own.
    """
    owners = [found for _, found in _entries(spark, path, f"{batch_id}.*")]
    if owners and owner not in owners:
        raise ValueError(f"batch {batch_id} of {path} belongs to another query or checkpoint; give this one a folder of its own")
    return bool(owners)


def commit(spark: SparkSession, path: str, batch_id: int, owner: str) -> None:
    fs, entry = hadoop_path(spark, f"{path.rstrip('/')}/{MANIFEST}/{batch_id}.{owner}")
    fs.create(entry, True).close()


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    return [number for number, _ in _entries(spark, path, "*")]


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The committed batches of a streaming table, with their ``batch_id``; an empty table of ``schema`` where there are none.

    A frame keeps the batches that were committed when it was made.
    """
    folders = [batch_folder(path, number) for number in committed_batches(spark, path)]
    if not folders:
        return spark.createDataFrame([], "batch_id int" if schema is None else schema)
    reader = spark.read.option("basePath", path)
    return (reader if schema is None else reader.schema(schema)).parquet(*folders)
