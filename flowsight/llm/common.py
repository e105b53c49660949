"""Shared helpers: reading the text tables, fold numbers, words as bytes, Arrow output, what workers remember."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII letters folded, every other byte kept: UTF-8 text stays valid and no other letter changes.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE_BYTES = 2 << 20  # of a batch that is worked on at once: a batch may hold all rows of a task

_SHIPPED: set[str] = set()
_REMEMBERED: dict[Hashable, Any] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")  # read by the driver's file server
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def forget(but: Hashable = None) -> None:
    """Drop what this Python worker remembers under other keys: a worker serves the tasks of one operator after another."""
    for key in [k for k in _REMEMBERED if k != but]:
        del _REMEMBERED[key]


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker until another operator's task forgets it or remembers something of its own."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Maximal runs without space, tab, newline, vertical tab, form feed and return: what bytes.split() takes as blanks."""
    return text.split()


def sliced(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, halved until a part has at most ``most_bytes`` or one row."""
    parts = [batch]
    while parts:
        part = parts.pop()
        half = part.num_rows // 2
        if half and part.nbytes > most_bytes:
            parts += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def pooled(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """The rows of a task in pools of at most twice ``most_bytes``, whatever the size of its batches; one longer row is a part of its own."""
    pool: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in sliced(batch, most_bytes):
            pool.append(part)
            size += part.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(pool)
                pool, size = [], 0
    if pool:
        yield pa.Table.from_batches(pool)
