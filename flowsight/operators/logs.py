"""Event-log and text-log operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import clock_label
from ..functions.rules import contains_any
from ..schema import quoted
from ..sources.batches import MANIFEST, read_batches
from ..sources.logs import LINE_ORDER, read_lines
from ..sources.scratch import path_exists, pattern_exists

SPARK_KEYWORDS = ("spark", "threat_detection")


def _descending(order: Sequence[str]) -> list[Column]:
    return [quoted(c).desc() for c in order]


def tail_n(df: DataFrame, n: int, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """The last ``n`` rows of the order, in that order: a top-k and a sort of ``n`` rows."""
    return df.orderBy(*_descending(order)).limit(n).orderBy(*[quoted(c) for c in order])


def latest_n_per_key(df: DataFrame, key: str, order: Sequence[str], n: int = 12) -> DataFrame:
    """The newest ``n`` rows of every key.

    Spark limits ranks per map task before the shuffle, so a large key sends ``n`` rows per task.
    """
    place = W.partitionBy(quoted(key)).orderBy(*_descending(order))
    return df.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= n).drop("_rank")


def log_filter(df: DataFrame, keywords: Sequence[str] = SPARK_KEYWORDS, column: str = "value") -> DataFrame:
    return df.where(contains_any(quoted(column), list(keywords)))


def component_log(
    lines: DataFrame, keywords: Sequence[str] = SPARK_KEYWORDS, n: int = 120, window: int = 300,
    order: Sequence[str] = LINE_ORDER,
) -> DataFrame:
    """Of the last ``window`` lines those that name a keyword, at most the last ``n`` of them."""
    return tail_n(log_filter(tail_n(lines, window, order), keywords), n, order)


def event_stats(events: DataFrame, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """Events per type with, on every row, the total (broken lines included) and the last timestamp."""
    known = ~F.col("malformed")
    # broken lines form a group with 0 events; a condition on the count, unlike one on the group key,
    # leaves the aggregate as the total reads it, so both share one pass
    per_type = events.groupBy(
        F.when(known, F.coalesce("event_type", F.lit("unknown"))).alias("event_type")
    ).agg(F.count_if(known).alias("events"), F.count(F.lit(1)).alias("lines"))
    total = per_type.agg(F.sum("lines")).scalar()
    dated = events.where(known & F.col("timestamp").isNotNull())
    last = dated.orderBy(*_descending(order)).limit(1).select("timestamp").scalar()
    return per_type.where(F.col("events") > 0).select(
        "event_type", "events", total.alias("total_events"), last.alias("last_event_at")
    )


def union_logs(logs: Mapping[str, DataFrame], n: int, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """The last ``n`` rows of each source, tagged with its name."""
    merged: DataFrame | None = None
    for name, df in logs.items():
        tagged = df.select(F.lit(name).alias("log_source"), *[quoted(c) for c in df.columns])
        merged = tagged if merged is None else merged.unionByName(tagged)
    if merged is None:
        raise ValueError("no log source given")
    return latest_n_per_key(merged, "log_source", order, n)


def recent_logs(spark: SparkSession, path: str, files: int = 4, n: int = 40) -> DataFrame:
    """The last ``n`` lines of each of the ``files`` most recently changed log files.

    The listing is read without content; only the chosen files are opened.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    newest = listing.orderBy(F.desc("modificationTime"), "path").limit(files).collect()
    if not newest:
        raise FileNotFoundError(path)
    return latest_n_per_key(read_lines(spark, [r.path for r in newest]), "log_file", ("log_block", "log_line"), n)


def traffic_series(df: DataFrame, at: str = "event_ts", points: int = 36) -> DataFrame:
    """Requests per minute for the last ``points`` minutes that have any; a minute above 1.6 times
    the mean of those shown is an anomaly."""
    per_minute = (
        df.where(F.col(at).isNotNull())
        .groupBy(F.window(at, "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.unix_seconds("w.start").alias("minute_start"), "requests")
    )
    shown = per_minute.orderBy(F.desc("minute_start")).limit(points)
    mean = F.avg("requests").over(W.partitionBy())  # at most ``points`` rows
    return shown.select(
        "minute_start",
        clock_label(F.col("minute_start")).alias("time"),
        "requests",
        (F.col("requests") > mean * 1.6).alias("isAnomaly"),
    )


def table_ready(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Has the table been committed, and does it hold a row? Of a stream's numbered batches the committed ones count."""
    if not path_exists(spark, path):
        return False
    if pattern_exists(spark, f"{path.rstrip('/')}/{MANIFEST}/*"):
        return not read_batches(spark, path).isEmpty()
    marks = ("_SUCCESS", "_spark_metadata", "_delta_log")
    if not any(pattern_exists(spark, f"{path.rstrip('/')}/{m}") for m in marks):
        return False
    return not spark.read.format(fmt).load(path).isEmpty()


def components_ready(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Which of the named output tables exist with data."""
    return spark.createDataFrame([(k, table_ready(spark, p)) for k, p in tables.items()], "component string, ready boolean")
