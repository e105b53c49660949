"""Streaming flows: source, cleaning, enrichment, windows, feature sink.

Statistics over "everything seen so far" cannot be appended row by row. Two well-defined forms stand
in for them: the statistics of the micro-batch (``start_feature_stream``) and those of an event-time
window (``window_ip_stats``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsing import clock_label, event_time
from ..operators.clean import cast_flows, fill_defaults
from ..operators.features import STAT_COLUMNS, STREAM_FEATURE_COLUMNS, select_features, stream_features
from ..operators.skew import TASK_ROWS, join_per_key
from ..schema import CORRUPT, FLOW_KEY, STREAM_ALIASES, canonicalize
from ..sources.batches import batch_folder, commit, is_committed
from ..sources.scratch import hadoop_path

SPIKE_FROM = 2.0
END_OF_TIME = "2200-01-01T00:00:00Z"


@dataclass(frozen=True)
class StreamOptions:
    """Trigger, run limit and checkpoint of a streaming job; no interval means: all there is, then stop."""

    checkpoint: str
    trigger_seconds: int | None = 3
    max_runtime_seconds: int | None = 180

    def apply(self, writer: DataStreamWriter) -> DataStreamWriter:
        writer = writer.option("checkpointLocation", self.checkpoint)
        if self.trigger_seconds is None:
            return writer.trigger(availableNow=True)
        return writer.trigger(processingTime=f"{self.trigger_seconds} seconds")


def stream_path(path: str) -> str:
    """A pattern matching exactly ``path``: a table kept as one file then streams like a folder does."""
    path = path.rstrip("/") or path
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def stream_flows(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """New files below ``path`` as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(stream_path(path))


def clean_stream(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop corrupt rows, canonicalise, cast, fill: per-row work, the same on a batch and on a stream."""
    rows = df.where(F.col(CORRUPT).isNull()) if CORRUPT in df.columns else df
    return fill_defaults(cast_flows(canonicalize(rows, STREAM_ALIASES, keep)))


def dedupe_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated flow keys that arrive within ``delay`` of each other; state is bounded by it."""
    timed = df.withColumn("event_ts", event_time("timestamp")).withWatermark("event_ts", delay)
    return timed.dropDuplicatesWithinWatermark(list(FLOW_KEY))


def corrupt_rows(df: DataFrame) -> DataFrame:
    """What ``clean_stream`` leaves out, for the quarantine."""
    return df.where(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else df.limit(0)


def enrich_stream(df: DataFrame, static: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """LEFT join of a stream (or batch) with a static table holding one row per key.

    Counting keys on a stream is not possible before the join, so every key is salted: the static
    rows are repeated ``salts`` times and a key's stream rows go to that many tasks. ``enrich_batch`` counts the keys of
    a micro-batch instead and repeats only the rows of hot ones.
    """
    spread = F.pmod(F.xxhash64(*([c for c in df.columns if c != key] or [key])), F.lit(salts)).cast("int")
    copies = static.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", spread).join(copies, [key, "_salt"], "left").drop("_salt")


def enrich_batch(batch: DataFrame, static: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """LEFT join of a micro-batch, or any table, with one row per key; keys are spread by their rows in this batch.

    Also keys that ``static`` lacks are spread; they get nulls.
    """
    counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_flows"))
    return join_per_key(batch, counts.join(static, key, "left"), key, "_flows", task_rows)


@dataclass(frozen=True)
class Enrichment:
    """A table with one row per key whose columns every flow of a job gets, such as the owners of addresses."""

    static: DataFrame
    key: str = "src_ip"
    task_rows: int = TASK_ROWS

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.static.columns if c != self.key)

    def apply(self, batch: DataFrame) -> DataFrame:
        clash = sorted({c.lower() for c in self.columns} & {c.lower() for c in (*batch.columns, *STREAM_FEATURE_COLUMNS, *STAT_COLUMNS)})
        if clash:
            raise ValueError(f"enrichment columns already belong to the flows: {', '.join(clash)}")
        return enrich_batch(batch, self.static, self.key, self.task_rows)


def high_spike(df: DataFrame, threshold: float = SPIKE_FROM) -> DataFrame:
    return df.where(F.col("traffic_spike_score") > threshold)


def stream_batch_metrics(df: DataFrame) -> DataFrame:
    """Records and high-spike rows in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("traffic_spike_score") > SPIKE_FROM).alias("high_spike_rows"),
    )


def window_ip_stats(
    df: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes",
    approximate_ports: bool = False,
) -> DataFrame:
    """Per-source statistics of event-time windows.

    On a stream a window is emitted once the watermark passes its end and later rows are dropped. Rows are first
    summed per (window, source, port) and the sums then per (window, source): state holds numbers and no sets, distinct
    ports are counted exactly, and a source with many rows is spread over its ports.
    """
    timed = df.withColumn("event_ts", event_time("timestamp")).withWatermark("event_ts", delay)
    frame = F.window("event_ts", window, slide) if slide else F.window("event_ts", window)
    rate = F.col("request_rate")
    per_port = timed.groupBy(frame, "src_ip", "port").agg(
        F.count(F.lit(1)).alias("flows"), F.count(rate).alias("rates"), F.sum(rate).alias("rate_sum"),
        F.sum(rate * rate).alias("square_sum"), F.max("connection_duration").alias("longest"),
    )
    ports = F.approx_count_distinct("port") if approximate_ports else F.count("port")
    mean = F.sum("rate_sum") / F.sum("rates")
    return per_port.groupBy("window", "src_ip").agg(
        F.sum("flows").alias("flows"),
        ports.alias("unique_ports_accessed"),
        mean.alias("avg_request_rate"),
        F.sqrt(F.greatest(F.sum("square_sum") / F.sum("rates") - mean * mean, F.lit(0.0))).alias("std_request_rate"),
        F.max("longest").alias("session_duration"),
    ).select(
        F.unix_seconds("window.start").alias("window_start"),
        F.unix_seconds("window.end").alias("window_end"),
        "src_ip", "flows", "unique_ports_accessed", "avg_request_rate", "std_request_rate", "session_duration",
    )


def traffic_windows(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests per minute of a stream, one row per minute once the watermark has passed it."""
    timed = df.withColumn("event_ts", event_time("timestamp")).withWatermark("event_ts", delay)
    counted = timed.groupBy(F.window("event_ts", "1 minute")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(F.unix_seconds("window.start").alias("minute_start"), "requests")


def _flag_minutes(points: int, factor: float):
    """Function that judges the minutes of a micro-batch, in order, by the latest ``points`` ones; these are the state."""

    def flag(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        minutes = pd.concat(list(parts)).sort_values("minute_start")
        latest = list(state.get[0]) if state.exists else []
        flags = []
        for requests in minutes["requests"]:
            latest = [*latest, int(requests)][-points:]
            flags.append(bool(requests > factor * (sum(latest) / len(latest))))
        state.update((latest,))
        yield pd.DataFrame({"minute_start": minutes["minute_start"], "requests": minutes["requests"], "isAnomaly": flags})

    return flag


def anomalous_minutes(minutes: DataFrame, points: int = 36, factor: float = 1.6) -> DataFrame:
    """Minutes with ``time`` and ``isAnomaly``: more than ``factor`` times the mean of the latest ``points`` minutes that have
    requests, itself included.

    ``minutes`` is the table that ``traffic_windows`` appends to, read as a stream without a limit of files (Spark allows no
    such state right behind an aggregate). Minutes leave their window in order, so each is judged once and for good; what
    is kept of the past are ``points`` numbers. The series is one sequence, hence one group, which gets a row a minute
    however many flows there are.
    """
    flagged = minutes.withColumn("series", F.lit(0)).groupBy("series").applyInPandasWithState(
        _flag_minutes(points, factor), "minute_start bigint, requests bigint, isAnomaly boolean", "latest array<bigint>",
        "append", GroupStateTimeout.NoTimeout,
    )
    return flagged.select("minute_start", clock_label(F.col("minute_start")).alias("time"), "requests", "isAnomaly")


def write_stream_features(df: DataFrame, path: str, options: StreamOptions, fmt: str = "parquet") -> StreamingQuery:
    """Append a stream to a table, exactly once by the sink's own log."""
    return options.apply(df.writeStream.format(fmt).outputMode("append").option("path", path)).start()


def _write_batch(
    path: str, reports: str, transform: Callable[[DataFrame], DataFrame], quarantine: str | None = None,
    enrichment: Enrichment | None = None,
):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        owner = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        if is_committed(spark, path, batch_id, owner):
            return
        folder = batch_folder(path, batch_id)
        columns = STREAM_FEATURE_COLUMNS
        rows = batch.persist()
        try:
            if quarantine is not None and not is_committed(spark, quarantine, batch_id, owner):
                rejected = corrupt_rows(rows).withColumn("quarantined_at", F.current_timestamp())
                rejected.write.mode("overwrite").parquet(batch_folder(quarantine, batch_id))
                commit(spark, quarantine, batch_id, owner)
            clean = rows if quarantine is None else clean_stream(rows)
            if enrichment is not None:
                clean, columns = enrichment.apply(clean), (*columns, *enrichment.columns)
            features = select_features(transform(clean), columns)
            features.withColumn("processed_at", F.current_timestamp()).write.mode("overwrite").parquet(folder)
        finally:
            rows.unpersist()
        report = stream_batch_metrics(spark.read.parquet(folder)).select(
            F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("generated_at"), "records", "high_spike_rows"
        )
        report.coalesce(1).write.mode("overwrite").json(batch_folder(reports, batch_id))
        commit(spark, path, batch_id, owner)

    return write


def start_feature_stream(
    df: DataFrame, path: str, reports: str, options: StreamOptions,
    transform: Callable[[DataFrame], DataFrame] = stream_features, quarantine: str | None = None,
    enrichment: Enrichment | None = None,
) -> StreamingQuery:
    """Features and metrics of every micro-batch of clean flows, in one query.

    With a ``quarantine`` folder ``df`` holds raw flows: each batch is cleaned here, and its corrupt rows are kept there. With an
    ``enrichment`` the features carry its columns.

    Each batch goes to a folder of its own number, is written again if a failure comes before its commit, and left alone
    after it, so every row is in the table exactly once. ``sources.batches.read_batches`` reads committed batches only. The
    metrics read the written batch, not the source again.
    """
    return options.apply(df.writeStream.foreachBatch(_write_batch(path, reports, transform, quarantine, enrichment))).start()


@dataclass(frozen=True)
class StreamEnd:
    """End of event time of a stream that is known to end: a folder that holds one late row once everything has been read.

    ``attach`` joins the folder's rows to the stream of raw flows, whose columns may all be null; the row moves the watermark
    past all windows, and its own one stays open for ever, so it shows up nowhere. Flows after the end are late and dropped.
    """

    folder: str

    def attach(self, df: DataFrame) -> DataFrame:
        fs, target = hadoop_path(df.sparkSession, self.folder)
        fs.mkdirs(target)
        return df.unionByName(df.sparkSession.readStream.schema(df.schema).parquet(stream_path(self.folder)))

    def mark(self, df: DataFrame) -> None:
        row = [F.lit(END_OF_TIME if f.name == "timestamp" else None).cast(f.dataType).alias(f.name) for f in df.schema]
        df.sparkSession.range(1).select(*row).write.mode("append").parquet(self.folder)


def run_to_end(df: DataFrame, end: StreamEnd, start: Callable[[DataFrame], StreamingQuery], options: StreamOptions) -> None:
    """Run a windowed query over all that is available, then close the windows that are still open.

    ``start`` starts the query on the stream it is given. It is started twice with one checkpoint: the second run reads
    nothing but the end, and a run that failed between the two is simply repeated.
    """
    whole = replace(options, trigger_seconds=None)
    run_bounded(start(end.attach(df)), whole)
    end.mark(df)
    run_bounded(start(end.attach(df)), whole)


def run_bounded(query: StreamingQuery, options: StreamOptions) -> None:
    """Wait for the run limit, or for the end of the available data, then stop."""
    try:
        if options.trigger_seconds is None or options.max_runtime_seconds is None:
            query.awaitTermination()
        else:
            query.awaitTermination(options.max_runtime_seconds)
    finally:
        query.stop()
