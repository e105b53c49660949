"""Streaming jobs, run on the events table as a stream until all of it has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import stream_features as stream_formulas
from ..plans.stream import StreamOutputs, run_stream_of
from ..schema import CORRUPT, STREAM_COLUMNS
from ..sources.batches import read_batches
from ..sources.messages import read_flow_messages
from ..sources.scratch import scratch_path
from ..streaming import flows as st
from . import fixtures as fx
from .flow_queries import rounded
from .registry import register

_STREAM_RAW = "SELECT * FROM fx_flows"
_FILLED = ", ".join(
    {
        "timestamp": "timestamp",
        "src_ip": "coalesce(src_ip, 'UNKNOWN_SRC') AS src_ip",
        "dst_ip": "dst_ip",
        "protocol": "coalesce(protocol, 'UNKNOWN') AS protocol",
    }.get(c, f"cast({c} AS double) AS {c}")
    for c in STREAM_COLUMNS
)


def event_stream(spark, sf_dir):
    """The events table read as a stream of flows."""
    return fx.as_flows(raw_stream(spark, sf_dir))


def raw_stream(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return st.stream_flows(spark, path, spark.read.parquet(path).schema, "parquet")


def _options(spark) -> st.StreamOptions:
    return st.StreamOptions(scratch_path(spark, "checkpoint"), trigger_seconds=None)


def _table_of(spark, stream):
    """Run a stream to the end of its input and read the table it wrote."""
    path, options = scratch_path(spark, "stream-table"), _options(spark)
    st.run_bounded(st.write_stream_features(stream, path, options), options)
    return spark.read.schema(stream.schema).parquet(path)


@register("clean_stream", fx.with_fixtures(f"SELECT event_id, {_FILLED} FROM fx_flows"))
def clean_stream(spark, sf_dir):
    return _table_of(spark, st.clean_stream(event_stream(spark, sf_dir), keep=("event_id",)))


@register(
    "dedupe_stream",
    fx.with_fixtures(f"SELECT DISTINCT timestamp, src_ip, dst_ip, port, protocol FROM (SELECT {_FILLED} FROM fx_flows) f"),
)
def dedupe_stream(spark, sf_dir):
    """Every fiftieth flow arrives twice."""
    resent = fx.resent(event_stream(spark, sf_dir))
    deduped = st.dedupe_stream(st.clean_stream(resent))
    return _table_of(spark, deduped.select("timestamp", "src_ip", "dst_ip", "port", "protocol"))


@register(
    "stream_quarantine",
    fx.with_fixtures(
        "SELECT 'kept' AS kind, cast(event_id AS varchar) AS what FROM fx_flows WHERE event_id % 37 <> 0 "
        "UNION ALL SELECT 'rejected', 'broken ' || event_id FROM fx_flows WHERE event_id % 37 = 0"
    ),
)
def stream_quarantine(spark, sf_dir):
    """Flows as messages, some of them no JSON: every one ends in the feature table or in the quarantine."""
    flows = event_stream(spark, sf_dir)
    named = flows.withColumn("dst_ip", F.col("event_id").cast("string"))
    text = F.when(F.col("event_id") % 37 == 0, F.concat(F.lit("broken "), F.col("event_id"))).otherwise(
        F.to_json(F.struct(*[F.col(c) for c in STREAM_COLUMNS]))
    )
    out = StreamOutputs.below(scratch_path(spark, "stream-job"))
    run_stream_of(read_flow_messages(named.select(text.alias("value"))), out, _options(spark))
    kept = read_batches(spark, out.features).select(F.lit("kept").alias("kind"), F.col("dst_ip").alias("what"))
    return kept.unionByName(read_batches(spark, out.quarantine).select(F.lit("rejected").alias("kind"), F.col(CORRUPT).alias("what")))


@register(
    "enrich_stream",
    "SELECT f.event_id, f.user_id AS user_key, c.c_name, c.c_mktsegment FROM events f LEFT JOIN customer c ON c.c_custkey = f.user_id",
)
def enrich_stream(spark, sf_dir):
    events = raw_stream(spark, sf_dir)
    customers = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_key", "c_name", "c_mktsegment")
    return _table_of(spark, st.enrich_stream(events.selectExpr("event_id", "user_id AS user_key"), customers, "user_key"))


@register(
    "enrich_stream_job",
    fx.with_fixtures(
        "SELECT f.event_id, coalesce(f.src_ip, 'UNKNOWN_SRC') AS src_ip, c.c_name, c.c_mktsegment FROM fx_flows f "
        "LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = f.event_id % 7"
    ),
)
def enrich_stream_job(spark, sf_dir):
    """The whole job on flows of seven ports, whose owners it looks up; three of ten of the ports have none. Hot ports are spread."""
    ports = (F.col("event_id") % 7).cast("double")
    flows = event_stream(spark, sf_dir).withColumns({"port": ports, "dst_ip": F.col("event_id").cast("string")})
    owners = fx.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    owners = owners.select(F.col("c_custkey").cast("double").alias("port"), "c_name", "c_mktsegment")
    out = StreamOutputs.below(scratch_path(spark, "enriched-job"))
    run_stream_of(flows.withColumn(CORRUPT, F.lit(None).cast("string")), out, _options(spark), st.Enrichment(owners, "port", 1000))
    return read_batches(spark, out.features).select(F.col("dst_ip").cast("long").alias("event_id"), "src_ip", "c_name", "c_mktsegment")


_STREAM_STATS = (
    f"(SELECT src_ip, count(*) AS n, count(DISTINCT port) AS ports, avg(request_rate) AS m, stddev_pop(request_rate) AS sd, "
    f"max(connection_duration) AS longest FROM (SELECT {_FILLED} FROM fx_flows) f GROUP BY src_ip)"
)
_SPIKE = "abs(request_rate - s.m) / (s.sd + 1)"
_STREAM_FEATURES = f"""SELECT f.*, round(request_rate / (connection_duration + 1), 6) AS connection_rate,
  round(CASE WHEN status_code IN (401, 403, 429) THEN 1e0 ELSE 0e0 END / (login_attempts + 1), 6) AS failed_login_ratio,
  s.ports AS port_scan_score, round({_SPIKE}, 6) AS traffic_spike_score, s.longest AS session_duration,
  round(-(packet_size / (bytes_transferred + 1)) * log2(packet_size / (bytes_transferred + 1) + 1e-9), 6) AS packet_entropy,
  s.ports AS unique_ports_accessed
FROM (SELECT {_FILLED} FROM fx_flows) f JOIN {_STREAM_STATS} s ON f.src_ip = s.src_ip"""


@register("stream_features", fx.with_fixtures(_STREAM_FEATURES))
def stream_features(spark, sf_dir):
    path, reports = scratch_path(spark, "stream-features"), scratch_path(spark, "stream-reports")
    options = _options(spark)
    st.run_bounded(st.start_feature_stream(st.clean_stream(event_stream(spark, sf_dir)), path, reports, options), options)
    return rounded(read_batches(spark, path).drop("processed_at", "batch_id"))


@register(
    "stream_batch_metrics",
    fx.with_fixtures(
        f"SELECT count(*) AS records, count(CASE WHEN {_SPIKE} > 2 THEN 1 END) AS high_spike_rows "
        f"FROM (SELECT {_FILLED} FROM fx_flows) f JOIN {_STREAM_STATS} s ON f.src_ip = s.src_ip"
    ),
)
def stream_batch_metrics(spark, sf_dir):
    return st.stream_batch_metrics(stream_formulas(st.clean_stream(fx.flows(spark, sf_dir))))


_WINDOW_SQL = f"""SELECT window_start, window_start + {{size}} AS window_end, src_ip, count(*) AS flows, count(DISTINCT port) AS unique_ports_accessed,
  round(avg(request_rate), 6) AS avg_request_rate, round(stddev_pop(request_rate), 6) AS std_request_rate, max(connection_duration) AS session_duration
FROM (SELECT {_FILLED}, cast(floor(epoch(cast(timestamp AS timestamp)) / {{size}}) AS bigint) * {{size}} AS window_start FROM fx_flows) f
{{where}} GROUP BY 1, 2, 3"""


def _closed_table_of(spark, stream, windows):
    """Run windows of a stream to the end of its input, close those still open and read the table they wrote."""
    path, options = scratch_path(spark, "stream-table"), _options(spark)
    end = st.StreamEnd(scratch_path(spark, "stream-end"))
    st.run_to_end(stream, end, lambda df: st.write_stream_features(windows(df), path, options), options)
    return spark.read.schema(windows(stream).schema).parquet(path)


@register("window_ip_stats", fx.with_fixtures(_WINDOW_SQL.format(size=3600, where="")))
def window_ip_stats(spark, sf_dir):
    """As a stream; the windows that the watermark has not passed by the end of the input are closed by its end."""
    windows = lambda df: st.window_ip_stats(st.clean_stream(df))
    return rounded(_closed_table_of(spark, event_stream(spark, sf_dir), windows))


@register("window_ip_stats_batch", fx.with_fixtures(_WINDOW_SQL.format(size=3600, where="")))
def window_ip_stats_batch(spark, sf_dir):
    return rounded(st.window_ip_stats(st.clean_stream(fx.flows(spark, sf_dir))))


@register(
    "traffic_windows",
    """SELECT minute_start, strftime(make_timestamp(minute_start * 1000000), '%H:%M') AS time, requests,
  requests > 1.6 * avg(requests) OVER (ORDER BY minute_start ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS "isAnomaly"
FROM (SELECT cast(epoch(date_trunc('minute', ts)) AS bigint) AS minute_start, count(*) AS requests FROM events GROUP BY 1) t""",
)
def traffic_windows(spark, sf_dir):
    """As two streams: flows to closed minutes, and these judged by the 36 latest ones with requests."""
    minutes = _closed_table_of(spark, event_stream(spark, sf_dir), st.traffic_windows)
    [path] = {f.rsplit("/", 1)[0] for f in minutes.inputFiles()}
    return _table_of(spark, st.anomalous_minutes(st.stream_flows(spark, path, minutes.schema, "parquet")))
