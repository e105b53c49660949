"""Per-source statistics and the feature tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.parsing import number_or_zero
from .skew import join_per_key

FEATURE_COLUMNS = (
    "timestamp",
    "src_ip",
    "dst_ip",
    "port",
    "protocol",
    "packet_size",
    "connection_duration",
    "login_attempts",
    "request_rate",
    "bytes_transferred",
    "status_code",
    "anomaly",
    "connection_rate",
    "failed_login_ratio",
    "port_scan_score",
    "traffic_spike_score",
    "session_duration",
    "packet_entropy",
    "unique_ports_accessed",
    "failed_logins_derived",
    "total_attempts_derived",
)
STREAM_FEATURE_COLUMNS = tuple(
    c for c in FEATURE_COLUMNS if c not in ("anomaly", "failed_logins_derived", "total_attempts_derived")
)
MODEL_FEATURES = (
    "packet_size",
    "connection_duration",
    "login_attempts",
    "request_rate",
    "bytes_transferred",
    "status_code",
    "connection_rate",
    "failed_login_ratio",
    "port_scan_score",
    "traffic_spike_score",
    "session_duration",
    "packet_entropy",
    "unique_ports_accessed",
)
DETECTION_MEASURES = (
    "packet_size",
    "connection_duration",
    "login_attempts",
    "request_rate",
    "bytes_transferred",
    "status_code",
)
STAT_COLUMNS = ("unique_ports_accessed", "avg_request_rate", "std_request_rate", "session_duration")


def ip_stats(df: DataFrame, approximate_ports: bool = False) -> DataFrame:
    """Per source: flows, distinct ports, mean and population deviation of the rate, longest duration.

    The exact distinct count aggregates by (source, port) first, so a source with a third of all
    rows is spread over its ports and folded before the second shuffle.
    """
    ports = F.approx_count_distinct("port") if approximate_ports else F.count_distinct("port")
    zero = F.lit(0.0)
    return df.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"),
        ports.alias("unique_ports_accessed"),
        F.coalesce(F.avg("request_rate"), zero).alias("avg_request_rate"),
        F.coalesce(F.stddev_pop("request_rate"), zero).alias("std_request_rate"),
        F.coalesce(F.max("connection_duration"), zero).alias("session_duration"),
    )


def with_ip_stats(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Rows LEFT-joined to the statistics of their source."""
    rows = df.drop("session_duration", "unique_ports_accessed")
    return join_per_key(rows, ip_stats(df) if stats is None else stats, "src_ip", "flows")


def _shared_features(failed_ratio: Column) -> dict[str, Column]:
    return {
        "connection_rate": S.connection_rate(),
        "failed_login_ratio": failed_ratio,
        "port_scan_score": F.col("unique_ports_accessed"),
        "traffic_spike_score": S.traffic_spike_score("request_rate", "avg_request_rate", "std_request_rate"),
        "packet_entropy": S.packet_entropy(),
    }


def flow_features(df: DataFrame) -> DataFrame:
    """Batch features of healed flows; statistics cover the whole table."""
    failed, attempts = S.failed_logins_derived(), S.total_attempts_derived()
    derived = {"failed_logins_derived": failed, "total_attempts_derived": attempts}
    return with_ip_stats(df).withColumns({**_shared_features(S.failed_login_ratio(failed, attempts)), **derived})


def stream_features(df: DataFrame) -> DataFrame:
    """Stream features of one micro-batch of clean flows; statistics cover that micro-batch."""
    return with_ip_stats(df).withColumns(_shared_features(S.stream_failed_login_ratio()))


def select_features(df: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """The allowed columns that exist, in order."""
    return df.select(*[c for c in columns if c in df.columns])


def unique_ports(df: DataFrame, name: str = "unique_ports_accessed") -> DataFrame:
    """Every row with the number of distinct ports of its source; rows without a source get none."""
    counts = df.where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("_flows"), F.count_distinct("port").alias(name)
    )
    return join_per_key(df.drop(name), counts, "src_ip", "_flows")


def global_rate_stats(df: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the request rate; a deviation of 0 becomes 1."""
    deviation = F.stddev_pop("request_rate")
    return df.agg(
        F.avg("request_rate").alias("rate_mean"),
        F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias("rate_std"),
    )


def with_global_stats(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Every row with the table-wide mean and deviation, computed once as a scalar subquery.

    ``source`` holds the same rows before joins that the statistics do not need.
    """
    stats = global_rate_stats(df if source is None else source).select(F.struct("rate_mean", "rate_std").alias("g")).scalar()
    return df.withColumns({"rate_mean": stats["rate_mean"], "rate_std": stats["rate_std"]})


def detection_features(df: DataFrame) -> DataFrame:
    """Features the detectors use: measures coerced to numbers, the spike score signed and global."""
    present = set(df.columns)
    measures = {c: number_or_zero(c) if c in present else F.lit(0.0) for c in DETECTION_MEASURES}
    rows = df.withColumns(measures)
    attempts = F.greatest(F.col("login_attempts"), F.lit(1.0))
    failed = F.when(S.auth_failure(), 1).otherwise(0)
    scored = with_global_stats(unique_ports(rows), rows).withColumns(
        {
            "failed_logins": failed,
            "total_attempts": attempts,
            "failed_login_ratio": S.safe_ratio(failed, attempts),
            "connection_rate": S.safe_ratio("request_rate", F.greatest("connection_duration", F.lit(0.01))),
            "session_duration": F.col("connection_duration"),
            "port_scan_score": F.col("unique_ports_accessed"),
            "traffic_spike_score": S.standard_score("request_rate", F.col("rate_mean"), F.col("rate_std")),
        }
    )
    return scored.drop("rate_mean", "rate_std")


def model_inputs(df: DataFrame) -> DataFrame:
    """The 13 model features as doubles: absent columns and unusable values are 0."""
    present = set(df.columns)
    return df.withColumns({c: number_or_zero(c) if c in present else F.lit(0.0) for c in MODEL_FEATURES})
