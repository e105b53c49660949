"""The streaming job: arriving files to feature table, quarantine, reports and log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.sinks import append_log
from ..streaming.flows import Enrichment, StreamOptions, run_bounded, start_feature_stream, stream_flows


@dataclass(frozen=True)
class StreamOutputs:
    """Where the streaming job writes, all below one folder by default."""

    features: str
    quarantine: str
    reports: str
    log: str

    @classmethod
    def below(cls, folder: str) -> StreamOutputs:
        base = folder.rstrip("/")
        return cls(
            f"{base}/stream_features", f"{base}/stream_quarantine", f"{base}/reports/stream", f"{base}/logs/security_pipeline"
        )


def run_stream(
    spark: SparkSession, path: str, schema: T.StructType, out: StreamOutputs, options: StreamOptions,
    fmt: str = "json", max_files: int | None = None, enrichment: Enrichment | None = None,
) -> None:
    """Run the job on files below ``path`` until its limit; ``schema`` holds the corrupt-record column."""
    run_stream_of(stream_flows(spark, path, schema, fmt, max_files), out, options, enrichment)
    append_log(spark, out.log, "spark_streaming_job", f"stream completed for {path}")


def run_stream_of(stream: DataFrame, out: StreamOutputs, options: StreamOptions, enrichment: Enrichment | None = None) -> None:
    """The same of any stream of raw flows, such as decoded messages."""
    query = start_feature_stream(stream, out.features, out.reports, options, quarantine=out.quarantine, enrichment=enrichment)
    run_bounded(query, options)
