"""The batch job: raw CSV to feature table, quarantine, quality report and audit row."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import cast_flows, heal, quality_report, split_corrupt
from ..operators.features import flow_features, select_features
from ..schema import CORRUPT, canonicalize
from ..sources.files import read_flow_layouts
from ..sources.scratch import Workspace
from ..sources.sinks import append_event, append_log, utc_now, write_audit, write_features, write_quarantine, write_report


@dataclass(frozen=True)
class BatchOutputs:
    """Where the batch job writes, all below one folder by default."""

    features: str
    quarantine: str
    audit: str
    report: str
    audit_report: str
    events: str
    log: str

    @classmethod
    def below(cls, folder: str) -> BatchOutputs:
        base = folder.rstrip("/")
        return cls(
            f"{base}/security_features",
            f"{base}/security_quarantine",
            f"{base}/security_audit",
            f"{base}/reports/latest_batch_report",
            f"{base}/reports/latest_batch_audit",
            f"{base}/reports/platform_events",
            f"{base}/logs/security_pipeline",
        )


def canonical_flows(raw: DataFrame) -> DataFrame:
    """Canonical, cast rows that keep the raw text of corrupt ones."""
    return cast_flows(canonicalize(raw, keep=(CORRUPT,)))


def canonical_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``canonical_flows`` of CSV files that may differ in their headers, each layout mapped by its own."""
    return reduce(DataFrame.unionByName, map(canonical_flows, read_flow_layouts(spark, path)))


def build_features(clean: DataFrame) -> DataFrame:
    """Feature table of clean canonical rows."""
    return select_features(flow_features(heal(clean)))


def run_batch(spark: SparkSession, dataset: str, out: BatchOutputs) -> DataFrame:
    """Run the job and return its one-row report.

    The text is parsed once, into a staged columnar copy that counts, quarantine and healing read.
    The healed rows are staged as well: statistics then read three columns of them instead of
    repeating the duplicate removal.
    """
    started, clock = utc_now(), time.monotonic()
    with Workspace(spark, "batch") as work:
        flows = work.stage(canonical_files(spark, dataset))
        clean, corrupt = split_corrupt(flows)
        write_quarantine(corrupt, out.quarantine)
        healed = work.stage(heal(clean))
        write_features(select_features(flow_features(healed)), out.features)
        counts = work.stage(quality_report(flows))  # counted before the time is taken
        report = counts.select(
            F.lit(started).alias("run_timestamp_utc"),
            F.lit(dataset).alias("source_file"),
            "rows_processed",
            "duplicates_removed",
            F.col("null_rows").alias("null_values_filled"),
            "corrupted_rows_quarantined",
            F.lit(round(time.monotonic() - clock, 2)).alias("processing_time"),
            F.lit("completed").alias("status"),
        )
        write_report(report, out.report)
    stored = spark.read.schema(report.schema).json(out.report)
    append_event(spark, out.events, "batch_report", stored.first().asDict())
    audit = write_audit(spark, out.audit, dataset, out.features, out.quarantine)
    write_report(audit, out.audit_report)
    append_event(spark, out.events, "batch_security_pipeline_completed", audit.first().asDict())
    append_log(spark, out.log, "spark_job", f"batch completed using dataset {dataset}")
    return stored
