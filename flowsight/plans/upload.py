"""Dataset upload: check, normalise, register, and the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import rows_with_null, split_corrupt
from ..operators.intel import busiest, feature_scores, risk_distribution, risk_metrics, source_risk
from ..operators.profile import file_stats
from ..sources.files import dataset_format, read_dataset
from ..sources.scratch import staged
from ..sources.sinks import register_dataset, write_normalized


def run_upload(
    spark: SparkSession, path: str, normalized: str, registry: str, file_size: int = 0, multi_line: bool = False
) -> dict[str, DataFrame]:
    """Accept a dataset file and return its report tables, lazily.

    The text is parsed once, into a staged table that everything else reads; rows that do not parse are in the table
    ``corrupt_rows``. The staged tables live as long as the reports are wanted; ``drop_scratch`` removes them.
    """
    rows, corrupt = split_corrupt(staged(read_dataset(spark, path, multi_line=multi_line), "upload"))
    write_normalized(rows, normalized)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    register_dataset(rows, registry, name, path, normalized, dataset_format(path), file_size)
    return {**report_tables(rows), "corrupt_rows": corrupt}


def report_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Totals count every source; only the displayed table is limited."""
    risk = staged(source_risk(df), "source-risk")
    return {
        "file_stats": file_stats(df),
        "ip_risk": busiest(risk),
        "feature_scores": feature_scores(df),
        "risk_distribution": risk_distribution(risk),
        "risk_metrics": risk_metrics(risk),
        "incomplete_rows": rows_with_null(df),
    }
