"""Detection to defence: feature table -> predictions -> intelligence -> actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..models.detect import detect_threats
from ..models.settings import PRESETS, Settings
from ..operators.intel import agent_decisions, alerts, attacks, defense_actions, threat_intelligence, timeline, with_time
from ..sources.files import read_table
from ..sources.scratch import Workspace
from ..sources.sinks import write_actions_csv, write_features, write_report

PREDICTION_SCHEMA = (
    "timestamp string, src_ip string, dst_ip string, port double, protocol string, threat_score double, "
    "threat_type string, anomaly_flag string, autoencoder_error double, risk_level string, request_rate double, "
    "connection_duration double, packet_size double, bytes_transferred double"
)


def run_detection(spark: SparkSession, features: str, predictions: str, settings: Settings = PRESETS["detection"]) -> str:
    """Write the prediction table of a stored feature table."""
    with Workspace(spark, "detection"):
        write_features(detect_threats(spark.read.parquet(features), settings), predictions)
    return predictions


def build_intelligence(spark: SparkSession, predictions: str) -> DataFrame:
    """Intelligence of the stored predictions; empty before the first detection run."""
    return threat_intelligence(read_table(spark, predictions, PREDICTION_SCHEMA))


def run_intelligence(spark: SparkSession, predictions: str, intelligence: str, decisions: str) -> str:
    """Write the intelligence of the stored predictions, and the agents' decisions behind it, each once."""
    write_features(build_intelligence(spark, predictions), intelligence)
    write_features(agent_decisions(read_table(spark, predictions, PREDICTION_SCHEMA)), decisions)
    return intelligence


def run_defense(spark: SparkSession, intelligence: str, folder: str) -> str:
    """Write the simulated actions of a stored intelligence table and return where."""
    return write_actions_csv(defense_actions(read_table(spark, intelligence).drop("processed_at")), folder)


def run_dashboard(spark: SparkSession, intelligence: str, folder: str) -> None:
    """Alerts, timeline and attacks of a stored intelligence table, each with the time of the report."""
    intel = read_table(spark, intelligence)
    for name, rows in (("alerts", with_time(alerts(intel))), ("timeline", with_time(timeline(intel), "time")), ("attacks", with_time(attacks(intel)))):
        write_report(rows, f"{folder.rstrip('/')}/{name}")
