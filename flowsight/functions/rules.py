"""Labels, bands, stages and actions as ``CASE`` expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import as_column

# --- fixed values -----------------------------------------------------------
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
HIGH_RISK_LEVELS = ("HIGH", "CRITICAL")
CRITICAL_FROM, HIGH_FROM = 0.85, 0.65
MEDIUM_FROM_ROW, MEDIUM_FROM_IP = 0.35, 0.40
ATTACK_CHAIN = ("port_scan", "brute_force", "privilege_escalation", "data_exfiltration")
KILL_CHAIN = (
    "Reconnaissance",
    "Initial Access",
    "Privilege Escalation",
    "Lateral Movement",
    "Data Exfiltration",
)
STAGE_MAP = {
    "port_scan": "Reconnaissance",
    "brute_force": "Initial Access",
    "privilege_escalation": "Privilege Escalation",
    "data_exfiltration": "Data Exfiltration",
    "traffic_spike": "Lateral Movement",
}
LEVEL_ACTIONS = {"CRITICAL": "BLOCK_IP", "HIGH": "TERMINATE_SESSION", "MEDIUM": "RATE_LIMIT"}
FALLBACK_ACTION = "LOG_ALERT"
LEVEL_STAGES = {"CRITICAL": "Data Exfiltration", "HIGH": "Privilege Escalation", "MEDIUM": "Initial Access"}
FALLBACK_STAGE = "Reconnaissance"
ANOMALY_MARKS = ("ANOMALY", "1", "TRUE")
SEVERITIES = {"LOW": "Low", "MEDIUM": "Medium", "HIGH": "High", "CRITICAL": "Critical"}
FALLBACK_SEVERITY = "Medium"
# ----------------------------------------------------------------------------


def choose(value: Column, table: Mapping[str, str], otherwise: str) -> Column:
    """Constant lookup as one ``CASE value WHEN ...``."""
    result: Column | None = None
    for key, out in table.items():
        result = (F.when if result is None else result.when)(value == key, F.lit(out))
    return F.lit(otherwise) if result is None else result.otherwise(F.lit(otherwise))


def rule_label(
    scan_score: Column | str = "port_scan_score",
    ports: Column | str = "unique_ports_accessed",
    logins: Column | str = "login_attempts",
    failed_ratio: Column | str = "failed_login_ratio",
    spike: Column | str = "traffic_spike_score",
    rate: Column | str = "request_rate",
) -> Column:
    """Rule-based threat type; a spike outranks brute force, which outranks a scan."""
    scan_score, ports, logins, failed_ratio, spike, rate = map(
        as_column, (scan_score, ports, logins, failed_ratio, spike, rate)
    )
    return (
        F.when((spike >= 2.0) | (rate >= 250), "traffic_spike")
        .when((logins >= 6) | (failed_ratio >= 0.5), "brute_force")
        .when((scan_score >= 12) | (ports >= 10), "port_scan")
        .otherwise("normal")
    )


def risk_band(score: Column | str, medium: float = MEDIUM_FROM_ROW) -> Column:
    """Risk level of a score; ``medium`` is 0.35 for single flows and 0.40 for addresses."""
    score = as_column(score)
    return (
        F.when(score >= CRITICAL_FROM, "CRITICAL")
        .when(score >= HIGH_FROM, "HIGH")
        .when(score >= medium, "MEDIUM")
        .otherwise("LOW")
    )


def recommend_action(level: Column | str, traffic_spike: Column, anomaly_ratio: Column, predicted_next: Column) -> Column:
    level = F.upper(as_column(level))
    medium = level == "MEDIUM"
    return (
        F.when(level == "CRITICAL", "BLOCK_IP")
        .when(level == "HIGH", "TERMINATE_SESSION")
        .when(medium & traffic_spike, "RATE_LIMIT")
        .when(medium & (anomaly_ratio >= 0.25), "ALERT_SECURITY_TEAM")
        .when(predicted_next == "brute_force", "RATE_LIMIT")
        .otherwise("LOG_ALERT")
    )


def level_action(level: Column | str) -> Column:
    return choose(F.upper(as_column(level)), LEVEL_ACTIONS, FALLBACK_ACTION)


def level_stage(level: Column | str) -> Column:
    return choose(F.upper(as_column(level)), LEVEL_STAGES, FALLBACK_STAGE)


def severity(level: Column | str) -> Column:
    return choose(F.upper(as_column(level)), SEVERITIES, FALLBACK_SEVERITY)


def high_risk(level: Column | str = "risk_level") -> Column:
    return F.coalesce(F.upper(as_column(level)).isin(*HIGH_RISK_LEVELS), F.lit(False))


def is_anomaly(flag: Column | str = "anomaly_flag") -> Column:
    return F.coalesce(F.upper(as_column(flag).cast("string")).isin(*ANOMALY_MARKS), F.lit(False))


def outlier_vote(*flags: Column | str, min_votes: int = 2) -> Column:
    """ANOMALY when at least ``min_votes`` of the boolean flags are set."""
    votes = sum((F.coalesce(as_column(f).cast("int"), F.lit(0)) for f in flags), F.lit(0))
    return F.when(votes >= min_votes, "ANOMALY").otherwise("NORMAL")


def contains_any(text: Column | str, keywords: tuple[str, ...] | list[str]) -> Column:
    """Case-insensitive: does the text hold any of the keywords?"""
    lowered = F.lower(as_column(text))
    found = F.lit(False)
    for word in keywords:
        found = found | lowered.contains(word.lower())
    return found
