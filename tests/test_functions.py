import math

import pytest
from pyspark.sql import functions as F

from flowsight.functions import parsing as P
from flowsight.functions import rules as R
from flowsight.functions import scores as S


def value(spark, column, **row):
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    ddl = ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], ddl).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("1,234", 1234), (" 7.9 ", 7), ("-2.5", -2), ("bad", 0), ("", 0), ("1e3", 1000)])
def test_safe_int(spark, text, want):
    assert value(spark, P.safe_int("t"), t=text) == want


def test_numbers_with_defaults(spark):
    assert value(spark, P.to_float("t", 1.5), t="x") == 1.5
    assert value(spark, P.to_int("t", 3), t="99999999999999999999999") == 3
    assert value(spark, P.number_or_zero("t"), t="NaN") == 0.0


def test_event_time_is_utc_without_zone(spark):
    want = 1704067205
    for text in ("2024-01-01 00:00:05", "2024-01-01T00:00:05", "2024-01-01T00:00:05Z", "2024-01-01T02:00:05+02:00", " 2024-01-01T00:00:05.25 "):
        assert value(spark, F.unix_seconds(P.event_time("t")), t=text) == want
    assert value(spark, P.event_time("t"), t="yesterday") is None
    assert value(spark, P.clock_label(F.lit(1704067205 + 3660)), t="x") == "01:01"


def test_batch_formulas(spark):
    failed = S.failed_logins_derived()
    assert value(spark, failed, failed_logins=3.0, status_code=200.0) == 3.0
    assert value(spark, failed, failed_logins=0.0, status_code=403.0) == 1.0
    assert value(spark, failed, failed_logins=-1.0, status_code=500.0) == 0.0
    attempts = S.total_attempts_derived()
    assert value(spark, attempts, total_attempts=4.0, login_attempts=9.0) == 4.0
    assert value(spark, attempts, total_attempts=0.0, login_attempts=9.0) == 10.0
    assert value(spark, S.connection_rate(), request_rate=10.0, connection_duration=4.0) == 2.0
    assert value(spark, S.connection_rate(), request_rate=10.0, connection_duration=-1.0) is None
    assert value(spark, S.traffic_spike_score("a", "b", "c"), a=2.0, b=12.0, c=4.0) == 2.0
    r = 100 / 1000
    assert value(spark, S.packet_entropy(), packet_size=100.0, bytes_transferred=999.0) == pytest.approx(-r * math.log2(r + 1e-9))
    assert value(spark, S.packet_entropy(), packet_size=-100.0, bytes_transferred=999.0) is None
    assert value(spark, S.stream_failed_login_ratio(), status_code=429.0, login_attempts=3.0) == 0.25
    assert value(spark, S.stream_failed_login_ratio(), status_code=429.0, login_attempts=-1.0) is None


def test_ratio_and_standard_score(spark):
    assert value(spark, S.safe_ratio("a", "b"), a=6.0, b=-2.0) == 6.0
    assert value(spark, S.safe_ratio("a", "b"), a=6.0, b=2.0) == 3.0
    assert value(spark, S.standard_score("a", F.lit(4.0), F.lit(0.0)), a=6.0) == 2.0


@pytest.mark.parametrize(
    ("scan", "ports", "logins", "ratio", "spike", "rate", "want"),
    [
        (12, 0, 0, 0, 0, 0, "port_scan"),
        (11, 9, 5, 0.49, 1.99, 249, "normal"),
        (0, 10, 0, 0, 0, 0, "port_scan"),
        (12, 12, 6, 0, 0, 0, "brute_force"),
        (12, 12, 0, 0.5, 0, 0, "brute_force"),
        (12, 12, 6, 1, 2.0, 0, "traffic_spike"),
        (0, 0, 0, 0, -9, 250, "traffic_spike"),
    ],
)
def test_rule_label(spark, scan, ports, logins, ratio, spike, rate, want):
    row = dict(
        port_scan_score=float(scan), unique_ports_accessed=float(ports), login_attempts=float(logins),
        failed_login_ratio=float(ratio), traffic_spike_score=float(spike), request_rate=float(rate),
    )
    assert value(spark, R.rule_label(), **row) == want


@pytest.mark.parametrize(
    ("score", "row", "ip"),
    [(0.85, "CRITICAL", "CRITICAL"), (0.8499, "HIGH", "HIGH"), (0.65, "HIGH", "HIGH"), (0.64, "MEDIUM", "MEDIUM"),
     (0.40, "MEDIUM", "MEDIUM"), (0.39, "MEDIUM", "LOW"), (0.35, "MEDIUM", "LOW"), (0.34, "LOW", "LOW"), (0.0, "LOW", "LOW")],
)
def test_risk_band(spark, score, row, ip):
    assert value(spark, R.risk_band("s"), s=score) == row
    assert value(spark, R.risk_band("s", R.MEDIUM_FROM_IP), s=score) == ip


@pytest.mark.parametrize(
    ("level", "spike", "ratio", "following", "want"),
    [
        ("CRITICAL", False, 0.0, "normal", "BLOCK_IP"),
        ("high", True, 1.0, "brute_force", "TERMINATE_SESSION"),
        ("MEDIUM", True, 1.0, "normal", "RATE_LIMIT"),
        ("MEDIUM", False, 0.25, "brute_force", "ALERT_SECURITY_TEAM"),
        ("MEDIUM", False, 0.24, "brute_force", "RATE_LIMIT"),
        ("MEDIUM", False, 0.24, "normal", "LOG_ALERT"),
        ("LOW", True, 1.0, "normal", "LOG_ALERT"),
        ("LOW", True, 1.0, "brute_force", "RATE_LIMIT"),
    ],
)
def test_recommend_action(spark, level, spike, ratio, following, want):
    action = R.recommend_action("level", F.col("spike"), F.col("ratio"), F.col("following"))
    assert value(spark, action, level=level, spike=spike, ratio=ratio, following=following) == want


def test_lookups_and_votes(spark):
    assert value(spark, R.severity("l"), l="critical") == "Critical"
    assert value(spark, R.severity("l"), l="??") == "Medium"
    assert value(spark, R.level_action("l"), l="medium") == "RATE_LIMIT"
    assert value(spark, R.level_stage("l"), l="x") == "Reconnaissance"
    assert [value(spark, R.is_anomaly("f"), f=f) for f in ("anomaly", "1", "true", "normal", "0")] == [True, True, True, False, False]
    assert value(spark, R.outlier_vote("a", "b", "c"), a=True, b=False, c=True) == "ANOMALY"
    assert value(spark, R.outlier_vote("a", "b", "c"), a=True, b=False, c=False) == "NORMAL"
    assert value(spark, R.outlier_vote("a", "b", min_votes=1), a=True, b=False) == "ANOMALY"
    assert value(spark, R.contains_any("t", ["SPARK", "x%"]), t="A Spark job") is True
    assert value(spark, R.contains_any("t", ["x%"]), t="xy") is False
