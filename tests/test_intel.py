import json

import pytest

from flowsight.operators import intel

DDL = "src_ip string, threat_score double, threat_type string, anomaly_flag string, request_rate double, connection_duration double"


def by_ip(df):
    return {r["src_ip"]: r for r in df.collect()}


@pytest.fixture
def predictions(spark):
    rows = [
        ("scan", 0.6, "port_scan", "NORMAL", 100.0, 1.0),
        ("both", 0.6, "port_scan", "ANOMALY", 100.0, 1.0),
        ("both", 0.9, "BRUTE_FORCE", "1", 100.0, 700.0),
        ("spike", 0.95, "traffic_spike", "ANOMALY", 900.0, 1.0),
        ("escal", 0.2, "privilege_escalation", "NORMAL", 10.0, 1.0),
        ("quiet", 0.1, "normal", None, None, None),
        (None, 0.1, None, "NORMAL", 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, DDL)


def test_stages(predictions):
    got = {k: (r["predicted_next"], r["predicted_stage"], r["observed_chain"]) for k, r in by_ip(intel.stage_signal(predictions)).items()}
    assert got["scan"] == ("brute_force", "Initial Access", ["port_scan"])
    assert got["both"] == ("privilege_escalation", "Privilege Escalation", ["port_scan", "brute_force"])
    assert got["spike"] == ("lateral_movement", "Reconnaissance", [])
    assert got["escal"] == ("data_exfiltration", "Data Exfiltration", ["privilege_escalation"])
    assert got["quiet"] == got["UNKNOWN_IP"] == ("normal", "Reconnaissance", [])


def test_stage_map_is_a_parameter(predictions):
    mapped = by_ip(intel.threat_intelligence(predictions, {"lateral_movement": "Lateral Movement", "brute_force": "Elsewhere"}))
    assert mapped["spike"]["attack_stage"] == "Lateral Movement"
    assert mapped["scan"]["attack_stage"] == "Reconnaissance"


def test_scores_by_hand(predictions):
    got = by_ip(intel.threat_intelligence(predictions))
    network, behavior, unknown, forecast = 0.7 * 0.5, (0.5 + 0.3 * 2 + 0.2) / 2, 1.0, 1.0
    agents = 0.3 * network + 0.3 * behavior + 0.2 * unknown + 0.2 * forecast
    assert got["both"]["risk_score"] == pytest.approx(0.5 * 0.75 + 0.3 * agents + 0.1 + 0.1 * 2 / 20, abs=1e-4)
    assert all(0.0 <= r["risk_score"] <= 1.0 for r in got.values())
    nested = by_ip(intel.agent_decisions(predictions))["spike"]
    assert nested["network_agent"]["connection_burst"] is True and nested["network_agent"]["score"] == 1.0
    assert nested["anomaly_agent"]["anomaly_ratio"] == 1.0


def test_absent_columns_count_as_zero(spark):
    df = spark.createDataFrame([("a", 0.1, "normal")], "src_ip string, threat_score double, threat_type string")
    row = by_ip(intel.network_signal(df))["a"]
    assert (row["score"], row["traffic_spike"]) == (0.0, False)
    long = df.selectExpr("*", "700.0 AS session_duration", "1.0 AS connection_duration")
    assert by_ip(intel.behavior_signal(long))["a"]["session_duration_deviation"] is True


def test_result_does_not_depend_on_partitioning(spark):
    rows = [("a", 0.1 * (i % 10), "normal", "NORMAL", 1.0, 1.0) for i in range(100)]
    one, many = (intel.threat_intelligence(spark.createDataFrame(rows, DDL).repartition(n)).collect() for n in (1, 9))
    assert one == many


def test_actions(spark, predictions):
    actions = by_ip(intel.defense_actions(intel.threat_intelligence(predictions)))
    assert len(actions) == 6 and all(isinstance(json.loads(r["alert"])["risk_score"], float) for r in actions.values())
    bare = spark.createDataFrame([("a", "HIGH", ""), ("b", None, "X")], "src_ip string, risk_level string, recommended_action string")
    got = by_ip(intel.defense_actions(bare))
    assert (got["a"]["recommended_action"], got["b"]["recommended_action"]) == ("TERMINATE_SESSION", "X")
    assert (got["b"]["risk_level"], got["b"]["attack_stage"]) == ("LOW", "Unknown")
    nothing = intel.defense_actions(intel.threat_intelligence(predictions.limit(0))).collect()
    assert [tuple(r) for r in nothing] == [
        ("N/A", "LOW", "No Active Threat", "LOG_ALERT", "SIMULATED_EXECUTED", '{"risk_score": 0.0}')
    ]


def test_reports(spark):
    df = spark.createDataFrame([(f"ip{i}", 0.9, lv, "S") for i, lv in enumerate(["HIGH", "critical", "LOW", "odd", None])],
                               "src_ip string, risk_score double, risk_level string, attack_stage string")
    levels = {r["risk_level"]: r["records"] for r in intel.risk_distribution(df).collect()}
    assert levels == {"LOW": 3, "MEDIUM": 0, "HIGH": 1, "CRITICAL": 1}
    assert {r["threat_detection_rate"] for r in intel.risk_distribution(df).collect()} == {0.4}
    assert len(intel.risk_distribution(df.limit(0)).collect()) == 4
    assert tuple(intel.risk_metrics(df).first()) == (2, "Low", 6, 76)
    many = spark.range(9).selectExpr("'HIGH' AS risk_level")
    assert tuple(intel.risk_metrics(many).first()) == (9, "Critical", 27, 0)
    assert [r["id"] for r in intel.alerts(df, 2).collect()] == ["alert_ip0", "alert_ip1"]
    assert intel.timeline(df, 1).first()["event"] == "S detected"
    assert {r["severity"] for r in intel.attacks(df).collect()} == {"High", "Critical", "Low", "Medium"}


def test_risk_from_a_file(spark):
    rows = [("a", "1800", "0", "503")] * 3 + [("", "600", "8", "200"), (None, None, "bad", None)]
    df = spark.createDataFrame(rows, "source_ip string, flow_rate string, failed_attempts string, response_code string")
    got = by_ip(intel.ip_risk_table(df))
    assert (got["a"]["risk_score"], got["a"]["risk_level"], got["a"]["traffic_profile"]) == (0.99, "CRITICAL", "elevated")
    assert got["UNKNOWN"]["flows"] == 2 and got["UNKNOWN"]["risk_score"] == pytest.approx(300 / 1500 + 4 / 8)
    scores = intel.feature_scores(df).collect()
    assert sum(r["importance"] for r in scores) == pytest.approx(1.0, abs=0.003)
    assert [r["importance"] for r in scores] == sorted((r["importance"] for r in scores), reverse=True)
