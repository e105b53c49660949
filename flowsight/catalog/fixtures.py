"""Flow tables derived from the ``events`` table, once as DataFrames and once as SQL.

Projections that only shape the input are shared text; everything an operator does is written twice,
by the library on the Spark side and as plain SQL here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.detect import labeled_flows
from ..operators.clean import cast_flows, heal
from ..operators.features import flow_features
from ..plans.batch import canonical_flows
from ..schema import canonicalize
from ..sources.scratch import staged

# Persona of a user = user_id % 10: 0 scan, 1 brute force, 2 spike, 3 scan and brute, 4 long sessions.
FLOWS = {
    "event_id": "event_id",
    "timestamp": "substr(cast(ts AS string), 1, 19)",
    "src_ip": "CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('10.0.', "
    "cast(cast(floor(cast(user_id AS double) / 256) AS bigint) AS string), '.', cast(user_id % 256 AS string)) END",
    "dst_ip": "concat('203.0.113.', cast(event_id % 50 AS string))",
    "port": "CASE WHEN user_id % 10 = 0 OR (user_id % 10 = 3 AND event_id % 2 = 0) THEN 20 + event_id % 120 "
    "WHEN user_id % 10 = 1 THEN CASE event_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 3389 ELSE 443 END "
    "ELSE CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080 "
    "WHEN 'signup' THEN 3306 ELSE 22 END END",
    "protocol": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CASE event_type WHEN 'click' THEN 'HTTP' "
    "WHEN 'view' THEN 'HTTPS' WHEN 'purchase' THEN 'TCP' WHEN 'signup' THEN 'UDP' ELSE 'ICMP' END END",
    "packet_size": "64 + (event_id * 37) % 1450",
    "connection_duration": "CASE WHEN user_id % 10 = 4 THEN 601 + event_id % 100 ELSE 1 + event_id % 120 END",
    "login_attempts": "CASE WHEN user_id % 10 = 1 OR (user_id % 10 = 3 AND event_id % 2 = 1) THEN 6 + k % 15 ELSE k % 3 END",
    "request_rate": "CASE WHEN user_id % 10 = 2 THEN 300 + k * 9 WHEN user_id % 10 IN (0, 3) THEN 120 + k "
    "WHEN user_id % 10 = 1 THEN 70 + k ELSE 5 + k % 76 END",
    "bytes_transferred": "CASE WHEN user_id % 10 = 2 THEN 150000 + event_id % 4850000 ELSE 512 + (event_id * 53) % 199488 END",
    "status_code": "CASE WHEN user_id % 10 = 1 THEN CASE event_id % 3 WHEN 0 THEN 401 WHEN 1 THEN 403 ELSE 429 END "
    "WHEN event_type = 'error' THEN 503 ELSE 200 END",
    "anomaly": "CASE WHEN user_id % 10 = 0 THEN ' Port_Scan ' WHEN user_id % 10 = 1 THEN 'BRUTE_FORCE' "
    "WHEN user_id % 10 = 2 THEN 'traffic_spike' WHEN event_id % 7 = 0 THEN NULL ELSE 'normal' END",
}
K = "cast(regexp_extract(props, '([0-9]+)', 1) AS int)"
# Every fiftieth flow arrives twice.
RESENT = "event_id % 50 = 0"
# The same flows as text under a vendor's headers: header -> (canonical name, text).
TEXT = {
    " Event_Time ": ("timestamp", "timestamp"),
    "Source_IP": ("src_ip", "src_ip"),
    "ip_dst": ("dst_ip", "dst_ip"),
    "DST_PORT": ("port", "cast(port AS string)"),
    "proto": ("protocol", "protocol"),
    "pkt_size": ("packet_size", "CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE cast(packet_size AS string) END"),
    "duration": ("connection_duration", "cast(connection_duration AS string)"),
    "attempts": ("login_attempts", "cast(login_attempts AS string)"),
    "flow_rate": ("request_rate", "cast(request_rate AS string)"),
    "total_bytes": ("bytes_transferred", "cast(bytes_transferred AS string)"),
    "http_status": ("status_code", "cast(status_code AS string)"),
    "failed_attempts": ("failed_logins", "cast(login_attempts % 4 AS string)"),
    "auth_total": ("total_attempts", "cast(login_attempts % 5 AS string)"),
    "label": ("anomaly", "anomaly"),
}
# Deterministic stand-in for model output.
SCORE = (
    "cast(CASE threat_type WHEN 'traffic_spike' THEN 85 WHEN 'brute_force' THEN 70 WHEN 'port_scan' THEN 60 ELSE 30 END "
    "+ event_id % 15 AS double) / 100"
)
FLAG = (
    "CASE WHEN (threat_type = 'traffic_spike' AND event_id % 2 = 0) OR (threat_type <> 'normal' AND event_id % 5 = 0) "
    "OR event_id % 31 = 0 THEN 'ANOMALY' ELSE 'NORMAL' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_flows(events: DataFrame) -> DataFrame:
    """Flows of an events table or stream."""
    return events.selectExpr("*", f"{K} AS k").selectExpr(*[f"{e} AS {c}" for c, e in FLOWS.items()])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_flows(table(spark, sf_dir, "events"))


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resent(flows(spark, sf_dir))


def resent(once: DataFrame) -> DataFrame:
    """Flows, of a table or a stream, as they arrive."""
    arrivals = F.explode(F.when(F.expr(RESENT), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return once.withColumn("arrival", arrivals).drop("arrival")


def as_vendor_text(df: DataFrame) -> DataFrame:
    return df.select("event_id", *[F.expr(e).alias(h) for h, (_, e) in TEXT.items()])


def vendor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flows as text under vendor headers, some packet sizes unreadable."""
    return as_vendor_text(raw_flows(spark, sf_dir))


def vendor_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, cast, unfilled flows of the vendor file."""
    return cast_flows(canonicalize(vendor_text(spark, sf_dir), keep=("event_id",)))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_flows(raw_flows(spark, sf_dir))


def healed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cast_flows(canonicalize(raw_flows(spark, sf_dir), keep=("event_id",)))
    return heal(raw, order=("event_id",))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_features(healed(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as detection finds it: written by the batch job."""
    return staged(features(spark, sf_dir), "security-features")


def as_predictions(labeled: DataFrame) -> DataFrame:
    typed = labeled.withColumn("threat_type", F.col("threat_type_rule"))
    return typed.selectExpr(
        "event_id", "timestamp", "src_ip", "dst_ip", "port", "protocol", "request_rate", "connection_duration",
        "packet_size", "bytes_transferred", f"{SCORE} AS threat_score", "threat_type", f"{FLAG} AS anomaly_flag",
        "cast(event_id % 100 AS double) / 100 AS autoencoder_error",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels need only the flows themselves: detection derives its own statistics
    return as_predictions(labeled_flows(healed(spark, sf_dir)))


def _list(columns) -> str:
    return ", ".join(columns)


_NUM = lambda c: f"cast({c} AS double) AS {c}"
_KEYED = "timestamp, coalesce(src_ip, 'UNKNOWN_SRC'), dst_ip, coalesce(port, 0), coalesce(protocol, 'UNKNOWN')"
MEASURES = [
    "packet_size", "connection_duration", "login_attempts", "request_rate", "bytes_transferred", "status_code",
]
_ZERO = lambda c: f"coalesce({c}, cast(0 AS double)) AS {c}"

CTES: dict[str, str] = {
    "fx_flows": f"SELECT {_list(f'{e} AS {c}' for c, e in FLOWS.items())} FROM (SELECT *, {K} AS k FROM events) e",
    "fx_raw": f"SELECT * FROM fx_flows UNION ALL SELECT * FROM fx_flows WHERE {RESENT}",
    "fx_text": f"SELECT event_id, {_list(f'{e} AS {c}' for c, e in TEXT.values())} FROM fx_raw",
    "fx_typed": "SELECT event_id, timestamp, src_ip, dst_ip, protocol, anomaly, "
    + _list(f"TRY_CAST({c} AS double) AS {c}" for c in ["port", *MEASURES, "failed_logins", "total_attempts"])
    + " FROM fx_text",
    "fx_healed": f"""SELECT event_id, timestamp, coalesce(src_ip, 'UNKNOWN_SRC') AS src_ip, dst_ip, {_NUM('port')},
  coalesce(protocol, 'UNKNOWN') AS protocol, {_list(_NUM(c) for c in MEASURES)},
  coalesce(lower(trim(anomaly)), 'normal') AS anomaly
FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYED} ORDER BY event_id) AS rn FROM fx_raw) r WHERE rn = 1""",
    "fx_vendor": f"""SELECT event_id, timestamp, coalesce(src_ip, 'UNKNOWN_SRC') AS src_ip, dst_ip, {_ZERO('port')},
  coalesce(protocol, 'UNKNOWN') AS protocol, {_list(_ZERO(c) for c in [*MEASURES, 'failed_logins', 'total_attempts'])},
  coalesce(lower(trim(anomaly)), 'normal') AS anomaly
FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYED} ORDER BY event_id) AS rn FROM fx_typed) r WHERE rn = 1""",
    "fx_stats": """SELECT src_ip, count(*) AS flows, count(DISTINCT port) AS unique_ports_accessed,
  avg(request_rate) AS avg_rate, stddev_pop(request_rate) AS std_rate, max(connection_duration) AS session_duration
FROM fx_healed GROUP BY src_ip""",
    "fx_features": """SELECT h.*, s.unique_ports_accessed, s.session_duration,
  request_rate / (connection_duration + 1) AS connection_rate,
  CASE WHEN status_code IN (401, 403, 429) THEN 1e0 ELSE 0e0 END / (login_attempts + 1 + 1e-9) AS failed_login_ratio,
  CASE WHEN status_code IN (401, 403, 429) THEN 1e0 ELSE 0e0 END / (login_attempts + 1) AS stream_login_ratio,
  abs(request_rate - s.avg_rate) / (s.std_rate + 1) AS traffic_spike_score,
  -(packet_size / (bytes_transferred + 1)) * log2(packet_size / (bytes_transferred + 1) + 1e-9) AS packet_entropy
FROM fx_healed h LEFT JOIN fx_stats s ON h.src_ip = s.src_ip""",
    "fx_vendor_features": """SELECT v.*, s.ports AS unique_ports_accessed, s.longest AS session_duration,
  CASE WHEN failed_logins > 0 THEN failed_logins WHEN status_code IN (401, 403, 429) THEN 1e0 ELSE 0e0 END AS failed_logins_derived,
  CASE WHEN total_attempts > 0 THEN total_attempts ELSE login_attempts + 1 END AS total_attempts_derived,
  request_rate / (connection_duration + 1) AS connection_rate,
  abs(request_rate - s.avg_rate) / (s.std_rate + 1) AS traffic_spike_score,
  -(packet_size / (bytes_transferred + 1)) * log2(packet_size / (bytes_transferred + 1) + 1e-9) AS packet_entropy
FROM fx_vendor v LEFT JOIN (SELECT src_ip, count(DISTINCT port) AS ports, avg(request_rate) AS avg_rate,
  stddev_pop(request_rate) AS std_rate, max(connection_duration) AS longest FROM fx_vendor GROUP BY src_ip) s ON v.src_ip = s.src_ip""",
    "fx_detect": """SELECT f.*, CASE WHEN status_code IN (401, 403, 429) THEN 1 ELSE 0 END AS failed_logins,
  greatest(login_attempts, 1e0) AS total_attempts,
  CASE WHEN status_code IN (401, 403, 429) THEN 1e0 ELSE 0e0 END / greatest(login_attempts, 1e0) AS detect_ratio,
  request_rate / greatest(connection_duration, 0.01e0) AS detect_rate,
  (request_rate - g.m) / CASE WHEN g.sd = 0 THEN 1e0 ELSE g.sd END AS z
FROM fx_features f CROSS JOIN (SELECT avg(request_rate) AS m, stddev_pop(request_rate) AS sd FROM fx_healed) g""",
    "fx_labels": """SELECT *, CASE WHEN z >= 2.0 OR request_rate >= 250 THEN 'traffic_spike'
  WHEN login_attempts >= 6 OR detect_ratio >= 0.5 THEN 'brute_force'
  WHEN unique_ports_accessed >= 10 THEN 'port_scan' ELSE 'normal' END AS threat_type FROM fx_detect""",
    "fx_predictions": f"""SELECT event_id, timestamp, src_ip, dst_ip, port, protocol, request_rate, connection_duration,
  packet_size, bytes_transferred, {SCORE} AS threat_score, threat_type, {FLAG} AS anomaly_flag,
  cast(event_id % 100 AS double) / 100 AS autoencoder_error FROM fx_labels""",
    "fx_counts": """SELECT src_ip, count(*) AS n, sum(cast(round(threat_score * 100, 0) AS bigint)) / 100e0 / count(*) AS avg_score,
  avg(CASE WHEN threat_score >= 0.7 OR threat_type = 'traffic_spike' OR request_rate > 300 THEN 1e0 ELSE 0e0 END) AS hi,
  avg(CASE WHEN request_rate > 500 THEN 1e0 ELSE 0e0 END) AS burst,
  sum(CASE WHEN threat_type = 'brute_force' THEN 1 ELSE 0 END) AS n_bf,
  sum(CASE WHEN anomaly_flag = 'ANOMALY' THEN 1 ELSE 0 END) AS n_an,
  sum(CASE WHEN connection_duration > 600 THEN 1 ELSE 0 END) AS n_long,
  max(CASE WHEN threat_type = 'privilege_escalation' THEN 1 ELSE 0 END) AS pe,
  max(CASE WHEN threat_type = 'port_scan' THEN 1 ELSE 0 END) AS ps,
  max(CASE WHEN threat_type = 'brute_force' THEN 1 ELSE 0 END) AS bf,
  max(CASE WHEN threat_type = 'traffic_spike' THEN 1 ELSE 0 END) AS sp
FROM fx_predictions GROUP BY src_ip""",
    "fx_signals": """SELECT *, CASE WHEN pe = 1 THEN 'data_exfiltration' WHEN ps = 1 AND bf = 1 THEN 'privilege_escalation'
    WHEN ps = 1 THEN 'brute_force' WHEN sp = 1 THEN 'lateral_movement' ELSE 'normal' END AS nxt,
  least(1e0, (0.5e0 * n_bf + 0.3e0 * n_an + 0.2e0 * n_long) / cast(n AS double)) AS behavior,
  n_an / cast(n AS double) AS anom, least(1e0, 0.7e0 * hi + 0.3e0 * burst) AS network,
  least(1e0, 1.5e0 * (n_an / cast(n AS double))) AS unknown
FROM fx_counts""",
    "fx_final": """SELECT *, greatest(0e0, least(1e0, 0.5e0 * avg_score + 0.3e0 * least(1e0,
    0.3e0 * network + 0.3e0 * behavior + 0.2e0 * unknown
    + 0.2e0 * CASE WHEN nxt IN ('privilege_escalation', 'lateral_movement') THEN 1e0
                   WHEN nxt IN ('brute_force', 'traffic_spike') THEN 0.7e0 ELSE 0e0 END)
  + 0.1e0 * unknown + 0.1e0 * least(1e0, n / 20e0))) AS final
FROM fx_signals""",
    "fx_intel": """SELECT src_ip, round(final, 4) AS risk_score,
  CASE WHEN final >= 0.85 THEN 'CRITICAL' WHEN final >= 0.65 THEN 'HIGH' WHEN final >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN final >= 0.85 THEN 'BLOCK_IP' WHEN final >= 0.65 THEN 'TERMINATE_SESSION'
       WHEN final >= 0.4 AND hi >= 0.3 THEN 'RATE_LIMIT' WHEN final >= 0.4 AND anom >= 0.25 THEN 'ALERT_SECURITY_TEAM'
       WHEN nxt = 'brute_force' THEN 'RATE_LIMIT' ELSE 'LOG_ALERT' END AS recommended_action,
  CASE nxt WHEN 'brute_force' THEN 'Initial Access' WHEN 'privilege_escalation' THEN 'Privilege Escalation'
           WHEN 'data_exfiltration' THEN 'Data Exfiltration' ELSE 'Reconnaissance' END AS attack_stage
FROM fx_final""",
}


def with_fixtures(sql: str) -> str:
    """``sql`` preceded by the fixture views as common table expressions, up to the last one it needs."""
    needed: set[str] = set()
    pending = [n for n in CTES if n in sql]
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += [n for n in CTES if n != name and n in CTES[name]]
    views = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {views}\n{sql}"
