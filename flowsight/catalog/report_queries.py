"""Intelligence, response, reports, profiling, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.parsing import event_time
from ..operators import intel as it
from ..operators import logs as lg
from ..operators import profile as pf
from ..operators import ranks
from ..sources import logs as log_source
from ..sources import scratch, sinks
from . import fixtures as fx
from .flow_queries import rounded
from .registry import register


def intel(spark, sf_dir):
    return it.threat_intelligence(fx.predictions(spark, sf_dir))


# --- signals -----------------------------------------------------------------
@register(
    "network_signal",
    fx.with_fixtures(
        "SELECT src_ip, hi >= 0.3 AS traffic_spike, burst >= 0.2 AS connection_burst, round(network, 6) AS score FROM fx_signals"
    ),
)
def network_signal(spark, sf_dir):
    return rounded(it.network_signal(fx.predictions(spark, sf_dir)))


@register(
    "behavior_signal",
    fx.with_fixtures(
        "SELECT src_ip, n_bf > 0 AS suspicious_login_pattern, n_long > 0 AS session_duration_deviation, "
        "round(behavior, 6) AS behavior_score FROM fx_signals"
    ),
)
def behavior_signal(spark, sf_dir):
    return rounded(it.behavior_signal(fx.predictions(spark, sf_dir)))


@register(
    "anomaly_signal",
    fx.with_fixtures("SELECT src_ip, round(unknown, 6) AS unknown_threat_score, round(anom, 6) AS anomaly_ratio FROM fx_signals"),
)
def anomaly_signal(spark, sf_dir):
    return rounded(it.anomaly_signal(fx.predictions(spark, sf_dir)))


@register(
    "stage_signal",
    fx.with_fixtures(
        """SELECT src_ip, concat_ws(',', CASE WHEN ps = 1 THEN 'port_scan' END, CASE WHEN bf = 1 THEN 'brute_force' END,
    CASE WHEN pe = 1 THEN 'privilege_escalation' END) AS observed_chain, nxt AS predicted_next,
  CASE nxt WHEN 'brute_force' THEN 'Initial Access' WHEN 'privilege_escalation' THEN 'Privilege Escalation'
    WHEN 'data_exfiltration' THEN 'Data Exfiltration' ELSE 'Reconnaissance' END AS predicted_stage FROM fx_signals"""
    ),
)
def stage_signal(spark, sf_dir):
    signal = it.stage_signal(fx.predictions(spark, sf_dir))
    return signal.withColumn("observed_chain", F.concat_ws(",", "observed_chain"))


@register("threat_intelligence", fx.with_fixtures("SELECT * FROM fx_intel"))
def threat_intelligence(spark, sf_dir):
    return intel(spark, sf_dir)


@register(
    "agent_decisions",
    fx.with_fixtures(
        "SELECT s.src_ip, round(network, 6) AS network, round(behavior, 6) AS behavior, round(anom, 6) AS anomaly, "
        "nxt AS predicted_next, recommended_action FROM fx_signals s JOIN fx_intel i ON s.src_ip = i.src_ip"
    ),
)
def agent_decisions(spark, sf_dir):
    return rounded(
        it.agent_decisions(fx.predictions(spark, sf_dir)).select(
            "src_ip",
            F.col("network_agent.score").alias("network"),
            F.col("behavior_agent.behavior_score").alias("behavior"),
            F.col("anomaly_agent.anomaly_ratio").alias("anomaly"),
            "prediction_agent.predicted_next",
            "recommended_action",
        )
    )


@register("high_risk", fx.with_fixtures("SELECT * FROM fx_intel WHERE risk_level IN ('HIGH', 'CRITICAL')"))
def high_risk(spark, sf_dir):
    return intel(spark, sf_dir).where(R.high_risk())


@register("recommend_action", fx.with_fixtures("SELECT recommended_action, count(*) AS sources FROM fx_intel GROUP BY 1"))
def recommend_action(spark, sf_dir):
    return intel(spark, sf_dir).groupBy("recommended_action").agg(F.count(F.lit(1)).alias("sources"))


_ACTION = "CASE risk_level WHEN 'CRITICAL' THEN 'BLOCK_IP' WHEN 'HIGH' THEN 'TERMINATE_SESSION' WHEN 'MEDIUM' THEN 'RATE_LIMIT' ELSE 'LOG_ALERT' END"


@register(
    "defense_actions",
    fx.with_fixtures(
        "SELECT src_ip, risk_level, attack_stage, recommended_action, 'SIMULATED_EXECUTED' AS action_status, "
        "concat('{\"risk_score\": ', cast(risk_score AS varchar), '}') AS alert FROM fx_intel"
    ),
)
def defense_actions(spark, sf_dir):
    return it.defense_actions(intel(spark, sf_dir))


@register(
    "defense_actions_by_level",
    fx.with_fixtures(
        f"SELECT src_ip, risk_level, 'Unknown' AS attack_stage, {_ACTION} AS recommended_action, "
        "'SIMULATED_EXECUTED' AS action_status, '{\"risk_score\": 0.0}' AS alert FROM fx_intel"
    ),
)
def defense_actions_by_level(spark, sf_dir):
    return it.defense_actions(intel(spark, sf_dir).select("src_ip", "risk_level"))


_SEVERITY = "CASE risk_level WHEN 'LOW' THEN 'Low' WHEN 'HIGH' THEN 'High' WHEN 'CRITICAL' THEN 'Critical' ELSE 'Medium' END"


@register("severity", fx.with_fixtures(f"SELECT src_ip, {_SEVERITY} AS severity FROM fx_intel"))
def severity(spark, sf_dir):
    return intel(spark, sf_dir).select("src_ip", R.severity("risk_level").alias("severity"))


def _top(n: int, columns: str) -> str:
    return fx.with_fixtures(f"SELECT {columns} FROM (SELECT * FROM fx_intel ORDER BY risk_score DESC, src_ip LIMIT {n}) t")


@register(
    "alerts",
    _top(12, f"concat('alert_', src_ip) AS id, attack_stage AS attackType, src_ip AS sourceIp, {_SEVERITY} AS severity"),
)
def alerts(spark, sf_dir):
    return it.alerts(intel(spark, sf_dir))


@register("timeline", _top(10, "concat('timeline_', src_ip) AS id, concat(attack_stage, ' detected') AS event"))
def timeline(spark, sf_dir):
    return it.timeline(intel(spark, sf_dir))


@register(
    "attacks",
    _top(8, f"concat('attack_', src_ip) AS id, attack_stage AS attackType, src_ip AS sourceIp, {_SEVERITY} AS severity"),
)
def attacks(spark, sf_dir):
    return it.attacks(intel(spark, sf_dir))


@register(
    "risk_distribution",
    fx.with_fixtures(
        """SELECT v.risk_level, t.n AS total_predictions, round(t.high / greatest(t.n, 1e0), 4) AS threat_detection_rate,
  count(i.src_ip) AS records
FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(risk_level)
CROSS JOIN (SELECT count(*) AS n, cast(count(CASE WHEN risk_level IN ('HIGH', 'CRITICAL') THEN 1 END) AS double) AS high FROM fx_intel) t
LEFT JOIN fx_intel i ON i.risk_level = v.risk_level GROUP BY 1, 2, 3"""
    ),
)
def risk_distribution(spark, sf_dir):
    return it.risk_distribution(intel(spark, sf_dir))


@register(
    "risk_metrics",
    fx.with_fixtures(
        """SELECT a AS activeThreats, CASE WHEN least(100, 12 * a) >= 80 THEN 'Critical' WHEN least(100, 12 * a) >= 60 THEN 'High'
  WHEN least(100, 12 * a) >= 35 THEN 'Medium' ELSE 'Low' END AS riskLevel, 3 * a AS blockedIps,
  greatest(0, 100 - least(100, 12 * a)) AS networkHealth
FROM (SELECT count(CASE WHEN risk_level IN ('HIGH', 'CRITICAL') THEN 1 END) AS a FROM fx_intel) t"""
    ),
)
def risk_metrics(spark, sf_dir):
    return it.risk_metrics(intel(spark, sf_dir))


_TOTALS = """(SELECT coalesce(src_ip, 'UNKNOWN') AS src_ip, count(*) AS flows, sum(cast(request_rate AS double)) AS rate_sum,
  sum(cast(failed_logins AS double)) AS failed_sum,
  sum(CASE WHEN status_code IN (401, 403, 429, 500, 503) THEN 1e0 ELSE 0e0 END) AS risky FROM fx_typed GROUP BY 1)"""
_ALL_RISK = f"""(SELECT *, greatest(0.05e0, least(0.99e0, rate_sum / flows / 1500e0 + failed_sum / flows / 8e0 + risky / flows * 0.9e0)) AS score
  FROM {_TOTALS} t)"""
_RISK = f"(SELECT * FROM {_ALL_RISK} a ORDER BY flows DESC, src_ip LIMIT 30)"


def named(spark, sf_dir):
    """Cast vendor flows, under headers that the file reports look for."""
    return fx.vendor_flows(spark, sf_dir).drop("event_id")


@register(
    "ip_risk_table",
    fx.with_fixtures(
        f"""SELECT src_ip, flows, round(score, 4) AS risk_score, risk_level,
  CASE risk_level WHEN 'CRITICAL' THEN 'BLOCK_IP' WHEN 'HIGH' THEN 'TERMINATE_SESSION' WHEN 'MEDIUM' THEN 'RATE_LIMIT' ELSE 'LOG_ALERT' END AS recommended_action,
  CASE risk_level WHEN 'CRITICAL' THEN 'Data Exfiltration' WHEN 'HIGH' THEN 'Privilege Escalation' WHEN 'MEDIUM' THEN 'Initial Access' ELSE 'Reconnaissance' END AS attack_stage,
  CASE WHEN rate_sum / flows > 500 THEN 'elevated' ELSE 'normal' END AS traffic_profile,
  round(failed_sum / flows, 3) AS failed_login_ratio, round(risky / flows, 3) AS status_anomaly_ratio
FROM (SELECT *, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM {_RISK} r) q"""
    ),
)
def ip_risk_table(spark, sf_dir):
    return it.ip_risk_table(named(spark, sf_dir))


@register(
    "feature_scores",
    fx.with_fixtures(
        f"""SELECT feature, round(score / sum(score) OVER (), 3) AS importance FROM (
  SELECT f.feature, round(CASE f.feature
      WHEN 'request_rate' THEN greatest(0.05e0, least(0.35e0, rate / rows / 1200e0))
      WHEN 'failed_login_ratio' THEN greatest(0.04e0, least(0.3e0, failed / rows / 4e0))
      WHEN 'status_anomaly_ratio' THEN greatest(0.03e0, least(0.26e0, risky / rows))
      WHEN 'ip_distribution_score' THEN greatest(0.03e0, least(0.2e0, ips / rows))
      ELSE greatest(0.03e0, least(0.22e0, dense)) END, 3) AS score
  FROM (VALUES ('request_rate'), ('failed_login_ratio'), ('status_anomaly_ratio'), ('ip_distribution_score'), ('threat_density')) f(feature)
  CROSS JOIN (SELECT sum(rate_sum) AS rate, sum(failed_sum) AS failed, sum(risky) AS risky, cast(sum(flows) AS double) AS rows, count(*) AS ips FROM {_TOTALS} t) s
  CROSS JOIN (SELECT avg(CASE WHEN score >= 0.65 THEN 1e0 ELSE 0e0 END) AS dense FROM {_ALL_RISK} r) d) p"""
    ),
)
def feature_scores(spark, sf_dir):
    return it.feature_scores(named(spark, sf_dir))


_FILE_LEVELS = (
    "(SELECT CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END "
    f"AS risk_level FROM {_ALL_RISK} r)"
)


@register(
    "risk_distribution_files",
    fx.with_fixtures(
        f"""SELECT v.risk_level, t.n AS total_predictions, round(t.high / greatest(t.n, 1e0), 4) AS threat_detection_rate,
  (SELECT count(*) FROM {_FILE_LEVELS} i WHERE i.risk_level = v.risk_level) AS records
FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(risk_level)
CROSS JOIN (SELECT count(*) AS n, cast(count(CASE WHEN risk_level IN ('HIGH', 'CRITICAL') THEN 1 END) AS double) AS high FROM {_FILE_LEVELS} l) t"""
    ),
)
def risk_distribution_files(spark, sf_dir):
    """Over every source of the file, not over the ones shown."""
    return it.risk_distribution(it.source_risk(named(spark, sf_dir)))


# --- profiling ---------------------------------------------------------------
def _top_values_sql(source: str, column: str, n: int = 8) -> str:
    return (
        f"SELECT coalesce(cast({column} AS varchar), 'UNKNOWN') AS name, count(*) AS count FROM {source} "
        f"GROUP BY 1 ORDER BY count(*) DESC, name LIMIT {n}"
    )


@register("top_values", fx.with_fixtures(_top_values_sql("fx_raw", "src_ip")))
def top_values(spark, sf_dir):
    return pf.top_values(fx.raw_flows(spark, sf_dir), "src_ip")


@register("top_values_brand", _top_values_sql("part", "p_brand"))
def top_values_brand(spark, sf_dir):
    return pf.top_values(fx.table(spark, sf_dir, "part"), "p_brand")


def _histogram_sql(source: str, column: str) -> str:
    edges = ", ".join(f"quantile_cont({column}, {i}e0 / 5) AS e{i}" for i in range(6))
    number = " + ".join(f"CASE WHEN {column} > e{i} THEN 1 ELSE 0 END" for i in range(1, 5))
    pick = lambda shift: "CASE b " + " ".join(f"WHEN {i} THEN e{i + shift}" for i in range(5)) + " END"
    return f"""SELECT b AS bin, round({pick(0)}, 6) AS lower, round({pick(1)}, 6) AS upper, count(*) AS count
FROM (SELECT {number} AS b, e.* FROM {source} CROSS JOIN (SELECT {edges} FROM {source}) e WHERE {column} IS NOT NULL) t GROUP BY 1, 2, 3"""


@register("quantile_histogram", _histogram_sql("orders", "o_totalprice"))
def quantile_histogram(spark, sf_dir):
    return rounded(pf.quantile_histogram(fx.table(spark, sf_dir, "orders"), "o_totalprice"))


@register("quantile_histogram_lines", _histogram_sql("lineitem", "l_extendedprice"))
def quantile_histogram_lines(spark, sf_dir):
    return rounded(pf.quantile_histogram(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice"))


_KEY_EXTRA = "(SELECT count(*) FROM fx_raw) - (SELECT count(*) FROM (SELECT DISTINCT timestamp, src_ip FROM fx_raw) k)"
_ROW_EXTRA = "(SELECT count(*) FROM fx_raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_raw) k)"
_GAP_COLUMNS = list(fx.FLOWS)
_GAPS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _GAP_COLUMNS)


@register(
    "duplicate_stats", fx.with_fixtures(f"SELECT {_ROW_EXTRA} AS duplicate_rows, {_KEY_EXTRA} AS duplicate_key_rows")
)
def duplicate_stats(spark, sf_dir):
    return pf.duplicate_stats(fx.raw_flows(spark, sf_dir), ["timestamp", "src_ip", "no_such_column"])


@register(
    "missing_stats",
    fx.with_fixtures(
        f"SELECT cast(sum({_GAPS}) AS bigint) AS missing_values_count, count(CASE WHEN {_GAPS} > 0 THEN 1 END) AS missing_row_count FROM fx_raw"
    ),
)
def missing_stats(spark, sf_dir):
    return pf.missing_stats(fx.raw_flows(spark, sf_dir))


@register(
    "file_stats",
    fx.with_fixtures(
        f"SELECT count(*) AS rows_processed, {_ROW_EXTRA} AS duplicates_removed, cast(sum({_GAPS}) AS bigint) AS null_cells, "
        "false AS sampled FROM fx_raw"
    ),
)
def file_stats(spark, sf_dir):
    return pf.file_stats(fx.raw_flows(spark, sf_dir))


@register(
    "ingest_summary",
    fx.with_fixtures(
        f"""SELECT n AS message_count, cast(greatest(1, n // 10) AS double) AS throughput_rps, n AS rows_processed, gaps AS quarantined_rows,
  gaps AS missing_rows_corrected, CASE WHEN key_extra > 0 THEN key_extra ELSE row_extra END AS duplicates_removed, 'generic' AS profile, '' AS top_channels
FROM (SELECT count(*) AS n, count(CASE WHEN {_GAPS} > 0 THEN 1 END) AS gaps, {_KEY_EXTRA} AS key_extra, {_ROW_EXTRA} AS row_extra FROM fx_raw) t"""
    ),
)
def ingest_summary(spark, sf_dir):
    return pf.ingest_summary(fx.raw_flows(spark, sf_dir), ["timestamp", "src_ip"])


@register(
    "ingest_channels",
    """SELECT n AS message_count, cast(greatest(1, n // 10) AS double) AS throughput_rps, n AS rows_processed, cast(0 AS bigint) AS quarantined_rows,
  cast(0 AS bigint) AS missing_rows_corrected, n - names AS duplicates_removed, 'generic' AS profile, top.top_channels
FROM (SELECT count(*) AS n, count(DISTINCT p_name) AS names FROM part) t
CROSS JOIN (SELECT string_agg(p_brand || '=' || c, ';' ORDER BY c DESC, p_brand) AS top_channels
  FROM (SELECT p_brand, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, p_brand LIMIT 8) b) top""",
)
def ingest_channels(spark, sf_dir):
    """Parts as videos, brands as channels."""
    part = fx.table(spark, sf_dir, "part").selectExpr("p_name AS video_id", "p_brand AS channel_title", "p_size AS views")
    return pf.ingest_summary(part, ["video_id"])


@register(
    "top_k",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
)
def top_k(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return pf.top_k(orders, 30, "o_totalprice", "o_orderkey")


# --- positions and windows ---------------------------------------------------
@register(
    "row_ids",
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders",
)
def row_ids(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return ranks.row_ids(orders, ["o_orderdate", "o_orderkey"], unique=True).drop("o_orderdate")


@register(
    "latest_n_per_key",
    "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority "
    "ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o WHERE rn <= 12",
)
def latest_n_per_key(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return lg.latest_n_per_key(orders, "o_orderpriority", ("o_orderdate", "o_orderkey"), 12).drop("o_orderdate")


@register(
    "rolling_mean",
    "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events",
)
def rolling_mean(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    means = ranks.rolling_mean(events, "user_id", ("ts", "event_id"), "value", unique=True)
    return rounded(means.select("event_id", "user_id", "rolling_mean"))


# --- logs --------------------------------------------------------------------
_TS = "substr(cast(ts AS string), 1, 19)"
_EVENT_LINE = (
    "CASE WHEN event_id % 101 = 0 THEN concat('{\"timestamp\": ', cast(event_id AS string)) WHEN event_id % 103 = 0 THEN '  ' "
    f"WHEN event_id % 107 = 0 THEN concat('{{\"timestamp\": \"', {_TS}, '\"}}') "
    f"ELSE concat('{{\"timestamp\": \"', {_TS}, '\", \"event_type\": \"', event_type, '\", \"details\": {{\"k\":', cast(event_id AS string), '}}}}') END"
)
_BROKEN, _EMPTY, _BARE = "event_id % 101 = 0", "(event_id % 101 <> 0 AND event_id % 103 = 0)", "event_id % 107 = 0"
_READ_EVENTS = f"""(SELECT event_id, ({_BROKEN}) AS malformed, CASE WHEN NOT {_BROKEN} THEN {_TS} END AS timestamp,
  CASE WHEN NOT {_BROKEN} AND NOT {_BARE} THEN event_type END AS event_type,
  CASE WHEN NOT {_BROKEN} AND NOT {_BARE} THEN concat('{{"k":', cast(event_id AS string), '}}') END AS details
  FROM events WHERE NOT {_EMPTY})"""


def event_lines(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{_EVENT_LINE} AS value")


@register("read_event_log", f"SELECT timestamp, event_type, details, malformed FROM {_READ_EVENTS} r")
def read_event_log(spark, sf_dir):
    path = scratch.scratch_path(spark, "event-log")
    event_lines(spark, sf_dir).select("value").write.text(path)
    read = log_source.read_event_log(spark, path)
    return read.select("timestamp", "event_type", "details", "malformed")


@register(
    "event_stats",
    f"""SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS events,
  (SELECT count(*) FROM {_READ_EVENTS} a) AS total_events,
  (SELECT max_by(timestamp, event_id) FROM {_READ_EVENTS} b WHERE timestamp IS NOT NULL) AS last_event_at
FROM {_READ_EVENTS} r WHERE NOT malformed GROUP BY 1""",
)
def event_stats(spark, sf_dir):
    return lg.event_stats(log_source.parse_events(event_lines(spark, sf_dir)), order=("event_id",))


@register(
    "append_events",
    f"SELECT {_TS} AS timestamp, event_type, props AS details, false AS malformed FROM events",
)
def append_events(spark, sf_dir):
    path = scratch.scratch_path(spark, "events")
    events = fx.table(spark, sf_dir, "events").selectExpr(f"{_TS} AS timestamp", "event_type", "props AS details")
    sinks.append_events(events, path)
    read = log_source.read_event_log(spark, path)
    return read.select("timestamp", "event_type", "details", "malformed")


_COMPONENT = "CASE event_type WHEN 'click' THEN 'spark_job' WHEN 'view' THEN 'api' WHEN 'purchase' THEN 'threat_detection' ELSE event_type END"
_LOG_LINE = f"concat({_TS}, ' | ', {_COMPONENT}, ' | ', 'value | ', cast(event_id AS string))"


def pipeline_lines(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{_LOG_LINE} AS value")


@register(
    "read_pipeline_log",
    f"SELECT {_TS} AS logged_at, {_COMPONENT} AS component, concat('value | ', cast(event_id AS string)) AS message FROM events",
)
def read_pipeline_log(spark, sf_dir):
    path = scratch.scratch_path(spark, "pipeline-log")
    pipeline_lines(spark, sf_dir).select("value").write.text(path)
    return log_source.read_pipeline_log(spark, path).select("logged_at", "component", "message")


@register(
    "log_filter",
    "SELECT doc_id, text FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%password%'",
)
def log_filter(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lg.log_filter(documents, ("LICENSE", "password"), "text")


@register("tail_n", "SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 120")
def tail_n(spark, sf_dir):
    return lg.tail_n(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), 120, ("doc_id",))


@register(
    "component_log",
    f"""SELECT event_id, value FROM (SELECT event_id, {_LOG_LINE} AS value FROM events ORDER BY event_id DESC LIMIT 300) t
WHERE lower(value) LIKE '%spark%' OR lower(value) LIKE '%threat_detection%' ORDER BY event_id DESC LIMIT 120""",
)
def component_log(spark, sf_dir):
    return lg.component_log(pipeline_lines(spark, sf_dir), order=("event_id",))


@register(
    "union_logs",
    f"""(SELECT 'pipeline' AS log_source, event_id AS place, {_LOG_LINE} AS value FROM events ORDER BY event_id DESC LIMIT 40)
UNION ALL (SELECT 'documents', doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 40)
UNION ALL (SELECT 'chat', conv_id * 1000 + turn, text FROM conversations ORDER BY conv_id * 1000 + turn DESC LIMIT 40)""",
)
def union_logs(spark, sf_dir):
    sources = {
        "pipeline": pipeline_lines(spark, sf_dir).select(F.col("event_id").alias("place"), "value"),
        "documents": fx.table(spark, sf_dir, "documents").selectExpr("doc_id AS place", "text AS value"),
        "chat": fx.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS place", "text AS value"),
    }
    return lg.union_logs(sources, 40, ("place",))


@register(
    "traffic_series",
    """SELECT minute_start, strftime(make_timestamp(minute_start * 1000000), '%H:%M') AS time, requests,
  requests > 1.6 * avg(requests) OVER () AS "isAnomaly"
FROM (SELECT cast(epoch(date_trunc('minute', ts)) AS bigint) AS minute_start, count(*) AS requests FROM events
  GROUP BY 1 ORDER BY 1 DESC LIMIT 36) t""",
)
def traffic_series(spark, sf_dir):
    timed = fx.flows(spark, sf_dir).select(event_time("timestamp").alias("event_ts"))
    return lg.traffic_series(timed)
