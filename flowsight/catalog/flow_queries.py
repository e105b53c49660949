"""Sources, cleaning, features, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as S
from ..functions.parsing import safe_int, to_float, to_int
from ..operators import clean, features as ft
from ..plans.batch import build_features, canonical_files, canonical_flows
from ..schema import FLOW_COLUMNS, STREAM_ALIASES, STREAM_COLUMNS, canonicalize
from ..sources import files, messages, scratch, sinks
from ..streaming.flows import high_spike
from . import fixtures as fx
from .registry import register

_DOUBLES = [c for c in FLOW_COLUMNS if c not in ("timestamp", "src_ip", "dst_ip", "protocol", "anomaly")]


def rounded(df, places=6):
    """Every double rounded, for comparison by value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def snapped(df, column):
    """Six places by plain arithmetic: quotients such as 41/640 end in a 5 at the seventh place, where
    the engines' own rounding functions part ways."""
    return df.withColumn(column, F.floor(F.col(column) * 1e6 + 0.5) / 1e6)


def _round_sql(names, places=6):
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


register("fixture_flows", fx.with_fixtures("SELECT * FROM fx_raw"))(fx.raw_flows)


# --- projections -------------------------------------------------------------
@register("canonicalize_batch", fx.with_fixtures(f"SELECT event_id, {', '.join(FLOW_COLUMNS)} FROM fx_text"))
def canonicalize_batch(spark, sf_dir):
    return canonicalize(fx.vendor_text(spark, sf_dir), keep=("event_id",))


@register(
    "canonicalize_stream",
    # the stream map does not know the header ip_dst
    fx.with_fixtures(
        "SELECT event_id, "
        + ", ".join("cast(NULL AS varchar) AS dst_ip" if c == "dst_ip" else c for c in STREAM_COLUMNS)
        + " FROM fx_text"
    ),
)
def canonicalize_stream(spark, sf_dir):
    return canonicalize(fx.vendor_text(spark, sf_dir), STREAM_ALIASES, keep=("event_id",))


_MESSAGE_INPUT = {
    "event_time": "timestamp",
    "src_ip": "CASE WHEN event_id % 3 = 0 THEN '  ' ELSE src_ip END",
    "source_ip": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('s', dst_ip) END",
    "destination_ip": "dst_ip",
    "dst_port": "concat(cast(port AS string), '.7')",
    "proto": "protocol",
    "bytes": "cast(packet_size AS string)",
    "duration": "cast(connection_duration AS string)",
    "attempts": "CASE WHEN event_id % 4 = 0 THEN '' ELSE cast(login_attempts AS string) END",
    "rate": "cast(request_rate AS string)",
    "total_bytes": "cast(bytes_transferred AS string)",
    "response_code": "cast(status_code AS string)",
}
_MESSAGE_SQL = f"""SELECT timestamp, coalesce(CASE WHEN trim(a) <> '' THEN a END, b, 'UNKNOWN_SRC') AS src_ip, dst_ip,
  cast(port AS bigint) AS port, coalesce(protocol, 'UNKNOWN') AS protocol, cast(packet_size AS double) AS packet_size,
  cast(connection_duration AS double) AS connection_duration,
  cast(CASE WHEN event_id % 4 = 0 THEN 0 ELSE login_attempts END AS double) AS login_attempts,
  cast(request_rate AS double) AS request_rate, cast(bytes_transferred AS double) AS bytes_transferred,
  cast(status_code AS bigint) AS status_code
FROM (SELECT *, {_MESSAGE_INPUT['src_ip']} AS a, {_MESSAGE_INPUT['source_ip']} AS b FROM fx_raw) m"""


@register("canonicalize_message", fx.with_fixtures(_MESSAGE_SQL))
def canonicalize_message(spark, sf_dir):
    given = fx.raw_flows(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in _MESSAGE_INPUT.items()])
    return messages.canonicalize_message(given)


_WIRE_SQL = """SELECT timestamp, src_ip, dst_ip, cast(port AS bigint) AS port, protocol, packet_size, connection_duration,
  login_attempts, request_rate, bytes_transferred, cast(status_code AS bigint) AS status_code FROM fx_healed"""


@register("canonicalize_message_canonical", fx.with_fixtures(_WIRE_SQL))
def canonicalize_message_canonical(spark, sf_dir):
    return messages.canonicalize_message(fx.healed(spark, sf_dir))


@register("to_messages", fx.with_fixtures("SELECT 'security-logs' AS topic, " + _WIRE_SQL.removeprefix("SELECT ")))
def to_messages(spark, sf_dir):
    sent = messages.to_messages(fx.healed(spark, sf_dir))
    return sent.select("topic", F.from_json("value", (
        "timestamp string, src_ip string, dst_ip string, port bigint, protocol string, packet_size double, "
        "connection_duration double, login_attempts double, request_rate double, bytes_transferred double, status_code bigint"
    )).alias("m")).select("topic", "m.*")


@register("read_flow_messages", fx.with_fixtures(f"SELECT *, cast(NULL AS varchar) AS _corrupt_record FROM ({_WIRE_SQL}) w"))
def read_flow_messages(spark, sf_dir):
    sent = messages.to_messages(fx.healed(spark, sf_dir))
    return messages.read_flow_messages(sent.select(F.col("value").cast("binary").alias("value")))


@register("cast_flows", fx.with_fixtures(f"SELECT event_id, {', '.join(FLOW_COLUMNS)} FROM fx_typed"))
def cast_flows(spark, sf_dir):
    return fx.vendor_flows(spark, sf_dir)


@register(
    "fill_defaults",
    fx.with_fixtures(
        "SELECT event_id, timestamp, coalesce(src_ip, 'UNKNOWN_SRC') AS src_ip, dst_ip, coalesce(protocol, 'UNKNOWN') AS protocol, "
        + ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in _DOUBLES)
        + ", anomaly FROM fx_typed"
    ),
)
def fill_defaults(spark, sf_dir):
    return clean.fill_defaults(fx.vendor_flows(spark, sf_dir))


@register(
    "normalize_label",
    fx.with_fixtures("SELECT event_id, coalesce(lower(trim(anomaly)), 'normal') AS anomaly FROM fx_raw"),
)
def normalize_label(spark, sf_dir):
    return clean.normalize_label(fx.raw_flows(spark, sf_dir).select("event_id", "anomaly"))


_VENDOR_FEATURES = f"""SELECT timestamp, src_ip, dst_ip, port, protocol, packet_size, connection_duration, login_attempts,
  request_rate, bytes_transferred, status_code, anomaly, round(connection_rate, 6) AS connection_rate,
  round(failed_logins_derived / (total_attempts_derived + 1e-9), 6) AS failed_login_ratio,
  unique_ports_accessed AS port_scan_score, round(traffic_spike_score, 6) AS traffic_spike_score, session_duration,
  round(packet_entropy, 6) AS packet_entropy, unique_ports_accessed, failed_logins_derived, total_attempts_derived
FROM fx_vendor_features"""


@register("select_features", fx.with_fixtures(_VENDOR_FEATURES))
def select_features(spark, sf_dir):
    """The whole batch chain on a vendor file: canonicalise, cast, heal, features, output columns."""
    return rounded(build_features(canonicalize_cast(spark, sf_dir)))


def canonicalize_cast(spark, sf_dir):
    return clean.cast_flows(canonicalize(fx.vendor_text(spark, sf_dir)))


# --- filters -----------------------------------------------------------------
@register(
    "rows_with_null",
    fx.with_fixtures(
        "SELECT * FROM fx_raw WHERE src_ip IS NULL OR protocol IS NULL OR anomaly IS NULL OR timestamp IS NULL OR dst_ip IS NULL"
    ),
)
def rows_with_null(spark, sf_dir):
    return clean.rows_with_null(fx.raw_flows(spark, sf_dir))


@register(
    "high_spike",
    fx.with_fixtures(
        "SELECT event_id, src_ip, round(traffic_spike_score, 6) AS traffic_spike_score FROM fx_features WHERE traffic_spike_score > 2"
    ),
)
def spikes(spark, sf_dir):
    return rounded(high_spike(fx.features(spark, sf_dir)).select("event_id", "src_ip", "traffic_spike_score"))


@register("auth_failure", fx.with_fixtures("SELECT * FROM fx_raw WHERE status_code IN (401, 403, 429)"))
def auth_failure(spark, sf_dir):
    return fx.raw_flows(spark, sf_dir).where(S.auth_failure())


@register("risky_status", fx.with_fixtures("SELECT * FROM fx_raw WHERE status_code IN (401, 403, 429, 500, 503)"))
def risky_status(spark, sf_dir):
    return fx.raw_flows(spark, sf_dir).where(S.risky_status())


# --- duplicates and quality --------------------------------------------------
@register("dedupe_flows", fx.with_fixtures("SELECT * FROM fx_healed"))
def dedupe_flows(spark, sf_dir):
    return fx.healed(spark, sf_dir).drop("failed_logins", "total_attempts")


@register("distinct_rows", fx.with_fixtures("SELECT DISTINCT * FROM fx_raw"))
def distinct_rows(spark, sf_dir):
    return clean.distinct_rows(fx.raw_flows(spark, sf_dir))


_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in FLOW_COLUMNS)


@register(
    "quality_report",
    fx.with_fixtures(
        f"""SELECT h.n AS rows_processed, t.n - h.n AS duplicates_removed, t.gaps AS null_rows, cast(0 AS bigint) AS corrupted_rows_quarantined
FROM (SELECT count(*) AS n FROM fx_vendor) h,
  (SELECT count(*) AS n, count(CASE WHEN {_ANY_NULL} THEN 1 END) AS gaps FROM fx_typed) t"""
    ),
)
def quality_report(spark, sf_dir):
    return clean.quality_report(canonicalize_cast(spark, sf_dir))


# --- statistics and features -------------------------------------------------
@register(
    "ip_stats",
    fx.with_fixtures(
        "SELECT src_ip, flows, unique_ports_accessed, round(avg_rate, 6) AS avg_request_rate, round(std_rate, 6) AS std_request_rate, "
        "session_duration FROM fx_stats"
    ),
)
def ip_stats(spark, sf_dir):
    return rounded(ft.ip_stats(fx.healed(spark, sf_dir)))


@register(
    "with_ip_stats",
    fx.with_fixtures(
        "SELECT h.event_id, h.src_ip, s.unique_ports_accessed, round(s.avg_rate, 6) AS avg_request_rate, "
        "round(s.std_rate, 6) AS std_request_rate, s.session_duration FROM fx_healed h LEFT JOIN fx_stats s ON h.src_ip = s.src_ip"
    ),
)
def with_ip_stats(spark, sf_dir):
    joined = ft.with_ip_stats(fx.healed(spark, sf_dir))
    return rounded(joined.select("event_id", "src_ip", *ft.STAT_COLUMNS))


@register(
    "flow_features",
    fx.with_fixtures(
        "SELECT event_id, src_ip, unique_ports_accessed, unique_ports_accessed AS port_scan_score, session_duration, "
        + _round_sql(["connection_rate", "failed_login_ratio", "traffic_spike_score", "packet_entropy"])
        + " FROM fx_features"
    ),
)
def flow_features(spark, sf_dir):
    columns = (
        "event_id", "src_ip", "unique_ports_accessed", "port_scan_score", "session_duration", "connection_rate",
        "failed_login_ratio", "traffic_spike_score", "packet_entropy",
    )
    return rounded(fx.features(spark, sf_dir).select(*columns))


@register(
    "top_spiking_sources",
    fx.with_fixtures(
        "SELECT src_ip, count(*) AS flows, round(avg(traffic_spike_score), 6) AS mean_spike_score FROM fx_features "
        "GROUP BY src_ip ORDER BY round(avg(traffic_spike_score), 6) DESC, src_ip LIMIT 30"
    ),
)
def top_spiking_sources(spark, sf_dir):
    """Flagship: the 30 sources with the highest mean spike score."""
    per_source = fx.features(spark, sf_dir).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.round(F.avg("traffic_spike_score"), 6).alias("mean_spike_score")
    )
    return per_source.orderBy(F.desc("mean_spike_score"), "src_ip").limit(30)


@register(
    "unique_ports",
    fx.with_fixtures(
        "SELECT r.event_id, r.src_ip, cast(s.n AS double) AS unique_ports_accessed FROM fx_raw r LEFT JOIN "
        "(SELECT src_ip, count(DISTINCT port) AS n FROM fx_raw GROUP BY src_ip) s ON r.src_ip = s.src_ip"
    ),
)
def unique_ports(spark, sf_dir):
    rows = fx.raw_flows(spark, sf_dir).select("event_id", "src_ip", "port")
    # double: rows without a source have no count
    return ft.unique_ports(rows).select("event_id", "src_ip", F.col("unique_ports_accessed").cast("double").alias("unique_ports_accessed"))


_GLOBAL = "(SELECT avg(request_rate) AS m, CASE WHEN stddev_pop(request_rate) = 0 THEN 1e0 ELSE stddev_pop(request_rate) END AS sd FROM fx_healed)"


@register(
    "global_rate_stats",
    fx.with_fixtures(f"SELECT round(m, 6) AS rate_mean, round(sd, 6) AS rate_std FROM {_GLOBAL} g"),
)
def global_rate_stats(spark, sf_dir):
    return rounded(ft.global_rate_stats(fx.healed(spark, sf_dir)))


@register(
    "with_global_stats",
    fx.with_fixtures(
        f"SELECT event_id, request_rate, round(m, 6) AS rate_mean, round(sd, 6) AS rate_std FROM fx_healed CROSS JOIN {_GLOBAL} g"
    ),
)
def with_global_stats(spark, sf_dir):
    joined = ft.with_global_stats(fx.healed(spark, sf_dir))
    return rounded(joined.select("event_id", "request_rate", "rate_mean", "rate_std"))


@register(
    "detection_features",
    fx.with_fixtures(
        "SELECT event_id, failed_logins, total_attempts, round(detect_ratio, 6) AS failed_login_ratio, "
        "floor(detect_rate * 1e6 + 0.5e0) / 1e6 AS connection_rate, connection_duration AS session_duration, unique_ports_accessed, "
        "unique_ports_accessed AS port_scan_score, round(z, 6) AS traffic_spike_score FROM fx_detect"
    ),
)
def detection_features(spark, sf_dir):
    columns = (
        "event_id", "failed_logins", "total_attempts", "failed_login_ratio", "connection_rate", "session_duration",
        "unique_ports_accessed", "port_scan_score", "traffic_spike_score",
    )
    return rounded(snapped(ft.detection_features(fx.healed(spark, sf_dir)), "connection_rate").select(*columns))


@register(
    "assemble",
    fx.with_fixtures(
        "SELECT event_id, packet_size, connection_duration, login_attempts, request_rate, bytes_transferred, status_code, "
        "floor(detect_rate * 1e6 + 0.5e0) / 1e6 AS connection_rate, round(detect_ratio, 6) AS failed_login_ratio, "
        "cast(unique_ports_accessed AS double) AS port_scan_score, round(z, 6) AS traffic_spike_score, "
        "connection_duration AS session_duration, round(packet_entropy, 6) AS packet_entropy, "
        "cast(unique_ports_accessed AS double) AS unique_ports_accessed FROM fx_detect"
    ),
)
def assemble(spark, sf_dir):
    inputs = ft.model_inputs(ft.detection_features(fx.stored_features(spark, sf_dir)))
    return rounded(snapped(inputs, "connection_rate").select("event_id", *ft.MODEL_FEATURES))


# --- rules -------------------------------------------------------------------
@register("rule_label", fx.with_fixtures("SELECT event_id, threat_type FROM fx_labels"))
def rule_label(spark, sf_dir):
    detected = ft.detection_features(fx.healed(spark, sf_dir))
    return detected.select("event_id", R.rule_label().alias("threat_type"))


_BAND = "CASE WHEN {s} >= 0.85 THEN 'CRITICAL' WHEN {s} >= 0.65 THEN 'HIGH' WHEN {s} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"


@register(
    "risk_band",
    fx.with_fixtures(
        f"SELECT event_id, threat_score, {_BAND.format(s='threat_score', m='0.35')} AS row_level, "
        f"{_BAND.format(s='threat_score', m='0.40')} AS ip_level FROM fx_predictions"
    ),
)
def risk_band(spark, sf_dir):
    return fx.predictions(spark, sf_dir).select(
        "event_id",
        "threat_score",
        R.risk_band("threat_score").alias("row_level"),
        R.risk_band("threat_score", R.MEDIUM_FROM_IP).alias("ip_level"),
    )


_VOTES = "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"


@register(
    "outlier_vote",
    f"SELECT event_id, CASE WHEN {_VOTES} >= 2 THEN 'ANOMALY' ELSE 'NORMAL' END AS two_of_three, "
    f"CASE WHEN {_VOTES} >= 1 THEN 'ANOMALY' ELSE 'NORMAL' END AS any_of_three, "
    "CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'ANOMALY' ELSE 'NORMAL' END AS any_of_two FROM events",
)
def outlier_vote(spark, sf_dir):
    flags = [F.col("event_id") % n == 0 for n in (2, 3, 5)]
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        R.outlier_vote(*flags).alias("two_of_three"),
        R.outlier_vote(*flags, min_votes=1).alias("any_of_three"),
        R.outlier_vote(*flags[:2], min_votes=1).alias("any_of_two"),
    )


@register(
    "safe_ratio",
    "SELECT o_orderkey, round(o_totalprice / CASE WHEN o_custkey % 7 - 1 <= 0 THEN 1 ELSE o_custkey % 7 - 1 END, 6) AS ratio FROM orders",
)
def safe_ratio(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", F.round(S.safe_ratio("o_totalprice", (F.col("o_custkey") % 7 - 1).cast("double")), 6).alias("ratio")
    )


_RAW_NUMBER = (
    "CASE o_orderkey % 5 WHEN 0 THEN concat(' ', cast(o_custkey AS string), ',250 ') WHEN 1 THEN cast(o_totalprice AS string) "
    "WHEN 2 THEN 'bad' WHEN 3 THEN '' ELSE NULL END"
)


@register(
    "safe_int",
    f"""SELECT o_orderkey, coalesce(cast(trunc(TRY_CAST(trim(replace(t, ',', '')) AS double)) AS bigint), 0) AS safe,
  coalesce(TRY_CAST(t AS double), 0e0) AS as_float, coalesce(cast(trunc(TRY_CAST(t AS double)) AS bigint), 7) AS as_int
FROM (SELECT o_orderkey, {_RAW_NUMBER} AS t FROM orders) o""",
)
def safe_ints(spark, sf_dir):
    given = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_RAW_NUMBER} AS t")
    return given.select(
        "o_orderkey", safe_int("t").alias("safe"), to_float("t").alias("as_float"), to_int("t", 7).alias("as_int")
    )


# --- sources and sinks, as round trips ---------------------------------------
_TEXT_COLUMNS = ", ".join(FLOW_COLUMNS)


@register("read_flows_csv", fx.with_fixtures(f"SELECT {_TEXT_COLUMNS} FROM fx_text"))
def read_flows_csv(spark, sf_dir):
    path = scratch.scratch_path(spark, "flows-csv")
    sinks.write_csv(fx.vendor_text(spark, sf_dir).drop("event_id"), path)
    rows, _ = clean.split_corrupt(files.read_flows_csv(spark, path))
    return canonicalize(rows)


_OTHER_HEADERS = {"src_ip": "Source_IP", "dst_ip": "Destination_IP", "port": " Destination_Port"}


@register(
    "read_flow_layouts",
    fx.with_fixtures(
        "SELECT timestamp, src_ip, dst_ip, protocol, cast(port AS double) AS port, event_id % 3 = 0 AS other FROM fx_raw"
    ),
)
def read_flow_layouts(spark, sf_dir):
    """Two exports in one folder, their columns differing in name, order and number; flows of the second have no request rate."""
    path = scratch.scratch_path(spark, "flow-layouts")
    kept = ["timestamp", "src_ip", "dst_ip", "protocol", "port", "request_rate"]
    flows = fx.raw_flows(spark, sf_dir).withColumn("request_rate", F.lit(1.0))
    sinks.write_csv(flows.where("event_id % 3 <> 0").select(*kept), f"{path}/first")
    second = flows.where("event_id % 3 = 0").select(*reversed(kept[:-1]))
    sinks.write_csv(second.withColumnsRenamed(_OTHER_HEADERS), f"{path}/second")
    rows = canonical_files(spark, [f"{path}/first", f"{path}/second"])
    return rows.where("_corrupt_record IS NULL").select(*kept[:-1], F.col("request_rate").isNull().alias("other"))


_LINE = (
    "CASE WHEN event_id % 59 = 0 THEN concat(timestamp, ',', dst_ip) "
    "WHEN event_id % 61 = 0 THEN concat(timestamp, ',', dst_ip, ',', cast(port AS string), ',x,y') "
    "ELSE concat(timestamp, ',', dst_ip, ',', cast(port AS string)) END"
)


def _broken_csv(spark, sf_dir):
    """The parse of a file in which some lines are short and some long."""
    path = scratch.scratch_path(spark, "broken-csv")
    lines = fx.raw_flows(spark, sf_dir).select(F.expr(_LINE).alias("timestamp,dst_ip,port"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return scratch.staged(files.read_flows_csv(spark, path), "parsed-csv")


@register(
    "quality_report_corrupt",
    fx.with_fixtures(
        """SELECT h.n AS rows_processed, t.n - h.n AS duplicates_removed, t.n AS null_rows, t.bad AS corrupted_rows_quarantined
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT timestamp, dst_ip, port FROM fx_raw WHERE event_id % 59 <> 0 AND event_id % 61 <> 0) d) h,
  (SELECT count(CASE WHEN event_id % 59 <> 0 AND event_id % 61 <> 0 THEN 1 END) AS n,
    count(CASE WHEN event_id % 59 = 0 OR event_id % 61 = 0 THEN 1 END) AS bad FROM fx_raw) t"""
    ),
)
def quality_report_corrupt(spark, sf_dir):
    """Every good row lacks the columns that the file doesn't have, so each has a null."""
    return clean.quality_report(canonical_flows(_broken_csv(spark, sf_dir)))


@register(
    "split_corrupt",
    fx.with_fixtures(
        f"SELECT {_LINE} AS line, CASE WHEN event_id % 59 = 0 OR event_id % 61 = 0 THEN 1 ELSE 0 END AS corrupt FROM fx_raw"
    ),
)
def split_corrupt(spark, sf_dir):
    good, bad = clean.split_corrupt(_broken_csv(spark, sf_dir))
    return good.select(F.concat_ws(",", "timestamp", "dst_ip", "port").alias("line"), F.lit(0).alias("corrupt")).unionAll(
        bad.select("_corrupt_record", F.lit(1))
    )


@register("write_features", fx.with_fixtures(_VENDOR_FEATURES))
def write_features(spark, sf_dir):
    path = scratch.scratch_path(spark, "security-features")
    sinks.write_features(build_features(canonicalize_cast(spark, sf_dir)), path)
    return rounded(files.read_table(spark, path).drop("processed_at"))


@register("preview", fx.with_fixtures("SELECT * FROM fx_raw ORDER BY event_id, timestamp LIMIT 50"))
def preview(spark, sf_dir):
    return sinks.preview(fx.raw_flows(spark, sf_dir), 50, "event_id", "timestamp")
