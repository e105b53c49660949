"""The canonical flow record: column names, header aliases, defaults, schema checks.

Everything here works on column names and types only; no job is started.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Header names accepted for each canonical column, in order of preference.
BATCH_ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "event_time", "time", "ts"),
    "src_ip": ("src_ip", "source_ip", "source", "ip_src"),
    "dst_ip": ("dst_ip", "destination_ip", "destination", "ip_dst"),
    "port": ("port", "dst_port", "destination_port"),
    "protocol": ("protocol", "proto"),
    "packet_size": ("packet_size", "packet_length", "pkt_size", "bytes_per_packet"),
    "connection_duration": ("connection_duration", "duration", "session_duration"),
    "login_attempts": ("login_attempts", "attempts", "auth_attempts"),
    "request_rate": ("request_rate", "requests_per_second", "flow_rate", "rate"),
    "bytes_transferred": ("bytes_transferred", "bytes", "total_bytes", "flow_bytes"),
    "status_code": ("status_code", "http_status", "response_code"),
    "failed_logins": ("failed_logins", "failed_attempts"),
    "total_attempts": ("total_attempts", "total_logins", "auth_total"),
    "anomaly": ("anomaly", "anomaly_label", "is_anomaly", "label"),
}
STREAM_ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "event_time", "time", "ts"),
    "src_ip": ("src_ip", "source_ip", "source"),
    "dst_ip": ("dst_ip", "destination_ip", "destination"),
    "port": ("port", "dst_port", "destination_port"),
    "protocol": ("protocol", "proto"),
    "packet_size": ("packet_size", "packet_length", "pkt_size"),
    "connection_duration": ("connection_duration", "duration", "session_duration"),
    "login_attempts": ("login_attempts", "attempts", "auth_attempts"),
    "request_rate": ("request_rate", "requests_per_second", "flow_rate", "rate"),
    "bytes_transferred": ("bytes_transferred", "bytes", "total_bytes", "flow_bytes"),
    "status_code": ("status_code", "http_status", "response_code"),
}
# Messages resolve aliases row by row; note that "bytes" means packet size here.
MESSAGE_ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "event_time", "time"),
    "src_ip": ("src_ip", "source_ip"),
    "dst_ip": ("dst_ip", "destination_ip"),
    "port": ("port", "dst_port"),
    "protocol": ("protocol", "proto"),
    "packet_size": ("packet_size", "bytes"),
    "connection_duration": ("connection_duration", "duration"),
    "login_attempts": ("login_attempts", "attempts"),
    "request_rate": ("request_rate", "rate"),
    "bytes_transferred": ("bytes_transferred", "total_bytes"),
    "status_code": ("status_code", "response_code"),
}
# A header holding all of these is taken to be canonical already.
CANONICAL_MESSAGE_HEADER = ("src_ip", "dst_ip", "request_rate", "bytes_transferred")
TEXT_DEFAULTS: dict[str, str] = {
    "timestamp": "1970-01-01T00:00:00Z",
    "src_ip": "UNKNOWN_SRC",
    "dst_ip": "UNKNOWN_DST",
    "protocol": "UNKNOWN",
}
# Columns that identify one flow.
FLOW_KEY = ("timestamp", "src_ip", "dst_ip", "port", "protocol")
# Header names an uploaded dataset must offer: one of each group.
UPLOAD_REQUIREMENTS: dict[str, tuple[str, ...]] = {
    "source": ("src_ip", "source_ip", "source", "ip_src"),
    "destination": ("dst_ip", "destination_ip", "destination", "ip_dst"),
    "signal": (
        "request_rate",
        "requests_per_second",
        "flow_rate",
        "packet_size",
        "bytes_transferred",
        "status_code",
        "failed_logins",
        "anomaly",
    ),
}
# Column families recognised by name.
PROFILE_FAMILIES: dict[str, tuple[str, ...]] = {
    "youtube": ("video_id", "title", "channel_title", "views"),
    "security": CANONICAL_MESSAGE_HEADER,
}
# Roles a profiled table can fill, with the headers tried in order.
PROFILE_ROLES: dict[str, tuple[str, ...]] = {
    "channel": (
        "channel_title",
        "channel title",
        "channel",
        "city",
        "source",
        "state",
        "county",
        "outlet_identifier",
        "outlet_type",
    ),
    "category": (
        "category_id",
        "category",
        "severity",
        "weather_condition",
        "state",
        "county",
        "item_type",
        "item_fat_content",
        "outlet_location_type",
    ),
    "views": (
        "views",
        "view_count",
        "distance(mi)",
        "severity",
        "temperature(f)",
        "likes",
        "item_outlet_sales",
        "item_mrp",
        "item_visibility",
    ),
    "country": ("publish_country", "country", "state"),
    "key": ("video_id",),
    "key_date": ("trending_date", "publish_date"),
}
# ----------------------------------------------------------------------------

TEXT_COLUMNS = ("timestamp", "src_ip", "dst_ip", "protocol", "anomaly")
NUMERIC_COLUMNS = tuple(c for c in BATCH_ALIASES if c not in TEXT_COLUMNS)
FLOW_COLUMNS = tuple(BATCH_ALIASES)
STREAM_COLUMNS = tuple(STREAM_ALIASES)
CORRUPT = "_corrupt_record"

FLOW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.DoubleType()) for c in FLOW_COLUMNS]
)
STREAM_SCHEMA = T.StructType([FLOW_SCHEMA[c] for c in STREAM_COLUMNS])
FLOW_DEFAULTS: dict[str, str | float] = {
    c: TEXT_DEFAULTS.get(c, 0.0) for c in FLOW_COLUMNS if c != "anomaly"
}


def quoted(name: str) -> Column:
    """Column reference that survives dots, blanks and backticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def header_lookup(columns: Iterable[str]) -> dict[str, str]:
    """Trimmed lower-case header -> header as written."""
    return {c.strip().lower(): c for c in columns}


def resolve_column(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """First alias present in ``df``, as the table spells it."""
    found = header_lookup(df.columns)
    return next((found[a.strip().lower()] for a in aliases if a.strip().lower() in found), None)


def canonicalize(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = BATCH_ALIASES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One projection onto the canonical columns: renamed where an alias exists, null strings elsewhere.

    Columns outside the canonical set are dropped unless named in ``keep``, so a leftover
    ``session_duration`` header cannot collide with the feature of that name.
    """
    picked = []
    for name, options in aliases.items():
        found = resolve_column(df, options)
        picked.append((F.lit(None).cast("string") if found is None else quoted(found)).alias(name))
    return df.select(*picked, *[quoted(c) for c in keep if c in df.columns])


def validate_schema(df: DataFrame) -> dict[str, str]:
    """Column -> type of an acceptable upload; ``ValueError`` when a required kind of column is missing."""
    if len(df.columns) < 3:
        raise ValueError("dataset must contain at least 3 columns")
    present = header_lookup(df.columns)
    missing = [kind for kind, names in UPLOAD_REQUIREMENTS.items() if not any(n in present for n in names)]
    if missing:
        raise ValueError("schema validation failed, no column for: " + ", ".join(missing))
    return {f.name.strip(): f.dataType.simpleString() for f in df.schema.fields}


def schema_table(df: DataFrame) -> DataFrame:
    """``validate_schema`` as rows (position, column, type)."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(validate_schema(df).items())]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def detect_profile(df: DataFrame) -> str:
    """Name of the first column family wholly present, else ``generic``."""
    present = set(header_lookup(df.columns))
    return next((name for name, need in PROFILE_FAMILIES.items() if present.issuperset(need)), "generic")


def profile_columns(df: DataFrame) -> dict[str, str | None]:
    """Profile role -> column that fills it in ``df``."""
    return {role: resolve_column(df, names) for role, names in PROFILE_ROLES.items()}
