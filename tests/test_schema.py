import pytest

from flowsight import schema as sc


def test_first_alias_wins_whatever_the_column_order(spark):
    df = spark.createDataFrame([("late", "early", "9", "1")], "time string, timestamp string, session_duration string, duration string")
    row = sc.canonicalize(df).first()
    assert (row["timestamp"], row["connection_duration"]) == ("early", "1")
    assert row["src_ip"] is None
    assert sc.canonicalize(df).columns == list(sc.FLOW_COLUMNS)


def test_headers_match_regardless_of_case_and_blanks(spark):
    df = spark.createDataFrame([("x", "y", "1")], ["  SRC_IP ", "Destination.IP", "`Rate`"])
    row = sc.canonicalize(df, keep=("Destination.IP",)).first()
    assert row["src_ip"] == "x" and row["Destination.IP"] == "y"


def test_canonicalize_is_idempotent(make_flows):
    once = sc.canonicalize(make_flows({}, {"src_ip": None}))
    assert sc.canonicalize(once).collect() == once.collect()


def test_generator_label_is_no_anomaly_alias(spark):
    df = spark.createDataFrame([("port_scan",)], ["attack_type"])
    assert sc.canonicalize(df).first()["anomaly"] is None


def test_stream_map_is_narrower(spark):
    df = spark.createDataFrame([("a", "b", "1")], ["ip_src", "destination", "bytes_per_packet"])
    row = sc.canonicalize(df, sc.STREAM_ALIASES).first()
    assert (row["src_ip"], row["dst_ip"], row["packet_size"]) == (None, "b", None)
    assert sc.canonicalize(df).first()["packet_size"] == "1"


@pytest.mark.parametrize(
    "columns",
    [["src_ip", "dst_ip"], ["dst_ip", "request_rate", "x"], ["src_ip", "request_rate", "x"], ["src_ip", "dst_ip", "x"]],
)
def test_uploads_without_the_needed_columns_are_refused(spark, columns):
    with pytest.raises(ValueError):
        sc.validate_schema(spark.createDataFrame([tuple("v" for _ in columns)], columns))


def test_minimal_upload(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], ["Source", " ip_dst", "flow_rate"])
    assert sc.validate_schema(df) == {"Source": "string", "ip_dst": "string", "flow_rate": "double"}
    assert [r["column_type"] for r in sc.schema_table(df).orderBy("position").collect()] == ["string", "string", "double"]


def test_families_and_roles(spark):
    video = spark.createDataFrame([("v", "t", "c", 1, "2020")], ["Video_ID", "title", "channel_title", "views", "publish_date"])
    assert sc.detect_profile(video) == "youtube"
    roles = sc.profile_columns(video)
    assert (roles["channel"], roles["views"], roles["key"], roles["key_date"]) == ("channel_title", "views", "Video_ID", "publish_date")
    assert roles["country"] is None
    other = spark.createDataFrame([(1, "x")], ["severity", "state"])
    assert sc.detect_profile(other) == "generic"
    assert sc.profile_columns(other)["category"] == "severity"
