import pytest
from flow_rows import FLOW_DDL, flow

from flowsight.operators.features import STREAM_FEATURE_COLUMNS, select_features, stream_features
from flowsight.operators.logs import table_ready
from flowsight.schema import FLOW_SCHEMA, STREAM_SCHEMA
from flowsight.sources.batches import committed_batches, read_batches
from flowsight.streaming import flows as st


@pytest.fixture
def options(tmp_path):
    return st.StreamOptions(str(tmp_path / "ck"), trigger_seconds=None)


def rows(start, n, minute=0, ip="a"):
    return [flow(timestamp=f"2024-01-01T00:{minute:02d}:{i % 60:02d}Z", src_ip=ip, port=float(i), request_rate=float(i)) for i in range(start, start + n)]


def put(spark, folder, data):
    spark.createDataFrame(data, FLOW_DDL).coalesce(1).write.mode("append").json(str(folder))


def test_feature_stream_equals_batch_per_micro_batch(spark, tmp_path, options):
    source, out, reports = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "rep")
    parts = [rows(0, 5), rows(10, 7, ip="b"), rows(30, 3)]
    want = []
    for part in parts:
        put(spark, source, part)
        stream = st.clean_stream(st.stream_flows(spark, str(source), FLOW_SCHEMA))
        st.run_bounded(st.start_feature_stream(stream, out, reports, options), options)
        batch = stream_features(st.clean_stream(spark.createDataFrame(part, FLOW_DDL)))
        want += map(str, select_features(batch, STREAM_FEATURE_COLUMNS).collect())
    table = spark.read.parquet(out)
    assert table.select("batch_id").distinct().count() == 3
    assert sorted(map(str, table.select(*STREAM_FEATURE_COLUMNS).collect())) == sorted(want)
    metrics = {r["batch_id"]: r["records"] for r in spark.read.json(reports).collect()}
    assert metrics == {0: 5, 1: 7, 2: 3}


def test_restart_adds_nothing(spark, tmp_path, options):
    put(spark, tmp_path / "in", rows(0, 6))
    for _ in range(2):
        stream = st.clean_stream(st.stream_flows(spark, str(tmp_path / "in"), FLOW_SCHEMA))
        st.run_bounded(st.write_stream_features(stream, str(tmp_path / "out"), options), options)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert spark.read.parquet(str(tmp_path / "out")).columns == STREAM_SCHEMA.fieldNames()


def test_replayed_batch_replaces_its_folder(spark, tmp_path):
    write = st._write_batch(str(tmp_path / "o"), str(tmp_path / "r"), stream_features)
    batch = st.clean_stream(spark.createDataFrame(rows(0, 4), FLOW_DDL))
    write(batch, 7)
    write(batch, 7)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_readers_see_a_batch_whole_or_not_at_all(spark, tmp_path):
    out, reports = str(tmp_path / "o"), str(tmp_path / "r")
    seen = []

    def reading(df):
        seen.append((committed_batches(spark, out), read_batches(spark, out).count(), table_ready(spark, out)))
        return stream_features(df)

    batch = st.clean_stream(spark.createDataFrame(rows(0, 4), FLOW_DDL))

    def failing(df):
        reading(df).write.parquet(st.batch_folder(out, 8))  # half a batch, as a run that died leaves it
        raise RuntimeError("lost")

    st._write_batch(out, reports, reading)(batch, 7)
    with pytest.raises(RuntimeError, match="lost"):
        st._write_batch(out, reports, failing)(batch, 8)
    assert (committed_batches(spark, out), read_batches(spark, out).count()) == ([7], 4)
    st._write_batch(out, reports, reading)(batch, 8)
    st._write_batch(out, reports, failing)(batch, 8)  # committed: not touched again
    assert seen == [([], 0, False), ([7], 4, True), ([7], 4, True)]
    assert committed_batches(spark, out) == [7, 8] and read_batches(spark, out).groupBy("batch_id").count().count() == 2
    assert read_batches(spark, out).count() == 8 and table_ready(spark, out)


def test_a_new_checkpoint_does_not_take_over_batches(spark, tmp_path, options):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, source, rows(0, 3))
    for k in range(2):
        stream = st.clean_stream(st.stream_flows(spark, str(source), FLOW_SCHEMA))
        st.run_bounded(st.start_feature_stream(stream, out, str(tmp_path / "rep"), options), options)  # same checkpoint: nothing new
    other = st.StreamOptions(str(tmp_path / "other"), trigger_seconds=None)
    stream = st.clean_stream(st.stream_flows(spark, str(source), FLOW_SCHEMA))
    with pytest.raises(Exception, match="another query or checkpoint"):
        st.run_bounded(st.start_feature_stream(stream, out, str(tmp_path / "rep"), other), other)
    assert read_batches(spark, out).count() == 3


def test_job_enriches_and_spreads_hot_keys(spark, tmp_path, options):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, source, rows(0, 40) + rows(0, 30, ip="nobody") + rows(0, 2, ip="b") + rows(0, 5, ip=None))
    owners = spark.createDataFrame([("a", "alice"), ("b", "bob")], "src_ip string, owner string")
    stream = st.stream_flows(spark, str(source), FLOW_SCHEMA)
    query = st.start_feature_stream(
        stream, out, str(tmp_path / "rep"), options, quarantine=str(tmp_path / "q"), enrichment=st.Enrichment(owners, task_rows=5)
    )
    st.run_bounded(query, options)
    got = read_batches(spark, out).groupBy("src_ip", "owner").count().collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, [("a", "alice", 40), ("b", "bob", 2), ("nobody", None, 30), ("UNKNOWN_SRC", None, 5)])
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        flows = spark.createDataFrame(rows(0, 40) + rows(0, 30, ip="nobody") + rows(0, 4, ip="b"), FLOW_DDL)
        placed = st.enrich_batch(flows, owners, "src_ip", 5).selectExpr("src_ip", "spark_partition_id() AS task").distinct()
        tasks = {r["src_ip"]: r["count"] for r in placed.groupBy("src_ip").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks["a"] > 1 and tasks["nobody"] > 1 and tasks["b"] == 1
    with pytest.raises(ValueError, match="port"):
        st.Enrichment(spark.createDataFrame([("a", 1)], "src_ip string, Port int")).apply(flows)


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path, options):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in (rows(0, 4, minute=1), rows(0, 2, minute=40), rows(5, 3, minute=2), rows(0, 1, minute=59)):
        put(spark, source, part)
        stream = st.clean_stream(st.stream_flows(spark, str(source), FLOW_SCHEMA))
        windows = st.window_ip_stats(stream, "10 minutes", delay="5 minutes")
        st.run_bounded(st.write_stream_features(windows, out, options), options)
    got = sorted((r["window_start"] % 3600 // 60, r["flows"], r["unique_ports_accessed"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 4, 4), (40, 2, 2)]


def test_sliding_windows_overlap(spark):
    flows = st.clean_stream(spark.createDataFrame(rows(0, 3, minute=12), FLOW_DDL))
    got = st.window_ip_stats(flows, "10 minutes", "5 minutes", approximate_ports=True).collect()
    assert sorted(r["window_start"] % 3600 // 60 for r in got) == [5, 10]


def test_stream_dedupe_and_enrichment(spark, tmp_path, options):
    put(spark, tmp_path / "in", rows(0, 4) + rows(0, 4))
    stream = st.dedupe_stream(st.clean_stream(st.stream_flows(spark, str(tmp_path / "in"), FLOW_SCHEMA)))
    owners = spark.createDataFrame([("a", "alice")], "src_ip string, owner string")
    st.run_bounded(st.write_stream_features(st.enrich_stream(stream, owners, "src_ip"), str(tmp_path / "out"), options), options)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 4 and {r["owner"] for r in got} == {"alice"}


def test_corrupt_rows_do_not_enter_the_stream(spark, tmp_path, options):
    folder = tmp_path / "csv"
    folder.mkdir()
    header = ",".join(STREAM_SCHEMA.fieldNames())
    (folder / "a.csv").write_text(f"{header}\nt,a,b,1,TCP,1,1,1,1,1,200\nt,a\n")
    schema = ", ".join(f"{c} string" for c in STREAM_SCHEMA.fieldNames()) + ", _corrupt_record string"
    stream = st.clean_stream(st.stream_flows(spark, str(folder), schema, "csv"))
    st.run_bounded(st.write_stream_features(stream, str(tmp_path / "out"), options), options)
    assert [r["port"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1.0]


def test_bounded_run_stops(spark, tmp_path):
    limited = st.StreamOptions(str(tmp_path / "ck"), trigger_seconds=1, max_runtime_seconds=4)
    put(spark, tmp_path / "in", rows(0, 2))
    stream = st.clean_stream(st.stream_flows(spark, str(tmp_path / "in"), FLOW_SCHEMA, max_files=1))
    query = st.write_stream_features(stream, str(tmp_path / "out"), limited)
    st.run_bounded(query, limited)
    assert not query.isActive and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_end_closes_open_windows_once(spark, tmp_path, options):
    source, out, end = tmp_path / "in", str(tmp_path / "out"), st.StreamEnd(str(tmp_path / "end"))
    put(spark, source, rows(0, 4, minute=1))
    put(spark, source, rows(0, 2, minute=40))
    stream = st.stream_flows(spark, str(source), FLOW_SCHEMA, max_files=1)

    def start(df):
        windows = st.window_ip_stats(st.clean_stream(df), "10 minutes", delay="5 minutes")
        return st.write_stream_features(windows, out, options)

    for _ in range(2):  # a repeated run finds everything closed
        st.run_to_end(stream, end, start, options)
        got = sorted((r["window_start"] % 3600 // 60, r["src_ip"], r["flows"]) for r in spark.read.parquet(out).collect())
        assert got == [(0, "a", 4), (40, "a", 2)]


def test_minutes_are_judged_by_the_latest_ones_across_batches(spark, tmp_path, options):
    source, out = str(tmp_path / "minutes"), str(tmp_path / "out")
    sizes = {0: 2, 1: 2, 3: 9, 4: 2, 20: 3, 21: 4, 22: 1}
    for minutes in ((3, 0, 1), (20, 4), (21, 22)):
        data = [(60 * m, sizes[m]) for m in minutes]
        spark.createDataFrame(data, "minute_start bigint, requests bigint").write.mode("append").parquet(source)
        stream = st.stream_flows(spark, source, spark.read.parquet(source).schema, "parquet")
        st.run_bounded(st.write_stream_features(st.anomalous_minutes(stream, points=3), out, options), options)
    got = {r["minute_start"] // 60: (r["time"], r["requests"], r["isAnomaly"]) for r in spark.read.parquet(out).collect()}
    latest, want = [], {}
    for minute, n in sizes.items():
        latest = [*latest, n][-3:]
        want[minute] = (f"00:{minute:02d}", n, n > 1.6 * sum(latest) / len(latest))
    assert got == want and want[3][2] and not want[4][2]
