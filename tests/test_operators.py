"""Cleaning, joins, positions, profiling: brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from flow_rows import FLOW_DDL, flow
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsight.operators import clean, features, profile, ranks, skew
from flowsight.schema import FLOW_KEY


def test_cast_and_fill(spark):
    df = spark.createDataFrame([("x", "12.5", "NaN"), ("y", "n/a", None)], "src_ip string, port string, packet_size string")
    filled = clean.fill_defaults(clean.cast_flows(df))
    assert [tuple(r) for r in filled.orderBy("src_ip").collect()] == [("x", 12.5, 0.0), ("y", 0.0, 0.0)]


def test_dedupe_keeps_the_first_by_all_columns_whatever_the_partitioning(spark):
    rows = [flow(request_rate=float(i % 7), timestamp=str(i % 5), bytes_transferred=float(i)) for i in range(60)]
    want = None
    for parts in (1, 3, 8):
        random.Random(parts).shuffle(rows)
        got = sorted(clean.heal(spark.createDataFrame(rows, FLOW_DDL).repartition(parts)).collect())
        want = want or got
        assert got == want and len(got) == 5
    again = clean.heal(spark.createDataFrame(want, FLOW_DDL))
    assert sorted(again.collect()) == want
    by_size = clean.dedupe_flows(spark.createDataFrame(rows, FLOW_DDL), order=("bytes_transferred",))
    assert sorted(r["bytes_transferred"] for r in by_size.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_quality_counts_add_up(spark):
    rows = [flow(), flow(anomaly="x"), flow(src_ip=None), flow(src_ip="UNKNOWN_SRC"), flow(port=float("nan")), flow(port=0.0)]
    df = spark.createDataFrame(rows, FLOW_DDL).withColumn("_corrupt_record", F.lit(None).cast("string"))
    bad = df.limit(1).withColumn("_corrupt_record", F.lit("a,b"))
    report = clean.quality_report(df.unionByName(bad)).first()
    healed = clean.heal(df.drop("_corrupt_record")).count()
    assert report["rows_processed"] == healed == 3
    assert report["duplicates_removed"] == 6 - healed
    assert report["null_rows"] == 5
    assert report["corrupted_rows_quarantined"] == 1


def test_rows_with_null(make_flows):
    assert clean.rows_with_null(make_flows({"anomaly": "x"}, {"anomaly": "x", "src_ip": None}, {})).count() == 2


def _plain(rows):
    by_ip = {}
    for r in rows:
        by_ip.setdefault(r["src_ip"], []).append(r)
    return {
        ip: (len({r["port"] for r in g}), np.mean([r["request_rate"] for r in g]), np.std([r["request_rate"] for r in g]),
             max(r["connection_duration"] for r in g))
        for ip, g in by_ip.items()
    }


def test_statistics_with_one_source_owning_most_rows(spark):
    rng = random.Random(1)
    rows = [
        flow(timestamp=str(i), src_ip="hot" if i % 3 else f"ip{i % 40}", port=float(rng.randrange(30)),
             request_rate=float(rng.randrange(500)), connection_duration=float(rng.randrange(90)))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, FLOW_DDL).repartition(7)
    want = _plain([r.asDict() for r in df.collect()])
    joined = features.with_ip_stats(df).collect()
    assert len(joined) == 1500
    for r in joined:
        ports, mean, std, longest = want[r["src_ip"]]
        assert (r["unique_ports_accessed"], r["session_duration"]) == (ports, longest)
        assert r["avg_request_rate"] == pytest.approx(mean) and r["std_request_rate"] == pytest.approx(std)


def test_join_per_key_equals_a_plain_left_join(spark):
    rows = [(i, None if i % 11 == 0 else ("hot" if i % 2 else f"k{i % 1200}")) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, k string")
    per_key = df.where("k is not null and k <> 'k8'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    hot = {r["k"]: r["_salts"] for r in skew.hot_keys(per_key, "k", "n", 100).collect()}
    assert hot == {"hot": 19}
    assert skew.hot_keys(per_key, "k", "n").count() == 0
    for task_rows in (1, 2, 100, skew.TASK_ROWS):
        got = skew.join_per_key(df, per_key, "k", "n", task_rows)
        assert got.columns == ["k", "i", "top"]
        want = df.join(per_key.select("k", "top"), "k", "left")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select("k", "i", "top").collect()))


def test_hot_rows_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(4000).select(F.lit("hot").alias("k"), "id")
        per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = skew.join_per_key(df, per_key.withColumn("x", F.lit(1)), "k", "n", 100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 4000 / 4
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_join_of_bare_keys_and_of_nothing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    per_key = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("x"))
    assert sorted(map(str, (r["x"] for r in skew.join_per_key(df, per_key, "k", "n").collect()))) == ["1", "1", "None"]
    assert skew.join_per_key(df.limit(0), per_key.limit(0), "k", "n").count() == 0


def test_unique_ports_ignores_null_ports_and_sources(spark):
    rows = [("a", 1.0), ("a", None), ("a", 2.0), ("b", None), (None, 5.0)]
    got = features.unique_ports(spark.createDataFrame(rows, "src_ip string, port double")).collect()
    assert {(r["src_ip"], r["unique_ports_accessed"]) for r in got} == {("a", 2), ("b", 0), (None, None)}
    assert len(got) == 5


def test_constant_rate_has_deviation_one(make_flows):
    df = make_flows({"timestamp": "1"}, {"timestamp": "2"})
    assert tuple(features.global_rate_stats(df).first()) == (10.0, 1.0)
    detected = features.detection_features(df.drop("status_code", "packet_size")).collect()
    assert {(r["traffic_spike_score"], r["status_code"], r["connection_rate"]) for r in detected} == {(0.0, 0.0, 10.0)}


def test_model_inputs_fill_gaps(make_flows):
    row = features.model_inputs(make_flows({"request_rate": float("nan")})).first()
    assert row["request_rate"] == 0.0 and row["packet_entropy"] == 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), min_size=1, max_size=60))
def test_row_ids_are_dense_and_ordered(spark, pairs):
    got = ranks.row_ids(spark.createDataFrame(pairs, "a int, b int").repartition(5), ["a", "b"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(len(pairs)))
    assert [(r["a"], r["b"]) for r in got] == sorted(pairs)


def test_rolling_mean_across_blocks(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, float(rng.randrange(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, s double").repartition(6)
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        for i, r in enumerate(mine):
            last = [x[2] for x in mine[max(0, i - 4) : i + 1]]
            want[r[1]] = sum(last) / len(last)
    for block_rows in (5, 16, 1_000_000):
        got = ranks.rolling_mean(df, "k", ["t"], "s", block_rows=block_rows).collect()
        assert len(got) == 300
        assert all(r["rolling_mean"] == pytest.approx(want[r["t"]]) for r in got)
    with pytest.raises(ValueError):
        ranks.rolling_mean(df, "k", ["t"], "s", block_rows=3)


@pytest.mark.parametrize(
    "values",
    [[1, 2], [5, 5, 5, 5, 6], list(range(101)), [0.5, -3, None, 7, 7, 7, 7, float("nan"), 2], [1, 1, 1, 1, 1, 1, 1, 2, 3, 4]],
)
def test_quantile_histogram_matches_sorted_bins(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    clean_values = sorted(v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v)))
    q = min(5, len(set(clean_values)))
    edges = sorted({float(e) for e in np.quantile(clean_values, [i / q for i in range(q + 1)])})
    want = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        n = sum((low < v <= high) or (i == 0 and v == low) for v in clean_values)
        want.append((i, low, high, n))
    got = [tuple(r) for r in profile.quantile_histogram(df, "v").orderBy("bin").collect()]
    assert [(b, n) for b, *_, n in got] == [(b, n) for b, *_, n in want if n]
    assert np.allclose([r[1:3] for r in got], [w[1:3] for w in want if w[3]])


def test_quantile_histogram_needs_two_values(spark):
    for values in ([], [3.0], [3.0, 3.0, None]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert profile.quantile_histogram(df, "v").collect() == []


def test_profile_of_a_video_table(spark):
    rows = [("v1", "t", "c1", "10", "d1", None), ("v1", "t", "c1", "10", "d1", None), ("v1", "u", "c1", "20", "d1", "IN"), ("v2", "t", None, "x", "d1", "US")]
    df = spark.createDataFrame(rows, "video_id string, title string, channel_title string, views string, trending_date string, publish_country string")
    sections = profile.profile_sections(df)
    assert tuple(sections["duplicates"].first()) == (1, 2)
    assert tuple(sections["missing"].first()) == (3, 3)
    assert [tuple(r) for r in sections["top_channels"].collect()] == [("c1", 3), ("UNKNOWN", 1)]
    assert sum(r["count"] for r in sections["views_distribution"].collect()) == 3
    summary = sections["summary"].first()
    assert (summary["profile"], summary["duplicates_removed"], summary["throughput_rps"]) == ("youtube", 2, 1.0)


def test_file_stats_count_all_rows(spark):
    df = spark.createDataFrame([("a", " "), ("a", " "), ("b", None)], "x string, y string").coalesce(1)
    assert tuple(profile.file_stats(df).first()) == (3, 1, 3, False)
    assert tuple(profile.file_stats(df.limit(0)).first()) == (0, 0, 0, False)


def test_flow_key_is_unique_after_healing(make_flows):
    healed = clean.heal(make_flows({}, {}, {"protocol": None}, {"protocol": "UNKNOWN"}))
    assert healed.groupBy(*FLOW_KEY).count().where("count > 1").count() == 0
