"""Whole jobs, and the shape of their plans."""

import json
import re

import pytest
from flow_rows import FLOW_DDL, flow
from pyspark.sql.types import StructType

import __spark_entry__ as contract
from flowsight.catalog import fixtures as fx
from flowsight.models.settings import PRESETS
from flowsight.plans.batch import BatchOutputs, run_batch
from flowsight.plans.detection import build_intelligence, run_dashboard, run_defense, run_detection, run_intelligence
from flowsight.operators.logs import table_ready
from flowsight.plans.stream import StreamOutputs, run_stream
from flowsight.plans.upload import report_tables, run_upload
from flowsight.sources import sinks
from flowsight.streaming.flows import StreamOptions


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("job")


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, folder):
    dataset = str(folder / "flows.csv")
    sinks.write_csv(fx.vendor_text(spark, sf_dir).drop("event_id").coalesce(1), dataset)
    part = next((folder / "flows.csv").glob("*.csv"))
    header = part.read_text().splitlines()[0]
    (folder / "flows.csv" / "more.csv").write_text(f"{header}\n2024-01-01,only,three\n")
    out = BatchOutputs.below(str(folder / "out"))
    return out, run_batch(spark, dataset, out).first()


def test_batch_job(spark, sf_dir, outputs):
    out, report = outputs
    assert (report["rows_processed"], report["duplicates_removed"], report["corrupted_rows_quarantined"]) == (1000, 20, 1)
    table = spark.read.parquet(out.features)
    assert table.count() == 1000 and len(table.columns) == 22
    direct = contract.queries()["select_features"](spark, sf_dir)
    assert {r["src_ip"]: r["unique_ports_accessed"] for r in table.collect()} == {r["src_ip"]: r["unique_ports_accessed"] for r in direct.collect()}
    assert spark.read.parquet(out.quarantine).first()["_corrupt_record"] == "2024-01-01,only,three"
    assert spark.read.parquet(out.audit).first()["audit_status"] == "success"
    assert spark.read.json(out.audit_report).first()["audit_status"] == "success"
    kinds = {r["event_type"] for r in spark.read.json(out.events).collect()}
    assert spark.read.text(out.log).count() == 1 and kinds == {"batch_report", "batch_security_pipeline_completed"}


def test_detection_to_defence(spark, folder, outputs):
    out, _ = outputs
    predictions = str(folder / "predictions")
    assert build_intelligence(spark, predictions).count() == 0
    run_detection(spark, out.features, predictions, PRESETS["quick"])
    intel = build_intelligence(spark, predictions)
    sources = spark.read.parquet(out.features).select("src_ip").distinct().count()
    assert intel.count() == sources and intel.where("risk_score NOT BETWEEN 0 AND 1").count() == 0
    intelligence, decisions = str(folder / "intelligence"), str(folder / "decisions")
    run_intelligence(spark, predictions, intelligence, decisions)
    assert spark.read.parquet(decisions).count() == sources
    actions = spark.read.option("header", True).csv(run_defense(spark, intelligence, str(folder / "actions")))
    assert actions.count() == sources and actions.where("timestamp IS NULL").count() == 0
    run_dashboard(spark, intelligence, str(folder / "dashboard"))
    stamps = {"alerts": "timestamp", "timeline": "time", "attacks": "timestamp"}
    for name, column in stamps.items():
        shown = spark.read.json(str(folder / "dashboard" / name))
        assert 0 < shown.count() <= 12 and shown.where(f"{column} NOT RLIKE '^20..-..-..T'").count() == 0


def test_upload(spark, folder):
    rows = [("a", "b", "700", "503"), ("a", "b", "700", "503"), ("c", " ", None, "200")]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, request_rate string, status_code string")
    sinks.write_csv(df, str(folder / "up.csv"))
    reports = run_upload(spark, str(folder / "up.csv"), str(folder / "norm"), str(folder / "registry"), 12)
    assert tuple(reports["file_stats"].first()) == (3, 1, 2, False)
    assert reports["corrupt_rows"].count() == 0
    assert {r["src_ip"] for r in reports["ip_risk"].collect()} == {"a", "c"}
    assert reports["risk_metrics"].first()["activeThreats"] == 1
    assert spark.read.parquet(str(folder / "registry")).first()["row_count"] == 3


def test_upload_totals_count_every_source(spark, folder):
    rows = [(f"s{k}", "b", "9000", "503") for k in range(100)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, request_rate string, status_code string")
    reports = report_tables(df)
    assert reports["ip_risk"].count() == 30
    assert reports["risk_distribution"].first()["total_predictions"] == 100
    assert reports["risk_metrics"].first()["activeThreats"] == 100


def test_stream_job_quarantines_and_reports(spark, folder):
    source = folder / "arriving"
    source.mkdir()
    names = [n.strip().split(" ")[0] for n in FLOW_DDL.split(",")]
    for k in range(3):  # three micro-batches
        good = "\n".join(json.dumps(dict(zip(names, flow(port=float(p), packet_size=100.0 + k), strict=True))) for p in range(4))
        (source / f"{k}.json").write_text(f"{good}\nnonsense {k}\n")
    out = StreamOutputs.below(str(folder / "stream"))
    schema = StructType.fromDDL(f"{FLOW_DDL}, _corrupt_record string")
    run_stream(spark, str(source), schema, out, StreamOptions(str(folder / "ck"), trigger_seconds=None), max_files=1)
    assert spark.read.parquet(out.features).count() == 12
    kept = spark.read.option("mergeSchema", True).parquet(out.quarantine)
    assert sorted(r["_corrupt_record"] for r in kept.collect()) == ["nonsense 0", "nonsense 1", "nonsense 2"]
    assert table_ready(spark, out.features)
    assert spark.read.json(out.reports).agg({"records": "sum"}).first()[0] == 12
    assert "stream completed" in "\n".join(r["value"] for r in spark.read.text(out.log).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["select_features", "detection_features", "threat_intelligence", "quality_report", "file_stats"])
def test_plans_have_no_product_and_no_python(spark, sf_dir, name):
    plan = plan_of(contract.queries()[name](spark, sf_dir))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python", plan)


def test_ranks_are_limited_before_the_shuffle(spark, sf_dir):
    for name in ("dedupe_flows", "latest_n_per_key", "union_logs"):
        plan = plan_of(contract.queries()[name](spark, sf_dir))
        assert "Partial" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = plan_of(contract.queries()["top_k"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan and "o_orderpriority" not in plan
    risky = plan_of(contract.queries()["top_values_brand"](spark, sf_dir))
    assert "ReadSchema: struct<p_brand:string>" in risky


def test_no_rows_at_all(spark):
    from flowsight.plans.batch import build_features

    assert build_features(spark.createDataFrame([], FLOW_DDL)).count() == 0
