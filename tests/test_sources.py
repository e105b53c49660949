import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from flowsight.operators import clean, logs
from flowsight.plans.batch import canonical_files, canonical_flows
from flowsight.sources import files, messages, scratch, sinks
from flowsight.sources import logs as log_source


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_corrupt_csv_rows(spark, tmp_path):
    path = write(tmp_path / "f.csv", "Time,src_ip,dst_port\n1,a,80\n2,b\n3,c,90,extra\n\n4,d,oops\n5,e,NaN\n")
    parsed = scratch.staged(files.read_flows_csv(spark, path), "parsed")
    good, bad = clean.split_corrupt(parsed)
    assert {r["_corrupt_record"] for r in bad.collect()} == {"2,b", "3,c,90,extra"}
    assert good.count() + bad.count() == parsed.count() == 5
    healed = {r["timestamp"]: r["port"] for r in clean.heal(canonical_flows(good)).collect()}
    assert healed == {"1": 80.0, "4": 0.0, "5": 0.0}
    assert clean.split_corrupt(good)[1].count() == 0


def test_pruned_query_on_raw_parse_still_sees_corrupt_rows(spark, tmp_path):
    path = write(tmp_path / "f.csv", "port,b,c\n1,2,3\n1,2\n")
    rows = canonical_flows(files.read_flows_csv(spark, path)).agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("n"), F.max("port"))
    assert rows.first()["n"] == 1


def test_no_record_is_dropped_or_swapped_silently(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    write(folder / "array.json", '[{"x": 1},\n{"x": 2}]')
    write(folder / "lines.json", '{"x": 3}\n')
    rows = files.read_dataset(spark, str(folder)).collect()
    assert sorted(r["x"] for r in rows if r["x"] is not None) == [2, 3]
    assert [r["_corrupt_record"] for r in rows if r["x"] is None] == ['[{"x": 1},']
    ragged = files.read_dataset(spark, write(tmp_path / "r.csv", "a,b,c\n1,2,3\n1,2\n1,2,3,4\n")).collect()
    assert sorted(str(r["_corrupt_record"]) for r in ragged) == ["1,2", "1,2,3,4", "None"]
    headers = tmp_path / "headers"
    headers.mkdir()
    write(headers / "a.csv", "src_ip,dst_ip,port\na,b,1\n")
    write(headers / "b.csv", "dst_ip,src_ip,port\nb,a,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_flows_csv(spark, str(headers)).collect()


def test_layouts_of_a_folder_are_read_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "lay [1] outs"
    write(folder / "a.csv", "src_ip,dst_ip,port\na,b,1\na,b\n")
    write(folder / "b.csv", "dst_ip,src_ip,port\r\nb,c,2\r\n")
    write(folder / "c {x}.csv", "src_ip,dst_ip,port\nd,b,3\n")
    write(folder / "empty.csv", "")
    with gzip.open(folder / "d.csv.gz", "wt") as out:
        out.write('Destination,"Source"\nb,"e"\n')
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    groups = files.files_by_header(spark, path)
    assert sorted(len(g) for g in groups) == [1, 1, 2]
    parsed = scratch.staged(canonical_files(spark, path), "layouts")
    good, bad = clean.split_corrupt(parsed)
    got = {(r["src_ip"], r["dst_ip"], r["port"]) for r in good.collect()}
    assert got == {("a", "b", 1.0), ("c", "b", 2.0), ("d", "b", 3.0), ("e", "b", None)}
    assert [r["_corrupt_record"] for r in bad.collect()] == ["a,b"]
    one = write(tmp_path / "one.csv", "src_ip,port\na,1\n")
    assert canonical_files(spark, one).count() == 1 and len(files.files_by_header(spark, one)) == 1


def test_too_many_layouts_fail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_LAYOUTS", 2)
    for k in range(3):
        write(tmp_path / "m" / f"{k}.csv", f"src_ip,x{k}\na,1\n")
    with pytest.raises(ValueError, match="different headers"):
        files.read_flow_layouts(spark, str(tmp_path / "m"))


def test_datasets_by_suffix(spark, tmp_path):
    spark.range(3).selectExpr("cast(id AS string) AS x").write.parquet(str(tmp_path / "d.parquet"))
    spark.range(3).selectExpr("cast(id AS string) AS x").write.json(str(tmp_path / "d.json"))
    csv = write(tmp_path / "d.csv", "x\n0\n1\n2\n")
    array = write(tmp_path / "a.json", '[\n {"x": "0"},\n {"x": "1"}, {"x": "2"}\n]\n')
    for path in (str(tmp_path / "d.parquet"), str(tmp_path / "d.json"), csv, array):
        assert sorted(r["x"] for r in files.read_dataset(spark, path, multi_line=path == array).collect()) == ["0", "1", "2"]
    for call in (lambda: files.read_dataset(spark, "x.orc"), lambda: files.read_dataset(spark, "x.csv", "orc")):
        with pytest.raises(ValueError):
            call()


def test_missing_table_is_empty(spark, tmp_path):
    empty = files.read_table(spark, str(tmp_path / "none"), "a int, b string")
    assert empty.columns == ["a", "b"] and empty.count() == 0
    assert not logs.table_ready(spark, str(tmp_path / "none"))


def test_tables_and_quarantine(spark, tmp_path):
    table, quarantine = str(tmp_path / "t"), str(tmp_path / "q")
    sinks.write_features(spark.range(2), table)
    sinks.write_features(spark.range(3).withColumn("extra", F.lit(1)), table)
    assert files.read_table(spark, table).columns == ["id", "extra", "processed_at"]
    assert logs.table_ready(spark, table)
    sinks.write_quarantine(spark.range(1), quarantine)
    sinks.write_quarantine(spark.range(1).withColumn("more", F.lit("x")), quarantine)
    kept = files.read_table(spark, quarantine, merge_schema=True)
    assert set(kept.columns) == {"id", "more", "quarantined_at"} and kept.count() == 2
    ready = logs.components_ready(spark, {"features": table, "stream": str(tmp_path / "no")})
    assert {r["component"]: r["ready"] for r in ready.collect()} == {"features": True, "stream": False}
    sinks.write_features(spark.range(0), table)
    assert not logs.table_ready(spark, table)


def test_audit_report_events_and_log(spark, tmp_path):
    audit, report, events, log = (str(tmp_path / n) for n in ("audit", "report", "events", "log"))
    for _ in range(2):
        sinks.write_audit(spark, audit, "d", "p", "q")
        sinks.append_event(spark, events, "batch_report", {"rows": 3})
        sinks.append_log(spark, log, "spark_job", "done | really")
    assert spark.read.parquet(audit).count() == 2
    sinks.write_report(spark.range(1).withColumn("status", F.lit("ok")), report)
    parts = [p for p in os.listdir(report) if p.endswith(".json")]
    assert len(parts) == 1 and json.loads((tmp_path / "report" / parts[0]).read_text()) == {"id": 0, "status": "ok"}
    read = log_source.read_event_log(spark, events).collect()
    assert len(read) == 2 and json.loads(read[0]["details"]) == {"rows": 3} and not read[0]["malformed"]
    line = log_source.read_pipeline_log(spark, log).first()
    assert (line["component"], line["message"]) == ("spark_job", "done | really")


def test_event_statistics(spark, tmp_path):
    text = "\n".join(
        ['{"timestamp": "t1", "event_type": "a", "details": {"x": [1]}}', "", "{oops", '{"timestamp": "t2"}', '{"event_type": "a"}']
    )
    events = log_source.read_event_log(spark, write(tmp_path / "e.jsonl", text))
    got = {r["event_type"]: (r["events"], r["total_events"], r["last_event_at"]) for r in logs.event_stats(events).collect()}
    assert got == {"a": (2, 4, "t2"), "unknown": (1, 4, "t2")}


def test_tails_of_files(spark, tmp_path):
    now = time.time()
    for i in range(5):
        path = tmp_path / "logs" / f"f{i}.log"
        write(path, "\n".join(f"f{i} line {n} {'spark' if n % 2 else 'x'}" for n in range(30)))
        os.utime(path, (now + i, now + i))
    folder = str(tmp_path / "logs")
    recent = logs.recent_logs(spark, folder, files=2, n=3).collect()
    assert sorted(r["value"][:10].strip() for r in recent) == sorted(f"f{i} line {n}" for i in (3, 4) for n in (27, 28, 29))
    lines = log_source.read_lines(spark, folder)
    assert [r["value"].split()[2] for r in logs.tail_n(lines, 2).collect()] == ["28", "29"]
    assert logs.component_log(lines, n=4, window=10).count() == 4
    merged = logs.union_logs({"one": lines, "two": lines.limit(1)}, 5)
    assert {r["log_source"]: r["count"] for r in merged.groupBy("log_source").count().collect()} == {"one": 5, "two": 1}


def test_dataset_listing(spark, tmp_path):
    for name in ("a.csv", "b.json", "c.parquet", "d.txt", files.NORMALIZED_NAME):
        write(tmp_path / "raw" / name, "x")
    os.utime(tmp_path / "raw" / "b.json", (1, 1))
    folder = str(tmp_path / "raw")
    rows = files.list_datasets(spark, [folder, folder, str(tmp_path / "absent")], active="raw/a.csv").collect()
    assert files.list_datasets(spark, [str(tmp_path / "absent")]).count() == 0
    assert {r["name"] for r in rows} == {"a.csv", "b.json", "c.parquet"} and rows[-1]["name"] == "b.json"
    assert [r["name"] for r in rows if r["is_active"]] == ["a.csv"] and rows[0]["size_bytes"] == 1
    assert files.list_datasets(spark, [folder], limit=1).count() == 1


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "b", "5"), ("c", None, "6")], "source string, destination string, rate string")
    with pytest.raises(ValueError):
        sinks.write_normalized(df, str(tmp_path / "n"))
    df = df.withColumnRenamed("rate", "flow_rate")
    sinks.write_normalized(df, str(tmp_path / "n"))
    assert sorted(map(str, spark.read.option("header", True).csv(str(tmp_path / "n")).collect())) == sorted(map(str, df.collect()))
    sinks.write_canonical(df, str(tmp_path / "canon"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "canon")).columns) == 14
    first, second = (sinks.write_actions_csv(df, str(tmp_path / "acts")) for _ in range(2))
    assert first != second and spark.read.option("header", True).csv(first).count() == 2
    assert sinks.write_uploaded(df, str(tmp_path / "up")) == (2, df.columns)
    entry = sinks.register_dataset(df, str(tmp_path / "reg"), "o.csv", "s", "n", "csv", 10).first()
    assert (entry["row_count"], entry["column_count"]) == (2, 3) and "flow_rate" in entry["schema_json"]
    sinks.write_previews({"processed": (df, 50), "removed": (df, 1)}, str(tmp_path / "pre"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pre" / "removed")).count() == 1


def test_messages_decode_what_producers_send(spark):
    values = ['{"src_ip": "a", "port": 22.0, "request_rate": 5}', '{"src_ip": "b", "port": "443", "request_rate": "x"}', "nonsense"]
    got = messages.read_flow_messages(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert [(r["src_ip"], r["port"], r["request_rate"]) for r in got] == [("a", 22, 5.0), ("b", 443, None), (None, None, None)]
    assert [r["_corrupt_record"] for r in got] == [None, None, "nonsense"]
    row = messages.canonicalize_message(spark.createDataFrame([(" ", "9", "7.9")], ["timestamp", "bytes", "dst_port"])).first()
    assert (row["timestamp"], row["packet_size"], row["port"], row["bytes_transferred"]) == ("1970-01-01T00:00:00Z", 9.0, 7, 0.0)


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch.scratch_root(spark)
    assert base is None or root.startswith(base)
    staged = scratch.staged(spark.range(3), "x")
    assert staged.count() == 3 and scratch.path_exists(spark, root)


def test_a_workspace_takes_what_operators_stage_and_leaves_nothing(spark):
    with scratch.Workspace(spark, "job") as work:
        inner = scratch.staged(spark.range(2), "y")
        assert inner.inputFiles()[0].split("://")[-1].find(work.path.split("://")[-1].lstrip("/")) >= 0 and inner.count() == 2
    assert not scratch.path_exists(spark, work.path)
    assert work.path not in scratch.scratch_path(spark, "z")
