from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowsight.llm import decontaminate, near_dup
from flowsight.llm.queries import QUERIES, SQL
from test_near_dup import brute as brute_components
from test_packing import check_places


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        results.append([r.asDict() for r in stage(spark, docs, sf_dir).collect()])
        docs = spark.createDataFrame(results[-1], docs.schema) if len(results) < len(corpus_pipeline.STAGES) else docs
        assert len(results) == len(corpus_pipeline.STAGES) or sorted(results[-1][0]) == sorted(columns)
    first, unique, clean, private, packed = results
    assert 150 < len(first) < 200
    components = brute_components([(r["doc_id"], r["text"]) for r in first])
    assert {r["doc_id"] for r in unique} == {i for i, _, _, kept in components if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {row[0] for row in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in unique], items) if row[-1]}
    assert hit and {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} - hit
    before = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in private} == set(before)
    changed = [r for r in private if r["text"] != before[r["doc_id"]]]
    assert changed and all("[" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in private}
    got: dict[int, int] = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    check_places([type("Row", (), r) for r in packed], 4096)


def test_run_returns_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    check_places(out.collect(), 4096)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))


