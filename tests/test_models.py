import subprocess
import sys
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowsight.catalog import fixtures as fx
from flowsight.models import detect, outliers, supervised
from flowsight.models.settings import PRESETS
from flowsight.sources.scratch import staged

QUICK = PRESETS["quick"]


@pytest.fixture(scope="module")
def labeled(spark, sf_dir):
    return staged(detect.labeled_flows(fx.stored_features(spark, sf_dir)), "labeled")


def test_boosted_agrees_with_the_rules(labeled):
    vectors = supervised.assemble(labeled)
    forest, boosted = detect.fit_models(vectors, QUICK)
    scored = supervised.score_threats(vectors, forest, boosted)
    row = scored.agg(
        F.avg((F.col("threat_type") == F.col(detect.RULE_LABEL)).cast("int")), F.min("threat_score"), F.max("threat_score")
    ).first()
    assert row[0] >= 0.98 and 0.25 <= row[1] <= row[2] <= 1.0
    assert boosted.labels == ("brute_force", "normal", "port_scan", "traffic_spike")
    importance = supervised.feature_importance(forest)
    assert sum(v for _, v in importance) == pytest.approx(1.0)


def test_one_class_only(labeled):
    only = supervised.assemble(labeled.where(F.col(detect.RULE_LABEL) == "normal"))
    forest, boosted = detect.fit_models(only, QUICK)
    row = supervised.score_threats(only, forest, boosted).select("threat_type", "threat_score").distinct().collect()
    assert [tuple(r) for r in row] == [("normal", 1.0)]


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError):
        supervised.class_counts(spark.range(200).selectExpr("cast(id AS string) AS k"), "k")
    few = spark.range(20).selectExpr("cast(id AS string) AS k", "id")
    with pytest.raises(ValueError):
        supervised.stratified(few, "k", ["id"], 10, replace(QUICK, most_classes=19))


def test_shares_take_rare_labels_whole():
    shares = supervised.label_shares({"a": 10**12, "b": 5, "c": 2000, "d": 10**6}, 9005)
    assert shares["b"] == 1.0 and shares["c"] == 2000 / 2000
    assert shares["a"] * 10**12 == pytest.approx(3500) and shares["d"] * 10**6 == pytest.approx(3500)
    assert supervised.label_shares({"a": 3, "b": 4}, 100) == {"a": 1.0, "b": 1.0}


def test_one_row_in_a_hundred_thousand_is_learned(spark):
    rows = spark.range(100_000).selectExpr(
        "id", "CASE WHEN id = 77777 THEN 'rare' WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind",
        "array(CASE WHEN id = 77777 THEN 50D ELSE id % 7 END, cast(id % 2 AS double)) AS x",
    )
    vectors = staged(rows, "rare").select("id", "kind", array_to_vector("x").alias(supervised.VECTOR))
    settings = replace(QUICK, fit_rows=2000)
    sample = supervised.stratified(vectors, "kind", ["id"], 2000, settings)
    assert 1700 <= sample.count() <= 2300 and sample.agg(F.sum(supervised.WEIGHT)).first()[0] == pytest.approx(100_000, rel=0.1)
    training = sample.select(supervised.VECTOR, "kind", supervised.WEIGHT)
    forest, boosted = supervised.fit_forest(training, "kind", settings), supervised.fit_boosted(training, "kind", settings)
    assert forest.labels == boosted.labels == ("even", "odd", "rare")
    scored = supervised.score_threats(vectors, forest, boosted)
    assert scored.where("threat_type != kind OR forest_type != kind").count() == 0


def test_planted_outliers_rank_high_and_votes_are_few(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(1000, 4))
    data[:20] = rng.normal(size=(20, 4)) * 0.5 + 9
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(data)], "i int, a double, b double, c double, d double")
    settings = PRESETS["quick"]
    scored = outliers.outlier_scores(df, ("a", "b", "c", "d"), ("i",), settings).toPandas().set_index("i")
    for name in ("isolation_score", "kernel_score"):
        assert (scored[name].rank(ascending=False).loc[range(20)] <= 100).all()
    share = (scored["anomaly_flag"] == "ANOMALY").mean()
    assert 0.02 <= share <= 0.2
    again = outliers.outlier_scores(df.repartition(5), ("a", "b", "c", "d"), ("i",), settings).toPandas().set_index("i")
    assert np.allclose(scored.loc[again.index, list(outliers.SCORES)], again[list(outliers.SCORES)], atol=1e-9)
    single = outliers.flag_outliers(
        spark.createDataFrame(scored.reset_index()[["i", *outliers.SCORES]]), PRESETS["legacy_outliers"]
    )
    assert single.where("anomaly_flag = 'ANOMALY'").count() >= share * 1000


def test_tree_samples_are_bounded_and_even(spark):
    df = spark.range(30000).selectExpr("id", "cast(id AS double) AS x")
    samples = outliers._tree_samples(df, ["x"], ["id"], 30000, QUICK).groupBy("tree").count().collect()
    assert len(samples) == QUICK.isolation_trees
    assert all(r["count"] == QUICK.isolation_sample for r in samples)


def test_constant_columns_and_no_rows(spark):
    flat = spark.range(50).selectExpr("id", "1.0D AS a", "cast(id AS double) AS b")
    scored = outliers.outlier_scores(flat, ("a", "b"), ("id",), QUICK)
    assert scored.where("isolation_score IS NULL OR isnan(kernel_score)").count() == 0
    with pytest.raises(ValueError):
        outliers.fit_detectors(flat.limit(0), ("a", "b"), ("id",), QUICK)


def test_presets():
    assert (PRESETS["detection"].forest_trees, PRESETS["detection"].boost_rounds, PRESETS["detection"].isolation_trees) == (160, 140, 180)
    assert (PRESETS["bundle"].forest_depth, PRESETS["bundle"].contamination) == (8, 0.12)
    assert PRESETS["legacy_outliers"].min_votes == 1


def test_report_is_honest(spark, sf_dir):
    row = detect.model_report(fx.stored_features(spark, sf_dir), QUICK).first()
    assert row["holdout_rows"] > 100 and row["training_rows"] + row["holdout_rows"] == 1000
    assert 0.8 <= row["accuracy"] <= 1.0 and row["training_time"] > 0
    assert len(row["feature_importance"]) == 13


def test_task_functions_load_without_the_package(tmp_path):
    fitted = outliers.Detectors(("a",), *[np.ones((1, 1))] * 2, tuple(np.full((1, 1), v) for v in (-1, 0, 0, 0, 1)), 1.0,
                                np.ones((1, 2)), np.ones(2), np.ones(2), 0.5, np.ones(7), (1, 2, 1))
    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps((outliers._grow(1, 8), outliers._scorer(fitted))))
    code = f"import pickle; g, s = pickle.load(open({str(blob)!r}, 'rb')); import numpy as np; print(len(s(np.ones((3, 1)))))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.stdout.strip() == "3", done.stderr


def test_a_bounded_fit_has_as_few_tasks_on_a_table_of_many_parts(labeled, monkeypatch):
    parts = []
    monkeypatch.setattr(detect, "fit_forest", lambda df, *_: parts.append(df.rdd.getNumPartitions()))
    monkeypatch.setattr(detect, "fit_boosted", lambda df, *_: parts.append(df.count()))
    detect.fit_models(supervised.assemble(labeled.repartition(40)), replace(QUICK, fit_rows=9000))
    assert parts == [2, 1000]


def test_completed_trees_reach_the_same_depths():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(700, 3))
    raw[5, 1] = np.nan
    grow, trees = outliers._grow(1, 6), []
    for t in range(5):
        chosen = np.nan_to_num(raw[rng.choice(len(raw), 64, replace=False)])
        trees.append(grow(pd.DataFrame({"tree": t, "x": list(chosen)})))
    packed = [np.zeros((5, max(map(len, trees))), dtype=kind) for kind in (int, float, int, int, float)]
    for t, nodes in enumerate(trees):
        for field, name in zip(packed, ("feature", "cut", "low", "high", "depth")):
            field[t, : len(nodes)] = nodes[name]

    def walk(row, t):
        feature, cut, low, high, depth = (field[t] for field in packed)
        node = 0
        while feature[node] >= 0:
            node = low[node] if row[feature[node]] <= cut[node] else high[node]
        return depth[node]

    assert np.allclose(outliers._depths(raw, *outliers._complete(tuple(packed))), [sum(walk(row, t) for t in range(5)) for row in raw])
