import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowsight.catalog import model_queries
from flowsight.models import detect, supervised, trees
from flowsight.models.settings import PRESETS
from flowsight.sources.scratch import staged

QUICK = PRESETS["quick"]


def _vectors(spark, rows: int, parts: int = 3):
    kind = "CASE WHEN id = 778 THEN 'rare' WHEN id % 3 = 0 THEN 'third' ELSE 'other' END"
    x = "array(CASE WHEN id = 778 THEN 50D ELSE id % 7 END, cast(id % 3 AS double), cast(id * 7919 % 10007 AS double))"
    table = spark.range(0, rows, 1, parts).selectExpr("id", f"{kind} AS {detect.RULE_LABEL}", f"{x} AS x")
    return staged(table, "trees").withColumn(supervised.VECTOR, array_to_vector("x")).drop("x")


def test_models_of_the_queries_learn_from_every_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model_queries, "_vectors", lambda *_: _vectors(spark, 40_000))
    for name in ("fit_forest", "fit_boosted"):
        monkeypatch.setattr(detect, name, lambda df, *_: seen.append((df.count(), supervised.WEIGHT in df.columns)))
    model_queries.models(spark, "every row")
    del model_queries._MODELS[spark.sparkContext.applicationId, "every row"]
    assert seen == [(40_000, False)] * 2


def test_a_row_in_forty_thousand_is_learned_without_a_sample(spark):
    vectors = _vectors(spark, 40_000)
    forest, boosted = detect.fit_models(vectors, QUICK)
    scored = supervised.score_threats(vectors, forest, boosted)
    assert scored.where(f"threat_type != {detect.RULE_LABEL} OR forest_type != {detect.RULE_LABEL}").count() == 0


@pytest.mark.parametrize("weighed", [False, True])
def test_driver_and_tasks_grow_the_same_trees(spark, monkeypatch, weighed):
    vectors = _vectors(spark, 9000)
    if weighed:
        vectors = vectors.withColumn(supervised.WEIGHT, F.lit(2.0))
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 2)
    fitted = []
    for most in (trees.DRIVER_ROWS, 0):
        monkeypatch.setattr(trees, "DRIVER_ROWS", most)
        forest, boosted = detect.fit_models(vectors, QUICK)
        fitted.append((forest.model, *boosted.models))
    for one, other in zip(*fitted):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all()
        assert np.allclose(one.values[one.leaf], other.values[other.leaf])


def test_root_sums_count_every_row_and_the_split_is_the_best(spark):
    vectors = _vectors(spark, 9000)
    index = supervised.label_index(detect.RULE_LABEL, ("other", "rare", "third"))
    rows, limits = trees.binned(vectors, supervised.VECTOR, index, None)
    sums = rows.moved(trees._moved_on([], 1, True)).total(
        trees._slope_sums([(2, 0, *trees.Growing(1, 3).upto(0), 1, np.zeros(1, dtype=int))], 0, 3, 1, 0, 1.0)
    )
    assert (sums[0].sum(axis=2) == 9000).all() and (sums[1].sum(axis=2) == -3000).all()
    (model,) = trees.grow_boosted(rows, limits, [2], 1, 1, 0.1, 1.0, 1.0, 1)
    assert model.feature[0, 0] == 1 and limits[1][model.cut[0, 0]] == 0.5
    assert sorted(model.values[:, 0].tolist()) == [-1.0, 1.0]


def test_limits_part_labels_at_their_ends_and_keep_few_values_apart():
    def summary(values):
        return trees.summary_of(np.asarray(values, dtype=float), np.ones(len(values)))

    assert trees.limits_of([summary([0, 0, 4, 1])]).tolist() == [0.5, 2.5]
    assert len(trees.limits_of([summary([3, 3])])) == 0
    many = summary(np.arange(100_000))
    assert len(many[0]) <= trees.POINTS and many[1].sum() == 100_000 and (many[0][0], many[0][-1]) == (0, 99_999)
    limits = trees.limits_of([many, summary([10**9])])
    assert len(limits) < trees.BINS and limits[-1] > 99_999
    mostly = summary([0] * 900 + list(range(1, 1001)))
    assert len(trees.limits_of([mostly])) > trees.BINS // 2


def test_slopes_fall_where_the_margin_is_right():
    sign, margin = np.array([1.0, -1.0, 1.0]), np.array([0.0, 0.0, 3.0])
    step = 1e-6
    loss = lambda f: 2 * np.log1p(np.exp(-2 * sign * f))
    want = -(loss(margin + step) - loss(margin - step)) / (2 * step)
    assert np.allclose(trees.slopes_of(sign, margin, False), want, atol=1e-5)
