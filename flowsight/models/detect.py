"""The detection job: features -> rule labels -> models -> predictions."""

from __future__ import annotations

import math
import time

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import risk_band, rule_label
from ..operators.features import MODEL_FEATURES, detection_features
from ..schema import FLOW_KEY
from ..sources.scratch import staged
from .outliers import outlier_scores
from .settings import PRESETS, Settings
from .supervised import (
    VECTOR,
    WEIGHT,
    Boosted,
    Forest,
    assemble,
    feature_importance,
    fit_boosted,
    fit_forest,
    label_index,
    score_threats,
    stratified,
)

RULE_LABEL = "threat_type_rule"
FIT_TASK_ROWS = 5_000  # rows of a bounded training set that one task takes
PREDICTION_COLUMNS = (
    "timestamp",
    "src_ip",
    "dst_ip",
    "port",
    "protocol",
    "threat_score",
    "threat_type",
    "anomaly_flag",
    "autoencoder_error",
    "risk_level",
)
# Carried along so that the per-source signals can read them.
FLOW_EXTRAS = ("request_rate", "connection_duration", "packet_size", "bytes_transferred")


def labeled_flows(features: DataFrame) -> DataFrame:
    """Detection features with the rule label."""
    return detection_features(features).withColumn(RULE_LABEL, rule_label())


def fit_models(vectors: DataFrame, settings: Settings) -> tuple[Forest, Boosted]:
    """Both classifiers. Each learner bins its input once and caches that, so nothing is cached here.

    All rows are used, as every query and job of this repository but ``rare_labels`` does. Only a caller that sets ``fit_rows``
    gets a stratified sample of about so many, which holds rows of every label; scoring always covers every row. Such a
    sample is written in parts of ``FIT_TASK_ROWS``, since on the table's own partitions a pass would have as many tasks.
    """
    training = vectors
    if settings.fit_rows is not None:
        drawn = stratified(vectors, RULE_LABEL, FLOW_KEY, settings.fit_rows, settings)
        parts = math.ceil(settings.fit_rows / FIT_TASK_ROWS)
        drawn = drawn.repartition(parts, *FLOW_KEY).sortWithinPartitions(*FLOW_KEY)
        training = staged(drawn.select(VECTOR, RULE_LABEL, WEIGHT), "fit-rows")
    training = training.select(VECTOR, RULE_LABEL, *[WEIGHT] * (WEIGHT in training.columns))
    return fit_forest(training, RULE_LABEL, settings), fit_boosted(training, RULE_LABEL, settings)


def detect_threats(
    features: DataFrame, settings: Settings = PRESETS["detection"], models: tuple[Forest, Boosted] | None = None
) -> DataFrame:
    """Predictions for every row of a feature table, with ``models`` or ones fitted on it.

    The labelled table is staged once; fitting, scoring and outlier detection all read that copy.
    """
    labeled = staged(labeled_flows(features), "labeled-flows")
    if labeled.isEmpty():
        raise ValueError("no feature rows to detect threats in")
    vectors = assemble(labeled)
    forest, boosted = fit_models(vectors, settings) if models is None else models
    scored = score_threats(vectors, forest, boosted).drop(VECTOR)
    judged = outlier_scores(scored, MODEL_FEATURES, FLOW_KEY, settings)
    return judged.withColumn("risk_level", risk_band("threat_score")).select(*PREDICTION_COLUMNS, *FLOW_EXTRAS)


def model_report(features: DataFrame, settings: Settings = PRESETS["detection"], holdout: float = 0.2) -> DataFrame:
    """Accuracy on rows the models have not seen, rows and seconds of training, feature importance.

    A row's part is decided by the hash of its flow key, so the split is the same on every run.
    """
    labeled = staged(labeled_flows(features), "labeled-flows")
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), *FLOW_KEY), F.lit(10_000))
    vectors = assemble(labeled).withColumn("_holdout", draw < int(holdout * 10_000))
    started = time.monotonic()
    forest, boosted = fit_models(vectors.where(~F.col("_holdout")), settings)
    seconds = time.monotonic() - started
    truth = label_index(RULE_LABEL, boosted.labels)
    seen = score_threats(vectors.where("_holdout"), forest, boosted).select(
        F.coalesce(truth, F.lit(-1.0)).alias("label"),
        label_index("boosted_type", boosted.labels).alias("boosted"),
        label_index("forest_type", boosted.labels).alias("forest"),
    )
    seen = staged(seen, "holdout-predictions")
    counts = labeled.agg(F.count(F.lit(1)).alias("n")).first()["n"], seen.count()
    accuracy = {}
    for name in ("boosted", "forest"):
        judge = MulticlassClassificationEvaluator(predictionCol=name, metricName="accuracy")
        accuracy[name] = judge.evaluate(seen) if counts[1] else None
    row = (
        "active", accuracy["boosted"], accuracy["forest"], counts[0] - counts[1], counts[1], seconds,
        feature_importance(forest),
    )
    return features.sparkSession.createDataFrame(
        [row],
        "status string, accuracy double, forest_accuracy double, training_rows bigint, holdout_rows bigint, "
        "training_time double, feature_importance array<struct<feature:string,importance:double>>",
    )
