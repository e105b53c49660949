"""Model jobs over the whole flow table, with the published settings.

Other libraries' scores have no SQL, so each query states what SQL can check: rows in are rows out, predictions agree with
the rule that the labels come from, scores lie in range, levels follow from scores, flags keep the contamination share.

The classifiers learn from every row, and every row is scored. They are fitted once for a session and dataset and used by
all queries that score; ``rare_labels`` alone shows the bound of ``Settings.fit_rows``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import risk_band
from ..models import detect, outliers, supervised
from ..models.settings import PRESETS
from ..operators.intel import threat_intelligence
from ..sources.scratch import staged
from . import fixtures as fx
from .registry import register

SETTINGS = PRESETS["detection"]
AGREEMENT = 0.9  # share of rows of a label that a classifier must get right
SHARE_SLACK = 0.02
_MODELS: dict[tuple[str, str], tuple[supervised.Forest, supervised.Boosted]] = {}


def _vectors(spark, sf_dir):
    labeled = staged(detect.labeled_flows(fx.stored_features(spark, sf_dir)), "labeled-flows")
    return supervised.assemble(labeled)


def models(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = detect.fit_models(_vectors(spark, sf_dir), SETTINGS)
    return _MODELS[key]


def _in_range(score: str) -> Column:
    return F.every(F.col(score).between(0.0, 1.0))


def _agreement(df, predicted: str, score: str):
    right = F.avg((F.col(predicted) == F.col(detect.RULE_LABEL)).cast("double")) >= AGREEMENT
    return df.groupBy(F.col(detect.RULE_LABEL).alias("threat_type")).agg(
        F.count(F.lit(1)).alias("flows"), right.alias("agrees"), _in_range(score).alias("in_range")
    )


_AGREEMENT_SQL = fx.with_fixtures(
    "SELECT threat_type, count(*) AS flows, true AS agrees, true AS in_range FROM fx_labels GROUP BY threat_type"
)


@register("fit_forest", _AGREEMENT_SQL)
def fit_forest(spark, sf_dir):
    scored = supervised.with_forest(_vectors(spark, sf_dir), models(spark, sf_dir)[0])
    return _agreement(scored, "forest_type", "forest_score")


@register("fit_boosted", _AGREEMENT_SQL)
def fit_boosted(spark, sf_dir):
    scored = supervised.with_boosted(_vectors(spark, sf_dir), models(spark, sf_dir)[1])
    return _agreement(scored, "boosted_type", "boosted_score")


@register("score_threats", _AGREEMENT_SQL)
def score_threats(spark, sf_dir):
    scored = supervised.score_threats(_vectors(spark, sf_dir), *models(spark, sf_dir))
    return _agreement(scored, "threat_type", "threat_score")


RARE = "packet_size = 101"  # one flow in 1450


@register(
    "rare_labels",
    fx.with_fixtures(
        f"SELECT CASE WHEN {RARE} THEN 'exfiltration' ELSE threat_type END AS threat_type, count(*) AS flows, "
        "true AS learned, true AS agrees FROM fx_labels GROUP BY 1"
    ),
)
def rare_labels(spark, sf_dir):
    """A label of a few flows in ten thousand, in a sample of 2000: its flows carry much and are all drawn.

    Both classifiers know the label; agreement is that of the forest, whose labels weigh alike. The boosted trees of the
    trial preset keep the label's true weight, and six rounds do not tell such flows from others of their kind.
    """
    rare = F.expr(RARE)
    labeled = detect.labeled_flows(fx.stored_features(spark, sf_dir)).withColumns(
        {
            detect.RULE_LABEL: F.when(rare, "exfiltration").otherwise(F.col(detect.RULE_LABEL)),
            "bytes_transferred": F.when(rare, 1e9).otherwise(F.col("bytes_transferred")),
        }
    )
    vectors = supervised.assemble(staged(labeled, "rare-labels"))
    forest, boosted = detect.fit_models(vectors, replace(PRESETS["quick"], fit_rows=2000))
    scored = supervised.with_forest(vectors, forest)
    label = F.col(detect.RULE_LABEL)
    return scored.groupBy(label.alias("threat_type")).agg(
        F.count(F.lit(1)).alias("flows"), F.every(label.isin(*boosted.labels)).alias("learned"),
        (F.avg((F.col("forest_type") == label).cast("double")) >= AGREEMENT).alias("agrees"),
    )


@register(
    "outlier_scores",
    fx.with_fixtures(
        "SELECT d.detector, n AS rows, true AS keeps_share, true AS votes_follow FROM (SELECT count(*) AS n FROM fx_healed) h "
        "CROSS JOIN (VALUES ('isolation_score'), ('kernel_score'), ('autoencoder_error')) d(detector)"
    ),
)
def outlier_scores(spark, sf_dir):
    labeled = staged(detect.labeled_flows(fx.stored_features(spark, sf_dir)), "labeled-flows")
    scored = staged(outliers.outlier_scores(supervised.model_inputs(labeled), settings=SETTINGS), "outlier-flags")
    votes = sum((F.col(f"{c}_flag").cast("int") for c in outliers.SCORES), F.lit(0))
    follows = (F.col("anomaly_flag") == "ANOMALY") == (votes >= SETTINGS.min_votes)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("detector"), F.col(f"{c}_flag").alias("flag")) for c in outliers.SCORES]))
    share = F.avg(F.col("d.flag").cast("double"))
    return scored.select(follows.alias("follows"), each.alias("d")).groupBy("d.detector").agg(
        F.count(F.lit(1)).alias("rows"), (F.abs(share - SETTINGS.contamination) <= SHARE_SLACK).alias("keeps_share"),
        F.every("follows").alias("votes_follow"),
    )


_LABELS = ("normal", "traffic_spike", "brute_force", "port_scan")


@register(
    "detect_threats",
    fx.with_fixtures(
        "SELECT timestamp, src_ip, dst_ip, port, protocol, true AS known_type, true AS level_follows, true AS known_flag FROM fx_healed"
    ),
)
def detect_threats(spark, sf_dir):
    found = detect.detect_threats(fx.stored_features(spark, sf_dir), SETTINGS, models(spark, sf_dir))
    return found.select(
        *detect.FLOW_KEY,
        F.col("threat_type").isin(*_LABELS).alias("known_type"),
        (F.col("risk_level") == risk_band("threat_score")).alias("level_follows"),
        F.col("anomaly_flag").isin("ANOMALY", "NORMAL").alias("known_flag"),
    )


@register(
    "detected_intelligence",
    fx.with_fixtures("SELECT DISTINCT src_ip, true AS in_range, true AS has_action FROM fx_healed"),
)
def detected_intelligence(spark, sf_dir):
    found = detect.detect_threats(fx.stored_features(spark, sf_dir), SETTINGS, models(spark, sf_dir))
    return threat_intelligence(found).select(
        "src_ip", F.col("risk_score").between(0.0, 1.0).alias("in_range"), F.col("recommended_action").isNotNull().alias("has_action")
    )


@register(
    "model_report",
    fx.with_fixtures(
        "SELECT 'active' AS status, count(*) AS rows, true AS accurate, true AS weighed FROM fx_healed"
    ),
)
def model_report(spark, sf_dir):
    """Fits anew, on the rows that are not held out."""
    report = detect.model_report(fx.stored_features(spark, sf_dir), SETTINGS)
    weights = F.aggregate("feature_importance", F.lit(0.0), lambda a, f: a + f["importance"])
    return report.select(
        "status", (F.col("training_rows") + F.col("holdout_rows")).alias("rows"),
        ((F.col("accuracy") >= AGREEMENT) & (F.col("forest_accuracy") >= AGREEMENT)).alias("accurate"),
        F.coalesce(weights > 0, F.lit(False)).alias("weighed"),
    )
